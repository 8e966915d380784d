"""Metadata of a page, read from its markup as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes after a meta's name in which its content is looked for; the head of <html>.
WINDOW, HEAD = 300, 200
#: Characters of names that ``names`` keeps, with a quote.
LONGEST_NAME = 40


def _filled(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _after(html: Column, needle: str, size: int) -> Column:
    """Up to ``size`` characters from the first ``needle``; null where there is none.

    ``contains`` compares bytes; ``instr`` counts characters, which takes many times as long on markup that lacks the needle.
    """
    return F.when(F.contains(html, F.lit(needle)), F.substring(html, F.instr(html, needle), F.lit(size)))


def _content(part: Column) -> Column:
    """The first double-quoted content that closes, else a single-quoted one."""
    return F.coalesce(_filled(F.regexp_extract(part, 'content="([^"]*)"', 1)), _filled(F.regexp_extract(part, "content='([^']*)'", 1)))


def names(html: Column) -> Column:
    """What stands after ``property=`` and ``name=`` with a quote: as many characters as names have that are looked for here, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf"""(?s)(?:property|name)=(?=(["'].{{0,{LONGEST_NAME}}}))"""), F.lit(1)))


def meta(html: Column, name: str, found: Column | None = None) -> Column:
    """Content of the first meta with this property or name, wherever within the window after it.

    ``found``, a column of ``names``, saves the search for what a page lacks.
    """
    if len(name) >= LONGEST_NAME:
        found = None
    needles = [(a, f"{q}{name}{q}") for a in ("property", "name") for q in ('"', "'")]
    parts = [(n, _content(_after(html, f"{a}={n}", WINDOW))) for a, n in needles]
    there = lambda n: F.exists(found, lambda x: x.startswith(n))
    return F.coalesce(*(c if found is None else F.when(there(n), c) for n, c in parts))


def meta_all(html: Column, name: str) -> Column:
    """Contents of all metas with this property, in order."""
    parts = F.slice(F.split(html, f'property="{name}"'.replace(".", r"\.")), 2, 10_000)
    return F.array_compact(F.transform(parts, lambda p: _content(F.substring(p, F.lit(1), F.lit(WINDOW)))))


def json_ld(html: Column) -> Column:
    """Texts of the linked-data blocks that are JSON, in order."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type=["']?application/ld\+json["']?[^>]*>(.*?)</script"""), F.lit(1))
    return F.filter(F.transform(blocks, lambda x: F.trim(x)), lambda b: F.try_parse_json(b).isNotNull())


def _ld(blocks: Column, *paths: str) -> Column:
    """The first filled string at one of the paths, block by block."""
    per = F.transform(blocks, lambda b: F.coalesce(*(_filled(F.get_json_object(b, p)) for p in paths)))
    return F.try_element_at(F.filter(per, lambda v: v.isNotNull()), F.lit(1))


def title(html: Column, found: Column | None = None) -> Column:
    tag = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1))
    return F.coalesce(meta(html, "og:title", found), meta(html, "twitter:title", found), _filled(tag), F.lit(""))


def html_lang(html: Column) -> Column:
    return _filled(F.regexp_extract(_after(html, "<html", HEAD), 'lang="([^"]*)"', 1))


def author(html: Column, found: Column | None = None) -> Column:
    return F.coalesce(_ld(json_ld(html), "$.author.name", "$.author[0].name", "$.author"), meta(html, "author", found), meta(html, "article:author", found), F.lit(""))


def excerpt(html: Column, found: Column | None = None) -> Column:
    return F.coalesce(meta(html, "description", found), meta(html, "og:description", found), _ld(json_ld(html), "$.description"), F.lit(""))


def image(html: Column) -> Column:
    return F.coalesce(_content(_after(html, "og:image", 200)), F.lit(""))


def article(html: Column, found: Column | None = None) -> Column:
    """published, modified, section, site_name, tags and language; empty where nothing says."""
    ld = json_ld(html)
    time = F.regexp_extract(html, 'datetime="([^"]*)"', 1)
    published = F.coalesce(*(meta(html, n, found) for n in ("article:published_time", "date", "pubdate", "dc.date", "sailthru.date")), F.when(F.octet_length(time) >= 10, time), _ld(ld, "$.datePublished"))
    words = F.coalesce(_ld(ld, "$.keywords"), meta(html, "keywords", found), F.lit(""))
    listed = F.filter(F.transform(F.split(F.regexp_replace(words, r'^\[|\]$|"', ""), ","), lambda x: F.trim(x)), lambda w: w != "")
    tags = meta_all(html, "article:tag")
    empty = F.lit("")
    return F.struct(
        F.coalesce(published, empty).alias("published_at"), F.coalesce(meta(html, "article:modified_time", found), _ld(ld, "$.dateModified"), empty).alias("modified_at"),
        F.coalesce(meta(html, "article:section", found), _ld(ld, "$.articleSection"), empty).alias("section"), F.coalesce(meta(html, "og:site_name", found), _ld(ld, "$.publisher.name", "$.publisher"), empty).alias("site_name"),
        F.when(F.size(tags) > 0, tags).otherwise(listed).alias("tags"), F.coalesce(meta(html, "og:locale", found), html_lang(html), meta(html, "content-language", found), _ld(ld, "$.inLanguage"), empty).alias("language"),
    )


def _tag_has(html: Column, tag: str, *patterns: str) -> Column:
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))
    return F.exists(tags, lambda t: F.expr("true") if not patterns else _all(t, patterns))


def _all(t: Column, patterns: tuple[str, ...]) -> Column:
    out = t.rlike(patterns[0])
    for p in patterns[1:]:
        out = out & t.rlike(p)
    return out


def seo_score(html: Column) -> Column:
    """Points for description, Open Graph, Twitter card, canonical, linked data, icon and languages: 100 at most."""
    named = lambda attribute, name: _tag_has(html, "meta", rf"""(?i)\b{attribute}=["']?{name}["'\s>]""", r"""(?i)content=["'][^"']""")
    link = lambda rel: _tag_has(html, "link", rf"""(?i)rel=["']?{rel}["'\s>]""", r"(?i)href=")
    points = (
        (named("name", "description"), 15), (named("property", "og:title"), 15), (named("property", "og:description"), 10), (named("property", "og:image"), 10), (named("name", "twitter:card"), 10), (link("canonical"), 15),
        (_tag_has(html, "script", r"(?i)application/ld\+json"), 15), (link("(?:shortcut )?icon"), 5), (_tag_has(html, "link", r"(?i)rel=.?alternate", r"(?i)hreflang="), 5),
    )
    return sum((F.when(when, F.lit(n)).otherwise(0) for when, n in points), F.lit(0)).cast("int")


AUDIT_BANDS = ((97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-"))


def audit_grade(score: Column) -> Column:
    out = F.lit("F")
    for low, name in reversed(AUDIT_BANDS):
        out = F.when(score >= low, name).otherwise(out)
    return out


def overall(*scores: Column) -> Column:
    """Whole mean of the category scores."""
    return F.floor(sum(scores[1:], scores[0]) / len(scores)).cast("int")

"""Queries on pages and documents: text measures, metadata, URLs, text clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import meta, text, urls
from ..sources.tables import load, repr_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Pieces of SQL that several queries share.
VISIBLE = r"""length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script[^>]*>|<style.*?</style[^>]*>|<(?:script|style).*$', ' ', 'g'), '(?s)<[^>]*>?|>', ' ', 'g'), '[\s\p{Z}\x85\x0B]+', '', 'g'))"""
ARTICLE = r"regexp_extract(html, '(?is)<article>(.*?)</article>', 1)"
HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '')"
TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1))"


def _any_sql(marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(html, {repr_sql(m)})" for m in marks) + ")"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages")


def with_heads(rows: DataFrame) -> DataFrame:
    """``rows`` of pages with metadata in their heads, by page_id."""
    heads = {
        1: '<meta name="description" content="About {id}"><meta property="og:title" content="Shared {id}"><meta property="og:image" content="/i.png"><meta property="article:published_time" content="2023-05-06T07:08:09Z">',
        2: '<meta name="twitter:card" content="summary"><link rel="canonical" href="/c"><script type="application/ld+json">{"author": {"name": "Ann {id}"}, "publisher": {"name": "Press {id}"}, "keywords": "a, b, c"}</script><script type="application/ld+json">{broken</script><link rel="icon" href="/f.ico"><link rel="alternate" hreflang="de" href="/de"><meta property="og:description" content=""><meta property="og:description" content="">' + '<meta name="x" content="y">',
        3: '<meta name="description" content="About"><meta property="og:title" content="Shared"><meta property="og:description" content="D"><meta property="og:image" content="/i.png"><meta name="twitter:card" content="summary"><link rel="canonical" href="/c"><script type="application/ld+json">{"@type": "Article"}</script><link rel="shortcut icon" href="/f.ico"><link rel="alternate" hreflang="de" href="/de"><meta name="author" content="Bob"><meta property="article:published_time" content="2024-01-02"><meta property="article:modified_time" content="2024-02-03"><meta property="article:section" content="News"><meta property="og:site_name" content="Site"><meta property="article:tag" content="t1"><meta property="article:tag" content="t2">',
    }
    made = F.lit("")
    for k, head in heads.items():
        made = F.when(F.col("page_id") % 4 == k, F.replace(F.lit(head), F.lit("{id}"), F.col("page_id").cast("string"))).otherwise(made)
    return rows.withColumn("html", F.replace("html", F.lit("</head>"), F.concat(made, F.lit("</head>"))))


NEEDS_SCRIPTS = f"({_any_sql(text.SHELL_MARKS)} OR {VISIBLE} < 200 OR (strlen(html) >= 10000 AND {VISIBLE} / strlen(html) < 0.03 AND {_any_sql(text.FRAMEWORK_MARKS)}))"
BANDS = " ".join(f"WHEN score >= {low} THEN '{name}'" for low, name in meta.AUDIT_BANDS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, title, text, links, need of scripts and grade."""
    rows = pages(spark, sf_dir)
    html = F.col("html")
    scored = rows.select("page_id", urls.host(F.col("url")).alias("host"), meta.title(html).alias("title"), text.visible_length(html).alias("visible"), F.size(text.tag_attribute(html, "a", "href")).alias("n_links"), text.needs_scripts(html).alias("needs_scripts"), meta.seo_score(html).alias("score"))
    return scored.withColumn("grade", meta.audit_grade(F.col("score")))


QUERIES["flagship_pages"] = flagship
SQL["flagship_pages"] = f"""
SELECT *, CASE {BANDS} ELSE 'F' END AS grade FROM (
  SELECT page_id, {HOST} AS host, {TITLE} AS title, {VISIBLE}::INTEGER AS visible, len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref="([^"]*)"', 1))::INTEGER AS n_links, {NEEDS_SCRIPTS} AS needs_scripts, 0 AS score FROM pages)
"""


@query("e01_content_format", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'markdown' WHEN 2 THEN 'html' WHEN 3 THEN 'llm' ELSE 'text' END AS format FROM pages")
def e01(spark, sf_dir):
    name = F.element_at(F.array(*(F.lit(x) for x in ("md", "markdown", "html", "llm", "text", "pdf"))), (F.col("page_id") % 6 + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", text.content_format(name).alias("format"))


@query("e02_json_ld", "SELECT page_id, CASE WHEN page_id % 4 >= 2 THEN 1 ELSE 0 END AS n_blocks FROM pages")
def e02(spark, sf_dir):
    return with_heads(pages(spark, sf_dir)).select("page_id", F.size(meta.json_ld(F.col("html"))).alias("n_blocks"))


@query("e03_host", f"SELECT page_id, {HOST} AS host FROM pages")
def e03(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"))


@query("e04_visible_length", f"SELECT page_id, {VISIBLE}::INTEGER AS visible FROM pages")
def e04(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.visible_length(F.col("html")).alias("visible"))


@query("e05_needs_scripts", f"SELECT page_id, {NEEDS_SCRIPTS} AS needs_scripts FROM pages")
def e05(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.needs_scripts(F.col("html")).alias("needs_scripts"))


@query("e21_quality_gate", f"SELECT page_id, CASE WHEN src >= 500 AND ext < src * 0.10 THEN 'extraction_rejected_low_text_ratio' END AS note FROM (SELECT page_id, {VISIBLE} AS src, {VISIBLE.replace('html', TITLE)} AS ext FROM pages)")
def e21(spark, sf_dir):
    rows = pages(spark, sf_dir).withColumn("title", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)))
    return rows.select("page_id", text.gate_note(F.col("html"), F.col("title")).alias("note"))


@query("e22_plain_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script[^>]*>|<style.*?</style[^>]*>|<(?:script|style).*$', ' ', 'g'), '(?s)<[^>]*>?|>', ' ', 'g'), '[\s\p{Z}\x0B]+', ' ', 'g')) AS plain FROM pages""")
def e22(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.collapse_blank(text.visible_text(F.col("html"))).alias("plain"))


@query("e27_e28_metadata", """
SELECT page_id, CASE WHEN page_id % 4 = 3 THEN '2024-01-02' WHEN page_id % 4 = 1 THEN '2023-05-06T07:08:09Z' ELSE '' END AS published_at, CASE WHEN page_id % 4 = 3 THEN '2024-02-03' ELSE '' END AS modified_at, CASE WHEN page_id % 4 = 3 THEN 'News' ELSE '' END AS section,
  CASE WHEN page_id % 4 = 3 THEN 'Site' WHEN page_id % 4 = 2 THEN 'Press ' || page_id::VARCHAR ELSE '' END AS site_name, CASE page_id % 4 WHEN 3 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS n_tags, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS language FROM pages""")
def e28(spark, sf_dir):
    return with_heads(pages(spark, sf_dir)).select("page_id", meta.article(F.col("html")).alias("m")).select("page_id", "m.published_at", "m.modified_at", "m.section", "m.site_name", F.size("m.tags").alias("n_tags"), "m.language")


@query("e29_title", f"SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'Shared ' || page_id::VARCHAR WHEN 3 THEN 'Shared' ELSE {TITLE} END AS title, CASE page_id % 4 WHEN 2 THEN 'Ann ' || page_id::VARCHAR WHEN 3 THEN 'Bob' ELSE '' END AS author, CASE page_id % 4 WHEN 1 THEN 'About ' || page_id::VARCHAR WHEN 3 THEN 'About' ELSE '' END AS excerpt, CASE WHEN page_id % 4 IN (1, 3) THEN '/i.png' ELSE '' END AS image FROM pages")
def e29(spark, sf_dir):
    html = F.col("html")
    return with_heads(pages(spark, sf_dir)).select("page_id", meta.title(html).alias("title"), meta.author(html).alias("author"), meta.excerpt(html).alias("excerpt"), meta.image(html).alias("image"))


@query("e34_content_text", r"""
SELECT doc_id, strlen(t) >= 15 AND NOT regexp_matches(t, '^(https?://|/|\{|\[)') AND contains(t, ' ') AND length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) / strlen(t) >= 0.6 AS is_content
FROM (SELECT doc_id, trim(text) AS t FROM documents) WHERE t <> ''""")
def e34(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("t")).where("t <> ''")
    return rows.select("doc_id", text.is_content_text(F.col("t")).alias("is_content"))


@query("e35_truncate", "SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE left(text, list_max(list_filter(range(75, 301), lambda k: strlen(left(text, k)) <= 300))) || '…' END AS cut FROM documents")
def e35(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.truncate_bytes(F.col("text"), 300).alias("cut"))


@query("e36_low_quality", f"SELECT page_id, strlen(html) > 5000 AND strlen({TITLE}) < 100 AS low FROM pages")
def e36(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.low_quality(F.col("html"), F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1))).alias("low"))


@query("e38_links", """SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref="([^"]*)"', 1)) AS href FROM pages""")
def e38(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.explode(text.tag_attribute(F.col("html"), "a", "href")).alias("href"))


@query("e40_same_origin", f"SELECT page_id, {HOST} = 'm.ththth.example.net' AND url LIKE 'https://%' AS same FROM pages")
def e40(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.same_origin(F.col("url"), F.lit("https://m.ththth.example.net:443/x")).alias("same"))


@query("js02_script_state", f"SELECT page_id, {_any_sql(text.SCRIPT_STATE_MARKS)} AS has_state FROM pages")
def js02(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.has_script_state(F.col("html")).alias("has_state"))


@query("i02_seo_score", f"SELECT page_id, score, CASE {BANDS} ELSE 'F' END AS grade FROM (SELECT page_id, CASE page_id % 4 WHEN 1 THEN 40 WHEN 2 THEN 50 WHEN 3 THEN 100 ELSE 0 END AS score FROM pages)")
def i02(spark, sf_dir):
    return with_heads(pages(spark, sf_dir)).select("page_id", meta.seo_score(F.col("html")).alias("score")).withColumn("grade", meta.audit_grade(F.col("score")))


@query("i07_link_counts", f"""
SELECT page_id, count(*) FILTER (WHERE NOT ext) AS internal, count(*) FILTER (WHERE ext) + page_id % 3 AS external
FROM (SELECT page_id, regexp_matches(h, '^(https?:)?//') AND NOT contains(h, {HOST}) AS ext FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref="([^"]*)"', 1)) AS h FROM pages)) GROUP BY page_id""")
def i07(spark, sf_dir):
    away = F.concat("html", F.repeat(F.lit('<a href="https://away.example.org/x">x</a>'), (F.col("page_id") % 3).cast("int")))
    flat = pages(spark, sf_dir).withColumn("html", away).select("page_id", "url", F.explode(text.tag_attribute(F.col("html"), "a", "href")).alias("h"))
    ext = flat.h.rlike("^(https?:)?//") & ~F.contains("h", urls.host(F.col("url")))
    return flat.groupBy("page_id").agg(F.count_if(~ext).alias("internal"), F.count_if(ext).alias("external"))


#: Written out, so that the SQL doesn't follow the engine's own list.
INVISIBLE_SQL = r"[\x{200B}\x{200C}\x{200D}\x{200E}\x{200F}\x{FEFF}\x{00AD}\x{2060}\x{2062}\x{2063}\x{2064}\x{034F}]"


@query("l02_strip_zero_width", f"SELECT doc_id, md5(regexp_replace(substr(text, 1, 40) || chr(8203) || chr(847) || chr(8289) || substr(text, 41) || chr(173) || chr(65279), '{INVISIBLE_SQL}', '', 'g')) AS digest FROM documents")
def l02(spark, sf_dir):
    dotted = F.concat(F.substring("text", F.lit(1), F.lit(40)), F.lit("\u200b\u034f\u2061"), F.expr("substring(text, 41)"), F.lit("\u00ad\ufeff"))
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_zero_width(dotted)).alias("digest"))


@query("l26_collapse_blank_lines", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text || E'  \n\n\n\nend \t', '[\t\x0B\f\r\p{Z}\x1c-\x1f\x85]+\n', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), '^[\s\x0B\p{Z}\x1c-\x1f\x85]+|[\s\x0B\p{Z}\x1c-\x1f\x85]+$', '', 'g')) AS digest FROM documents""")
def l26(spark, sf_dir):
    from ..operators import cleanup

    spaced = load(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("  \n\n\n\nend \t")).alias("text"))
    return cleanup.clean_documents(spaced, step="collapse_ws").select("doc_id", F.md5("text").alias("digest"))


@query("l27_duplicate_blocks", r"""
WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, block, array_to_string(list_slice(regexp_extract_all(lower(block), '[\p{L}\p{N}_]+'), 1, 10), ' ') AS key,
  strlen(trim(block)) < 20 OR regexp_matches(block, '^\s*(#|- |\* |\||>|```)') OR contains(block, '```') AS stays FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stays OR key = '', key ORDER BY pos) AS nth FROM k)
SELECT doc_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE stays OR key = '' OR nth = 1)) AS digest FROM r GROUP BY doc_id""")
def l27(spark, sf_dir):
    """Blocks (here: the lines of a document, set apart) whose first ten words were seen before in it go."""
    from ..operators import cleanup

    apart = load(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return cleanup.clean_documents(apart, step="dedup_blocks").select("doc_id", F.md5("text").alias("digest"))


@query("c01_normalize", r"""
SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]+)', 1)) || CASE WHEN p = '' THEN '/' ELSE p END
  || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS url
FROM (SELECT page_id, url, regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages)""")
def c01(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.normalize(F.col("url")).alias("url"))


@query("c02_cycle", """
WITH s AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM pages)
SELECT page_id, strlen(url) > 2048 OR (len(seg) >= 4 AND len(list_filter(range(1, len(seg) // 2 + 1), lambda k: len(seg) % k = 0 AND len(list_filter(range(k + 1, len(seg) + 1), lambda i: seg[i] <> seg[i - k])) = 0)) > 0) AS cycle FROM s""")
def c02(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.is_cycle(F.col("url")).alias("cycle"))


@query("c03_registrable", f"SELECT page_id, array_to_string(list_slice(string_split({HOST}, '.'), -2, -1), '.') AS domain FROM pages")
def c03(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.registrable(urls.host(F.col("url"))).alias("domain"))


@query("c04_scope", f"SELECT page_id, array_to_string(list_slice(string_split({HOST}, '.'), -2, -1), '.') = 'example.com' AS in_domain, {HOST} = 'www.example.com' AS in_host, regexp_matches(url, '/en/') AND NOT regexp_matches(url, 'page=2') AS in_custom FROM pages")
def c04(spark, sf_dir):
    seed = F.lit("https://www.example.com/")
    return pages(spark, sf_dir).select("page_id", urls.in_scope(F.col("url"), seed).alias("in_domain"), urls.in_scope(F.col("url"), seed, "host").alias("in_host"), urls.in_scope(F.col("url"), seed, "custom", ("/en/",), ("page=2",)).alias("in_custom"))


@query("m04_video_id", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'abcdefghij' || (page_id % 10)::VARCHAR END AS video FROM pages""")
def m04(spark, sf_dir):
    tail = F.concat(F.lit("abcdefghij"), (F.col("page_id") % 10).cast("string"))
    made = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.youtube.com/watch?x=1&v="), tail)).otherwise(F.concat(F.lit("https://youtu.be/"), tail, F.lit("?t=3")))
    return pages(spark, sf_dir).select("page_id", urls.video_id(made).alias("video"))


@query("m06_media_name", r"SELECT page_id, left(sha256(url), 8) AS name, nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]*\.([A-Za-z0-9]{1,5})$', 1)), '') AS extension FROM pages")
def m06(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.media_name(F.col("url")).alias("name"), urls.extension(F.col("url")).alias("extension"))


@query("s26_safe_target", "SELECT page_id, page_id % 4 = 0 AS safe FROM pages")
def s26(spark, sf_dir):
    made = F.element_at(F.array(F.lit(None), F.lit("http://10.0.0.8/x"), F.lit("ftp://example.com/"), F.lit("http://0x7f.1/")), (F.col("page_id") % 4 + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", urls.safe_target(F.coalesce(made, F.col("url"))).alias("safe"))

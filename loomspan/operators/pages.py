"""Pages in bulk: one parse of each page in an Arrow batch, and every report read from that tree."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions import meta, text
from ..functions.findings import Rule, rank, report
from ..session import ship
from . import cleanup, css, dom, sanitize, script

#: Rows of an Arrow batch, at most: pages may be large.
ARROW_ROWS = 500


def _ready(frame: DataFrame) -> None:
    spark = frame.sparkSession
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def _clean(value):
    """The value with a question mark for halves of characters, which scripts and references may hold but columns can't."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode()
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, list | tuple) else value


def _column(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([_clean(v) for v in values], kind)


def _bulk(pages: DataFrame, columns: list[str], schema: str, fields: list[tuple[str, pa.DataType]], make) -> DataFrame:
    """``make(row)`` gives the output rows of an input row, as tuples."""
    _ready(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [out for row in b.to_pylist() for out in make(row)]
            yield pa.RecordBatch.from_arrays([_column([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return pages.select(*columns).mapInArrow(run, schema)


def _beside(frame: DataFrame, needs: list[str], drop: list[str], fields: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    """``frame`` without ``drop`` and with what ``make`` makes of the columns ``needs``, a tuple for each row; all else passes by as it is."""
    _ready(frame)
    kept = [f for f in frame.schema.fields if f.name not in drop]
    at = [frame.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [make(r) for r in b.select(needs).to_pylist()]
            made = [_column([r[i] for r in rows], t) for i, (_, _, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), *made], [*(f.name for f in kept), *(n for n, _, _ in fields)])

    schema = StructType([*kept, *(StructField(n, _parse_datatype_string(k)) for n, k, _ in fields)])
    return frame.mapInArrow(run, schema)


_LONG, _TEXT, _INT, _BOOL, _DOUBLE = pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.float64()
_TEXTS = pa.list_(_TEXT)
INFO = ("title", "author", "excerpt", "image", "article", "json_ld", "needs_scripts")


def page_info(names: tuple[str, ...] = INFO, found: Column | None = None) -> dict[str, Column]:
    """Metadata of ``html`` by name, as column expressions; ``found`` as in ``meta.meta``."""
    html = F.col("html")
    of_metas = {"title": meta.title, "author": meta.author, "excerpt": meta.excerpt, "article": meta.article}
    every = {"image": meta.image, "json_ld": meta.json_ld, "needs_scripts": text.needs_scripts}
    return {n: of_metas[n](html, found) if n in of_metas else every[n](html) for n in names}


def read_pages(pages: DataFrame, fmt: str = "text", *, max_bytes: int | None = None, info: tuple[str, ...] = INFO) -> DataFrame:
    """Main content and metadata of pages (page_id, url, html, others): the output of a reader.

    Content is text, markdown, html, or markdown cleaned for a model with the
    page's metadata before and its structured data after it; it is cut at
    ``max_bytes``. Length counts bytes. Pages without text have empty content.
    ``info`` names the metadata wanted. Nothing is joined or shuffled: a row
    of ``pages`` is a row of the result, without html and with what was read.
    """
    found = F.col("__names")
    frame = pages.withColumn("__names", meta.names(F.col("html"))) if info or fmt == "llm" else pages
    frame = frame.withColumns(page_info(info, found))
    needs = ["url", "html"]
    header: dict[str, Column] = {}
    if fmt == "llm":
        about = page_info(("title", "author", "excerpt", "article"), found)
        header = {"Title": about["title"], "Description": about["excerpt"], "Author": about["author"], "Published": about["article"]["published_at"], "Site": about["article"]["site_name"], "Language": about["article"]["language"]}
        frame = frame.withColumns({"__header": F.array(*header.values()), "__data": meta.json_ld(F.col("html"))})
        needs += ["__header", "__data"]

    names = tuple(header)

    def make(row: dict) -> tuple:
        found = dom.extract(row["html"] or "", row["url"] or "", fmt)
        content = found["content"]
        if fmt == "llm":
            content = cleanup.model_text(content, {"URL": row["url"] or "", **dict(zip(names, row["__header"]))}, [json.loads(x) for x in row["__data"] or []])
        return content, found["h1"], found["note"]

    fields = [("content", "string", _TEXT), ("h1", "string", _TEXT), ("note", "string", _TEXT)]
    read = _beside(frame.drop("__names"), needs, ["html", "__header", "__data"], fields, make)
    return read.withColumn("content", text.truncate_bytes(F.col("content"), max_bytes) if max_bytes else F.col("content")).withColumn("length", F.octet_length("content"))


def select(pages: DataFrame, selector: str, *attributes: str) -> DataFrame:
    """The elements of pages (page_id, html) that a CSS selector matches, in document order: page_id, pos, tag, text, html, and ``attributes`` (null where an element lacks one)."""
    wanted = css.compiled(selector)

    def make(row):
        for i, n in enumerate(css.Page(dom.parse(row["html"] or "")).select(wanted)):
            yield row["page_id"], i, n.tag, dom.squeeze(n.text), n.html(), *(n.attrs.get(a.lower()) for a in attributes)

    kinds = "page_id bigint, pos int, tag string, text string, html string" + "".join(f", `{a}` string" for a in attributes)
    fields = [("page_id", _LONG), ("pos", _INT), ("tag", _TEXT), ("text", _TEXT), ("html", _TEXT), *((a, _TEXT) for a in attributes)]
    return _bulk(pages, ["page_id", "html"], kinds, fields, make)


def select_beside(pages: DataFrame, **selectors: str) -> DataFrame:
    """``pages`` with an array of texts for each selector, or of an attribute's values where it ends in ``@name``; each page is parsed once."""
    wanted = {k: (css.compiled(x.rpartition("@")[0] if "@" in x else x), x.rpartition("@")[2].lower() if "@" in x else "") for k, x in selectors.items()}

    def make(row):
        page = css.Page(dom.parse(row["html"] or ""))
        return tuple([n.get(a) if a else dom.squeeze(n.text) for n in page.select(x) if not a or a in n.attrs] for x, a in wanted.values())

    return _beside(pages, ["html"], [], [(k, "array<string>", _TEXTS) for k in wanted], make)


def markup_risks(doc: dom.Node) -> tuple[list[str], dict]:
    """Calls of inline scripts that can run or inject code, and what a sanitizer takes from the page."""
    handlers, urls = sanitize.lost(doc)
    return [c for x in dom.inline_scripts(doc) for c in script.calls(x)], {"handlers": handlers, "script_urls": urls}


_RISKS = [("script_calls", "array<string>", _TEXTS), ("xss", "struct<handlers: int, script_urls: int>", pa.struct([("handlers", _INT), ("script_urls", _INT)]))]
_NO_RISKS = ([], {"handlers": 0, "script_urls": 0})


def with_markup_risks(pages: DataFrame) -> DataFrame:
    """``pages`` with ``script_calls`` (names of ``script.CALLS``) and ``xss`` (event handlers and script addresses that a sanitizer takes away).

    Only pages whose markup has a mark of either are parsed.
    """
    rows = pages.withColumn("__risky", F.when(F.col("html").rlike(script.HINT) | F.col("html").rlike(sanitize.HINT), F.col("html")))
    return _beside(rows, ["__risky"], ["__risky"], _RISKS, lambda row: markup_risks(dom.parse(row["__risky"])) if row["__risky"] else _NO_RISKS)


def page_links(pages: DataFrame) -> DataFrame:
    def make(row):
        r = dom.links(dom.parse(row["html"] or ""), row["url"] or "")
        yield row["page_id"], r["internal"], r["external"], r["domains"], r["words"]

    return _bulk(pages, ["page_id", "url", "html"], "page_id bigint, internal int, external int, domains array<string>, words int", [("page_id", _LONG), ("internal", _INT), ("external", _INT), ("domains", _TEXTS), ("words", _INT)], make)


def page_forms(pages: DataFrame) -> DataFrame:
    def make(row):
        for i, f in enumerate(dom.forms(dom.parse(row["html"] or ""))):
            yield row["page_id"], i, f["action"], f["method"], [x["name"] for x in f["fields"]], dom.form_data(f)

    return _bulk(pages, ["page_id", "html"], "page_id bigint, pos int, action string, method string, names array<string>, body string", [("page_id", _LONG), ("pos", _INT), ("action", _TEXT), ("method", _TEXT), ("names", _TEXTS), ("body", _TEXT)], make)


def page_media(pages: DataFrame) -> DataFrame:
    def make(row):
        for i, m in enumerate(dom.media(dom.parse(row["html"] or ""), row["url"] or "")):
            yield row["page_id"], i, m["url"], m["kind"], m["source"], m["title"], m["width"], m["height"]

    fields = [("page_id", _LONG), ("pos", _INT), ("media_url", _TEXT), ("kind", _TEXT), ("source", _TEXT), ("title", _TEXT), ("width", _INT), ("height", _INT)]
    return _bulk(pages, ["page_id", "url", "html"], "page_id bigint, pos int, media_url string, kind string, source string, title string, width int, height int", fields, make)


def accessibility(pages: DataFrame) -> DataFrame:
    def make(row):
        r = dom.accessibility(dom.parse(row["html"] or ""))
        yield row["page_id"], r["lang"], r["images"], r["no_alt"], r["h1"], r["heading_skip"], r["landmarks"], r["inputs"], r["labelled"], r["skip_link"], r["reduced_motion"], r["score"]

    names = ("lang", "images", "no_alt", "h1", "heading_skip", "landmarks", "inputs", "labelled", "skip_link", "reduced_motion", "score")
    kinds = (_TEXT, _INT, _INT, _INT, _BOOL, _INT, _INT, _INT, _BOOL, _BOOL, _INT)
    schema = "page_id bigint, " + ", ".join(f"{n} {'string' if k is _TEXT else 'boolean' if k is _BOOL else 'int'}" for n, k in zip(names, kinds))
    return _bulk(pages, ["page_id", "html"], schema, [("page_id", _LONG), *zip(names, kinds)], make)


def performance(responses: DataFrame) -> DataFrame:
    def make(row):
        r = dom.performance(dom.parse(row["html"] or ""), dict(row["headers"] or {}))
        yield row["page_id"], r["compression"], r["images"], r["lazy"], r["inline_css"], r["http3"], r["modern"], r["legacy"], r["score"]

    fields = [("page_id", _LONG), ("compression", _TEXT), ("images", _INT), ("lazy", _INT), ("inline_css", _INT), ("http3", _BOOL), ("modern", _INT), ("legacy", _INT), ("score", _INT)]
    return _bulk(responses, ["page_id", "html", "headers"], "page_id bigint, compression string, images int, lazy int, inline_css int, http3 boolean, modern int, legacy int, score int", fields, make)


def page_features(pages: DataFrame) -> DataFrame:
    """Fonts, installability, endpoints, agents' tools and script state of pages, as JSON for each."""

    def make(row):
        d = dom.parse(row["html"] or "")
        yield row["page_id"], json.dumps(dom.fonts(d)), json.dumps(dom.progressive(d)), json.dumps(dom.interfaces(d, row["html"] or "")), json.dumps(dom.tools(d)), json.dumps(dom.script_state(d))

    fields = [("page_id", _LONG), ("fonts", _TEXT), ("pwa", _TEXT), ("endpoints", _TEXT), ("tools", _TEXT), ("state", _TEXT)]
    return _bulk(pages, ["page_id", "html"], "page_id bigint, fonts string, pwa string, endpoints string, tools string, state string", fields, make)


def node_scores(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag, score and noise of the candidates for main content."""

    def make(row):
        noise: dict[int, bool] = {}
        for i, n in enumerate(dom.parse(row["html"] or "").walk()):
            if n.tag in dom.CANDIDATES:
                yield row["page_id"], i, n.tag, round(dom.node_score(n), 9), dom.noisy(n, noise)

    return _bulk(pages, ["page_id", "html"], "page_id bigint, pos int, tag string, score double, noise boolean", [("page_id", _LONG), ("pos", _INT), ("tag", _TEXT), ("score", _DOUBLE), ("noise", _BOOL)], make)


def seo(pages: DataFrame) -> DataFrame:
    """page_id and the report of ``dom.seo``, with lists as JSON."""

    def make(row):
        r = dom.seo(dom.parse(row["html"] or ""))
        yield row["page_id"], *(r["og"][k] for k in dom.OG), *(r["twitter"][k] for k in dom.TWITTER), r["canonical"], json.dumps(r["hreflang"]), r["robots"], r["description"], r["keywords"], r["favicon"], [x["type"] for x in r["json_ld"]], [x["raw"] for x in r["json_ld"]]

    names = [*(f"og_{k}" for k in dom.OG), *(f"twitter_{k}" for k in dom.TWITTER), "canonical", "hreflang", "robots", "description", "keywords", "favicon"]
    fields = [("page_id", _LONG), *((n, _TEXT) for n in names), ("ld_types", _TEXTS), ("ld_raw", _TEXTS)]
    schema = "page_id bigint, " + ", ".join(f"{n} string" for n in names) + ", ld_types array<string>, ld_raw array<string>"
    return _bulk(pages, ["page_id", "html"], schema, fields, make)


def media_report(pages: DataFrame) -> DataFrame:
    """page_id, counts of images by format, of srcset and picture, image networks, and videos and audio by platform."""

    def make(row):
        r = dom.media_report(dom.parse(row["html"] or ""))
        yield row["page_id"], r["images"], list(r["formats"].items()), r["srcset"], r["pictures"], r["networks"], r["videos"], r["audio"]

    pairs = pa.map_(_TEXT, _INT)
    fields = [("page_id", _LONG), ("images", _INT), ("formats", pairs), ("srcset", _INT), ("pictures", _INT), ("networks", _TEXTS), ("videos", _TEXTS), ("audio", _TEXTS)]
    return _bulk(pages, ["page_id", "html"], "page_id bigint, images int, formats map<string,int>, srcset int, pictures int, networks array<string>, videos array<string>, audio array<string>", fields, make)


_A11Y = {"lang": _TEXT, "images": _INT, "no_alt": _INT, "h1": _INT, "heading_skip": _BOOL, "landmarks": _INT, "inputs": _INT, "labelled": _INT, "skip_link": _BOOL, "reduced_motion": _BOOL, "score": _INT}
_PERF = {"compression": _TEXT, "images": _INT, "lazy": _INT, "inline_css": _INT, "http3": _BOOL, "legacy": _INT, "hints": _BOOL, "preload": _BOOL, "fonts": _INT, "speculation": _BOOL, "score": _INT}
_SEO = {"description": _TEXT, "og_title": _TEXT, "og_image": _TEXT, "canonical": _TEXT, "linked_data": _INT, "favicon": _TEXT, "card": _TEXT, "robots": _TEXT}


def _kind(t: pa.DataType) -> str:
    return "string" if t is _TEXT else "boolean" if t is _BOOL else "int"


def seo_findings() -> list[Rule]:
    empty = lambda name: F.coalesce(F.col(f"seo.{name}"), F.lit("")) == ""
    return [
        Rule("seo", "description", empty("description"), "high", "no description for search results"), Rule("seo", "og_title", empty("og_title"), "medium", "no title for shared links"),
        Rule("seo", "og_image", empty("og_image"), "medium", "no image for shared links"), Rule("seo", "canonical", F.col("seo.canonical").isNull(), "medium", "no canonical address"),
        Rule("seo", "linked_data", F.col("seo.linked_data") == 0, "low", "no linked data"), Rule("seo", "favicon", F.col("seo.favicon").isNull(), "low", "no icon"),
        Rule("seo", "twitter_card", empty("card"), "low", "no card for short messages"), Rule("seo", "noindex", F.contains(F.col("seo.robots"), F.lit("noindex")), "info", "kept out of search"),
    ]


def performance_findings() -> list[Rule]:
    c = lambda name: F.col(f"speed.{name}")
    percent = F.coalesce(F.floor(c("lazy") * 100 / F.nullif(c("images"), F.lit(0))).cast("int"), F.lit(0))
    cached = F.coalesce(F.try_element_at("headers", F.lit("cache-control")), F.lit("")) != ""
    number = lambda n, what: F.concat(n.cast("string"), F.lit(what))
    return [
        Rule("performance", "compression", c("compression") == "", "high", "sent as it is, not compressed"), Rule("performance", "cache_control", ~cached, "high", "no word on caching"),
        Rule("performance", "lazy_images", (c("images") > 0) & (c("lazy") == 0), "medium", number(c("images"), " images, none of them lazy")), Rule("performance", "hints", ~c("hints"), "medium", "nothing is hinted to the browser"),
        Rule("performance", "inline_css", c("inline_css") > 10_000, "medium", number(c("inline_css"), " bytes of style in the page")), Rule("performance", "http3", ~c("http3"), "low", "third version of the protocol not offered"),
        Rule("performance", "few_lazy", (c("images") > 0) & (percent > 0) & (percent < 50), "low", number(percent, " % of images lazy")), Rule("performance", "speculation", ~c("speculation"), "low", "no rules for rendering ahead"),
        Rule("performance", "font_preload", (c("fonts") == 0) & c("preload"), "medium", "fonts aren't loaded ahead"), Rule("performance", "legacy_images", c("legacy") > 0, "low", number(c("legacy"), " images of old formats")),
    ]


def accessibility_findings() -> list[Rule]:
    c = lambda name: F.col(f"access.{name}")
    number = lambda n, what: F.concat(n.cast("string"), F.lit(what))
    return [
        Rule("accessibility", "lang", c("lang") == "", "high", "language of the page not named"), Rule("accessibility", "alt", c("no_alt") > 0, "high", number(c("no_alt"), " images that nothing describes")),
        Rule("accessibility", "no_h1", c("h1") == 0, "high", "no main heading"), Rule("accessibility", "many_h1", c("h1") > 1, "medium", number(c("h1"), " main headings")),
        Rule("accessibility", "heading_skip", c("heading_skip"), "medium", "a level of headings is left out"), Rule("accessibility", "landmarks", c("landmarks") == 0, "medium", "no regions to jump to"),
        Rule("accessibility", "labels", (c("inputs") > 0) & (c("labelled") < c("inputs")), "medium", number(c("inputs") - c("labelled"), " fields that nothing names")),
        Rule("accessibility", "skip_link", ~c("skip_link"), "medium", "no link past the navigation"), Rule("accessibility", "reduced_motion", ~c("reduced_motion"), "low", "wish for less motion not heeded"),
    ]


def audit(responses: DataFrame) -> DataFrame:
    """Scores of the four categories, the overall one and its grade, and ``issues``, the findings of all categories, of every row of ``responses``.

    Each page is parsed once, for all its reports; the rest is column
    expressions over the same row. Of the security findings those on headers,
    cross-origin requests, cookies and redirects count as issues.
    """
    from . import security

    def make(row: dict) -> tuple:
        doc = dom.parse(row["html"] or "")
        a, p, s = dom.accessibility(doc), dom.performance(doc, dict(row["headers"] or {})), dom.seo(doc)
        p["hints"] = p["preload"] or p["preconnect"] or p["prefetch"]
        found = {"description": s["description"], "og_title": s["og"]["title"], "og_image": s["og"]["image"], "canonical": s["canonical"], "linked_data": len(s["json_ld"]), "favicon": s["favicon"], "card": s["twitter"]["card"], "robots": s["robots"]}
        return {k: a[k] for k in _A11Y}, {k: p[k] for k in _PERF}, found, *markup_risks(doc)

    struct = lambda of: (f"struct<{','.join(f'{k}:{_kind(t)}' for k, t in of.items())}>", pa.struct(list(of.items())))
    fields = [*((name, *struct(of)) for name, of in (("access", _A11Y), ("speed", _PERF), ("seo", _SEO))), *_RISKS]
    parsed = _beside(responses, ["html", "headers"], [], fields, make)
    points = {"seo_points": meta.seo_score(F.col("html")), "accessibility": F.col("access.score"), "performance": F.col("speed.score")}
    scanned = security.scan(parsed.withColumns(points))
    own = F.concat(*(F.col(f"{k}_findings") for k in ("header", "cors", "cookie", "redirect")))
    issues = F.concat(report(seo_findings()), report(performance_findings()), report(accessibility_findings()), own)
    rows = scanned.select("page_id", F.col("score").alias("security"), F.col("seo_points").alias("seo"), "accessibility", "performance", issues.alias("issues"))
    overall = meta.overall(*(F.least(F.col(c), F.lit(100)) for c in ("seo", "performance", "accessibility", "security")))
    return rows.withColumn("overall", overall).withColumn("grade", meta.audit_grade(F.col("overall")))


def top_issues(audited: DataFrame, n: int = 10) -> DataFrame:
    """The n worst issues of each row of an audit, in the order of categories and checks within a severity."""
    worst = F.array_sort(F.transform("issues", lambda f, i: F.struct(rank(f["severity"]).alias("rank"), i.alias("pos"), f.alias("f"))))
    flat = audited.select("page_id", F.posexplode(F.slice(worst, 1, n)).alias("place", "x"))
    return flat.select("page_id", (F.col("place") + 1).alias("place"), "x.rank", "x.f.category", "x.f.check", "x.f.severity")

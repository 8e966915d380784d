"""Queries on parsed pages and cleaned texts; SQL only where the data lets it say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import meta
from ..operators import cleanup, pages, technology
from ..sources.tables import load, responses
from .security_plans import COOKIE_FINDINGS, CORS_FINDINGS, HEADER_FINDINGS, REDIRECT_FINDINGS, SCORE, findings_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rows(spark, sf_dir):
    return load(spark, sf_dir, "pages")


@query("e06_e10_node_scores")
def e10(spark, sf_dir):
    return pages.node_scores(rows(spark, sf_dir))


# What the tables' pages hold: an article of one heading, a first paragraph in bold that stays open, and paragraphs; three entities.
ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
PLAIN = r"replace(replace({}, '&quot;', chr(34)), '&amp;', '&')"
SPACED = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"
TITLE = "trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))"


@query("e25_read_text", f"SELECT page_id, {SPACED.format(PLAIN.format(f"regexp_replace({ARTICLE}, '<[^>]*>', '', 'g')"))} AS content FROM pages")
def e25(spark, sf_dir):
    return pages.read_pages(rows(spark, sf_dir), info=()).select("page_id", "content")


MARKDOWN = f"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({ARTICLE}, '<b>', '**'), '<br><p>', '**' || chr(1)), '</p><p>', chr(1)), '</h1><p>', chr(1)), '<h1>', '# '), '</p>', ''), '<br>$', '**'), '[ \\t\\n]+', ' ', 'g'), ' ?' || chr(1) || ' ?', chr(10) || chr(10), 'g')"""
HEADING = SPACED.format(PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))


@query("e23_read_markdown", f"SELECT page_id, {TITLE} AS title, md, regexp_replace({HEADING}, '[^\\p{{L}}\\p{{N}}_)\\]!?.]+$', '') AS h1, NULL AS note, strlen(md)::INTEGER AS length FROM (SELECT *, {PLAIN.format(MARKDOWN)} AS md FROM pages)".replace(" md, ", " md AS content, ", 1))
def e23(spark, sf_dir):
    return pages.read_pages(rows(spark, sf_dir), "markdown", info=("title",)).select("page_id", "title", "content", "h1", "note", "length")


@query("e37_read_llm")
def e37(spark, sf_dir):
    return pages.read_pages(rows(spark, sf_dir), "llm", max_bytes=20_000, info=("title", "needs_scripts")).select("page_id", "title", "content", "note", "length", "needs_scripts")


@query("e12_read_html", f"SELECT page_id, md5(h) AS digest, strlen(h)::INTEGER AS length FROM (SELECT page_id, '<article>' || replace(regexp_replace(replace({ARTICLE}, '<br><p>', '<br></b></p><p>'), '<br>$', '<br></b></p>'), '&quot;', chr(34)) || '</article>' AS h FROM pages)")
def e12(spark, sf_dir):
    return pages.read_pages(rows(spark, sf_dir), "html", info=()).select("page_id", F.md5("content").alias("digest"), "length")


@query("e38_i07_links", """SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref="([^"]*)"', 1))::INTEGER AS internal, (page_id % 3)::INTEGER AS external FROM pages""")
def i07(spark, sf_dir):
    away = F.concat("html", F.repeat(F.lit('<a href="https://away.example.org/x">x</a>'), (F.col("page_id") % 3).cast("int")))
    return pages.page_links(rows(spark, sf_dir).withColumn("html", away)).select("page_id", "internal", "external")


@query("e39_forms", """
SELECT page_id, k::INTEGER AS pos, '/s' || (page_id + k)::VARCHAR AS action, CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN page_id % 2 = 0 THEN 'q=v+' || page_id::VARCHAR ELSE 'q=v+' || page_id::VARCHAR || '&off=' END AS body
FROM pages, (VALUES (0), (1)) AS t(k) WHERE k < page_id % 3""")
def e39(spark, sf_dir):
    """Pages with as many forms as page_id leaves over by three; a field is disabled on every other page."""
    i = F.col("page_id")
    form = lambda k: F.concat(F.lit('<form action="/s'), (i + k).cast("string"), F.when(i % 2 == 0, '" method="post">').otherwise('">'), F.lit('<input name="q" value="v '), i.cast("string"), F.when(i % 2 == 0, '"><input name="off" disabled>').otherwise('"><input name="off">'), F.lit("</form>"))
    more = F.when(i % 3 == 1, form(0)).when(i % 3 == 2, F.concat(form(0), form(1))).otherwise("")
    return pages.page_forms(rows(spark, sf_dir).withColumn("html", F.concat("html", more))).select("page_id", "pos", "action", "method", "body")


@query("m01_m02_media", """
SELECT page_id, 0 AS pos, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/p' || page_id::VARCHAR || '.jpg' AS media_url, 'image' AS kind FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END, 'https://v.example/' || page_id::VARCHAR || '.mp4', 'video' FROM pages WHERE page_id % 3 = 0""")
def m01(spark, sf_dir):
    i = F.col("page_id")
    image = F.when(i % 2 == 0, F.concat(F.lit('<img src="/p'), i.cast("string"), F.lit('.jpg" width="640" height="480"><img src="/logo.png">'))).otherwise("")
    video = F.when(i % 3 == 0, F.concat(F.lit('<video src="https://v.example/'), i.cast("string"), F.lit('.mp4"></video>'))).otherwise("")
    return pages.page_media(rows(spark, sf_dir).withColumn("html", F.concat("html", image, video))).select("page_id", "pos", "media_url", "kind")


@query("i05_i06_accessibility", """
SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<h1'))::INTEGER AS h1,
       (CASE WHEN contains(html, 'lang="') THEN 20 ELSE 0 END + 20 + CASE WHEN len(regexp_extract_all(html, '<h1')) = 1 THEN 15 ELSE 0 END + CASE WHEN contains(html, '<h1') THEN 10 ELSE 0 END + CASE WHEN contains(html, '<nav') THEN 10 ELSE 0 END + 10)::INTEGER AS score FROM pages""")
def i06(spark, sf_dir):
    return pages.accessibility(rows(spark, sf_dir)).select("page_id", "lang", "h1", "score")


@query("i03_i04_performance", """
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'gzip' WHEN 2 THEN 'br' WHEN 3 THEN 'zstd' ELSE '' END AS compression,
       (CASE WHEN page_id % 5 IN (1, 2, 3) THEN 15 ELSE 0 END + CASE WHEN page_id % 4 IN (1, 2) THEN 12 ELSE 0 END + CASE WHEN page_id % 6 = 1 THEN 5 ELSE 0 END + 8 + 5 + 7)::INTEGER AS score FROM pages""")
def i04(spark, sf_dir):
    return pages.performance(responses(rows(spark, sf_dir))).select("page_id", "compression", "score")


@query("i09_i13_features", """
SELECT page_id, '{"google": [' || CASE WHEN page_id % 2 = 0 THEN '"F' || page_id::VARCHAR || '"' ELSE '' END || '], "adobe": false, "faces": []}' AS fonts,
       CASE WHEN page_id % 3 = 0 THEN '{"manifest": true, "service_worker": false, "installable": false}' ELSE '{"manifest": false, "service_worker": false, "installable": false}' END AS pwa,
       CASE WHEN page_id % 5 = 0 THEN '{"declared": [{"name": "t' || page_id::VARCHAR || '", "description": "d", "fields": ["a"]}], "registered": false}' ELSE '{"declared": [], "registered": false}' END AS tools FROM pages""")
def i09(spark, sf_dir):
    i = F.col("page_id")
    n = i.cast("string")
    more = F.concat(
        F.when(i % 2 == 0, F.concat(F.lit('<link rel="stylesheet" href="https://fonts.googleapis.com/css?family=F'), n, F.lit('">'))).otherwise(""), F.when(i % 3 == 0, '<link rel="manifest" href="/m">').otherwise(""),
        F.when(i % 5 == 0, F.concat(F.lit('<form toolname="t'), n, F.lit('" tooldescription="d"><input name="a"></form>'))).otherwise(""),
    )
    return pages.page_features(rows(spark, sf_dir).withColumn("html", F.concat("html", more))).select("page_id", "fonts", "pwa", "tools")


A11Y_SCORE = "(CASE WHEN contains(html, 'lang=\"') THEN 20 ELSE 0 END + 20 + CASE WHEN len(regexp_extract_all(html, '<h1')) = 1 THEN 15 ELSE 0 END + CASE WHEN contains(html, '<h1') THEN 10 ELSE 0 END + CASE WHEN contains(html, '<nav') THEN 10 ELSE 0 END + 10)"
SPEED_SCORE = "(CASE WHEN page_id % 5 IN (1, 2, 3) THEN 15 ELSE 0 END + CASE WHEN page_id % 4 IN (1, 2) THEN 12 ELSE 0 END + CASE WHEN page_id % 6 = 1 THEN 5 ELSE 0 END + 8 + 5 + 7)"


@query("i16_site_audit", f"""{SCORE}, a AS (SELECT p.page_id, score AS security, 0 AS seo, {A11Y_SCORE}::INTEGER AS accessibility, {SPEED_SCORE}::INTEGER AS performance FROM pages p JOIN t ON t.page_id = p.page_id)
SELECT *, CASE {" ".join(f"WHEN overall >= {low} THEN '{name}'" for low, name in meta.AUDIT_BANDS)} ELSE 'F' END AS grade
FROM (SELECT page_id, security, seo, accessibility, performance, ((least(security, 100) + seo + accessibility + performance) // 4)::INTEGER AS overall FROM a)""".replace("p.page_id % ", "page_id % ").replace("page_id % 5 IN", "p.page_id % 5 IN").replace("page_id % 4 IN (1, 2) THEN 12", "p.page_id % 4 IN (1, 2) THEN 12").replace("page_id % 6 = 1 THEN 5 ELSE 0 END + 8", "p.page_id % 6 = 1 THEN 5 ELSE 0 END + 8"))
def i16(spark, sf_dir):
    return pages.audit(responses(rows(spark, sf_dir))).drop("issues")


@query("i16_findings", """
WITH f AS (
  SELECT page_id, unnest(list_filter([
    {'category': 'seo', 'check': 'description', 'severity': 'high', 'ok': true}, {'category': 'seo', 'check': 'og_title', 'severity': 'medium', 'ok': true}, {'category': 'seo', 'check': 'og_image', 'severity': 'medium', 'ok': true},
    {'category': 'seo', 'check': 'canonical', 'severity': 'medium', 'ok': true}, {'category': 'seo', 'check': 'linked_data', 'severity': 'low', 'ok': true}, {'category': 'seo', 'check': 'favicon', 'severity': 'low', 'ok': true},
    {'category': 'seo', 'check': 'twitter_card', 'severity': 'low', 'ok': true},
    {'category': 'performance', 'check': 'compression', 'severity': 'high', 'ok': page_id % 5 IN (0, 4)}, {'category': 'performance', 'check': 'cache_control', 'severity': 'high', 'ok': page_id % 4 IN (0, 3)},
    {'category': 'performance', 'check': 'lazy_images', 'severity': 'medium', 'ok': page_id % 3 = 1}, {'category': 'performance', 'check': 'hints', 'severity': 'medium', 'ok': true}, {'category': 'performance', 'check': 'http3', 'severity': 'low', 'ok': page_id % 6 <> 1},
    {'category': 'performance', 'check': 'few_lazy', 'severity': 'low', 'ok': page_id % 3 = 2}, {'category': 'performance', 'check': 'speculation', 'severity': 'low', 'ok': true}, {'category': 'performance', 'check': 'legacy_images', 'severity': 'low', 'ok': page_id % 3 = 2},
    {'category': 'accessibility', 'check': 'alt', 'severity': 'high', 'ok': page_id % 3 = 2}, {'category': 'accessibility', 'check': 'many_h1', 'severity': 'medium', 'ok': page_id % 3 = 1}, {'category': 'accessibility', 'check': 'heading_skip', 'severity': 'medium', 'ok': page_id % 3 = 2},
    {'category': 'accessibility', 'check': 'labels', 'severity': 'medium', 'ok': page_id % 3 = 1}, {'category': 'accessibility', 'check': 'skip_link', 'severity': 'medium', 'ok': page_id % 3 <> 2}, {'category': 'accessibility', 'check': 'reduced_motion', 'severity': 'low', 'ok': true}
  ], lambda x: x.ok)) AS x FROM pages)
SELECT page_id, x.category AS category, x.check AS "check", x.severity AS severity FROM f""")
def i16b(spark, sf_dir):
    """Findings of three categories on pages with more in their bodies, by page_id."""
    more = F.when(F.col("page_id") % 3 == 1, F.lit('<h1>Second</h1><img src="/a.webp" alt="A"><form><input name="q"></form>')).when(F.col("page_id") % 3 == 2, F.lit('<a href="#main">Skip</a><h4>Deep</h4><img src="/a.png" alt="A" loading="lazy"><img src="/b.gif" alt="B"><img src="/c.webp">')).otherwise("")
    fuller = rows(spark, sf_dir).withColumn("html", F.concat("html", more))
    flat = pages.audit(responses(fuller)).select("page_id", F.inline("issues"))
    return flat.where("category in ('seo', 'performance', 'accessibility')").select("page_id", "category", "check", "severity")


PAGE_FINDINGS = [
    ("seo", "description", "'high'"), ("seo", "og_title", "'medium'"), ("seo", "og_image", "'medium'"), ("seo", "canonical", "'medium'"), ("seo", "linked_data", "'low'"), ("seo", "favicon", "'low'"), ("seo", "twitter_card", "'low'"),
    ("performance", "compression", "CASE WHEN page_id % 5 IN (0, 4) THEN 'high' END"), ("performance", "cache_control", "CASE WHEN page_id % 4 IN (0, 3) THEN 'high' END"), ("performance", "hints", "'medium'"),
    ("performance", "http3", "CASE WHEN page_id % 6 <> 1 THEN 'low' END"), ("performance", "speculation", "'low'"), ("accessibility", "skip_link", "'medium'"), ("accessibility", "reduced_motion", "'low'"),
]
ISSUES = [*PAGE_FINDINGS, *HEADER_FINDINGS, *CORS_FINDINGS, *COOKIE_FINDINGS, *REDIRECT_FINDINGS]


@query("i18_audit_issues", f"""
SELECT page_id, place, category, "check", severity, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, pos) AS place
  FROM (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS rank FROM ({findings_sql(ISSUES)}))) WHERE place <= 10""")
def i18(spark, sf_dir):
    return pages.top_issues(pages.audit(responses(rows(spark, sf_dir))))


@query("i15_technologies", """
SELECT page_id, CASE page_id % 5 WHEN 2 THEN 'Cloudflare' WHEN 3 THEN 'Apache' ELSE 'nginx' END AS name, CASE page_id % 5 WHEN 2 THEN 'CDN' ELSE 'Web Server' END AS category, 50 AS confidence FROM pages WHERE page_id % 5 < 4
UNION ALL SELECT page_id, 'PHP', 'Programming Language', 50 FROM pages WHERE page_id % 9 = 4 UNION ALL SELECT page_id, 'Django', 'Web Framework', 50 FROM pages WHERE page_id % 4 = 1""")
def i15(spark, sf_dir):
    return technology.detect(responses(rows(spark, sf_dir)))


@query("l01_l31_clean_text")
def l31(spark, sf_dir):
    return cleanup.clean_documents(load(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("digest"), "n_links")


@query("l01_entities", "SELECT doc_id, md5(text) AS digest FROM documents")
def l01(spark, sf_dir):
    escaped = load(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("text"))
    return cleanup.clean_documents(escaped, step="decode_entities").select("doc_id", F.md5("text").alias("digest"))


@query("l12_ui_controls", "SELECT doc_id, md5(text) AS digest FROM documents")
def l12(spark, sf_dir):
    led = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("chevron_left 1 2 chevron_right\n"), "text", F.lit("\n← previous")).alias("text"))
    return cleanup.clean_documents(led, step="strip_ui_controls").select("doc_id", F.md5("text").alias("digest"))


@query("l17_links", "SELECT doc_id, md5('see Docs: ' || text) AS digest FROM documents")
def l17(spark, sf_dir):
    led = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see [Docs](https://d.example/"), "doc_id", F.lit("): "), "text").alias("text"))
    return cleanup.clean_documents(led, step="extract_links").select("doc_id", F.md5("text").alias("digest"))

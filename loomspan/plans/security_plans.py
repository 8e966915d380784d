"""Queries on responses derived from pages: security checks, scores, grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import meta
from ..functions.findings import rank
from ..operators import pages, protection
from ..operators import security as S
from ..sources.tables import load, responses, responses_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
BASE = f"WITH r AS ({responses_sql()})"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rows(spark, sf_dir):
    return responses(load(spark, sf_dir, "pages"))


HSTS_AGE = "coalesce(try_cast(regexp_extract(h_strict_transport_security, 'max-age=([0-9]+)', 1) AS BIGINT), 0)"
CSP_SCORE = """CASE page_id % 7 WHEN 0 THEN -25 WHEN 1 THEN -20 WHEN 2 THEN 10 WHEN 3 THEN -10 WHEN 4 THEN -20 WHEN 5 THEN -20 ELSE 5 END"""
COOKIE_SCORE = """CASE WHEN cookie IS NULL THEN 0 WHEN cookie LIKE 'PHPSESSID%' THEN -40 WHEN cookie LIKE 'auth_token%' THEN -30 WHEN cookie LIKE '_ga%' THEN -20 WHEN cookie LIKE 'sessionid%' THEN 5 WHEN contains(cookie, 'SameSite') THEN 5 WHEN cookie LIKE 'csrftoken%' THEN 0 ELSE 0 END"""
CORS_SCORE = "CASE WHEN h_access_control_allow_origin = '*' THEN -50 WHEN h_access_control_allow_origin IS NOT NULL AND lower(h_access_control_allow_credentials) = 'true' THEN -20 ELSE 0 END"
DISCLOSURE = "(CASE WHEN h_x_powered_by IS NOT NULL THEN -5 ELSE 0 END + CASE WHEN regexp_matches(h_server, '^[^/]*/[0-9]') THEN -5 ELSE 0 END)"


@query("s01_hsts", f"""{BASE} SELECT page_id,
  CASE WHEN h_strict_transport_security IS NULL THEN 'high' WHEN {HSTS_AGE} < 15768000 THEN 'medium' WHEN contains(lower(h_strict_transport_security), 'preload') AND contains(lower(h_strict_transport_security), 'includesubdomains') AND {HSTS_AGE} >= 31536000 THEN 'info'
       WHEN contains(lower(h_strict_transport_security), 'preload') THEN 'low' ELSE 'info' END AS severity FROM r""")
def s01_hsts(spark, sf_dir):
    found = S.report(S.header_rules())
    return rows(spark, sf_dir).select("page_id", F.filter(found, lambda f: f["check"] == "strict-transport-security")[0]["severity"].alias("severity"))


@query("s01_s02_headers", f"""{BASE} SELECT page_id,
  (h_x_content_type_options IS NULL OR lower(h_x_content_type_options) <> 'nosniff')::INTEGER + (h_x_frame_options IS NULL)::INTEGER + (h_permissions_policy IS NULL)::INTEGER
    + (h_strict_transport_security IS NOT NULL AND {HSTS_AGE} < 15768000)::INTEGER + (cookie IS NOT NULL AND (h_cache_control IS NULL OR NOT contains(h_cache_control, 'no-store')))::INTEGER
    + (h_www_authenticate IS NOT NULL AND url LIKE 'https%')::INTEGER AS medium,
  (h_strict_transport_security IS NULL)::INTEGER + (h_content_security_policy IS NULL)::INTEGER + (h_www_authenticate IS NOT NULL AND url NOT LIKE 'https%')::INTEGER AS high FROM r""")
def s01(spark, sf_dir):
    found = rows(spark, sf_dir).select("page_id", S.report(S.header_rules()).alias("f"))
    count = lambda s: F.size(F.filter("f", lambda f: f["severity"] == s))
    return found.select("page_id", count("medium").alias("medium"), count("high").alias("high"))


@query("s03_s05_csp", f"{BASE} SELECT page_id, {CSP_SCORE} AS score, CASE WHEN {CSP_SCORE} >= 5 THEN 'A' WHEN {CSP_SCORE} >= 0 THEN 'B' WHEN {CSP_SCORE} >= -10 THEN 'C' WHEN {CSP_SCORE} >= -24 THEN 'D' ELSE 'F' END AS grade FROM r")
def s05(spark, sf_dir):
    score = S.csp_score(S.header("content-security-policy"))
    return rows(spark, sf_dir).select("page_id", score.alias("score"), S.csp_grade(score).alias("grade"))


@query("s04_csp_findings", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 0 WHEN 3 THEN 7 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 4 END AS n FROM pages""")
def s04(spark, sf_dir):
    return rows(spark, sf_dir).select("page_id", F.size(S.csp_findings(S.header("content-security-policy"))).alias("n"))


@query("s06_cookies", f"{BASE} SELECT page_id, {COOKIE_SCORE} AS score, CASE WHEN cookie LIKE 'PHPSESSID%' THEN 2 WHEN cookie LIKE 'auth_token%' THEN 2 WHEN cookie LIKE 'csrftoken%' THEN 1 ELSE 0 END AS n_findings FROM r")
def s06(spark, sf_dir):
    cookies = F.transform("set_cookies", S.cookie)
    return rows(spark, sf_dir).withColumn("c", cookies).select("page_id", S.cookie_score(F.col("c")).alias("score"), F.size(S.cookie_findings(F.col("c"), S.urls.host(F.col("url")))).alias("n_findings"))


@query("s07_cors", f"{BASE} SELECT page_id, {CORS_SCORE} AS score FROM r")
def s07(spark, sf_dir):
    return rows(spark, sf_dir).select("page_id", S.cors()[1].alias("score"))


@query("s08_s09_resources", """
SELECT page_id, CASE page_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n, CASE page_id % 4 WHEN 1 THEN 5 WHEN 2 THEN -5 WHEN 3 THEN -50 ELSE 0 END AS sri, CASE WHEN page_id % 4 = 2 THEN 2 WHEN page_id % 4 = 0 THEN 0 ELSE 1 END AS supply FROM pages""")
def s08(spark, sf_dir):
    """Scripts of other hosts by page_id: checked, one of two checked and one from a host at risk, unchecked and unencrypted, none."""
    i = F.col("page_id")
    checked = '<script src="https://a.other.test/x.js" integrity="sha384-x"></script>'
    more = F.when(i % 4 == 1, checked).when(i % 4 == 2, checked + '<script src="https://cdn.polyfill.io/v2.js"></script>').when(i % 4 == 3, '<script src="http://b.other.test/y.js"></script>').otherwise("")
    r = rows(spark, sf_dir).withColumn("html", F.concat("html", more)).withColumn("r", S.resources())
    return r.select("page_id", F.size(F.filter("r", lambda x: x["cross"])).alias("n"), S.sri(F.col("r"))[1].alias("sri"), F.size(S.report(S.supply_chain(F.col("r")))).alias("supply"))


@query("s10_mixed_content", """SELECT page_id, (url LIKE 'https://%' AND regexp_matches(html, '(?is)<img\\b[^>]*\\ssrc\\s*=\\s*["'']http://'))::INTEGER AS n FROM pages""")
def s10(spark, sf_dir):
    return rows(spark, sf_dir).select("page_id", F.size(S.report(S.mixed_rules())).alias("n"))


@query("s11_disclosure", f"{BASE} SELECT page_id, greatest({DISCLOSURE}, -30) AS modifier FROM r")
def s11(spark, sf_dir):
    return rows(spark, sf_dir).select("page_id", S.penalty(S.report(S.disclosure_rules()), -30).alias("modifier"))


@query("s12_s15_body", r"""SELECT page_id, (len(list_filter(regexp_extract_all(html, '<!--((?s:.*?))-->', 1), lambda c: regexp_matches(c, '(?i)\b(TODO|FIXME|HACK|BUG|XXX)\b|(password|secret|api_key|token)\s*='))) > 0)::INTEGER AS n FROM pages""")
def s12(spark, sf_dir):
    return pages.with_markup_risks(rows(spark, sf_dir)).select("page_id", F.size(S.report(S.body_rules())).alias("n"))


@query("s18_redirect", "SELECT page_id, CASE WHEN url LIKE 'http://%' THEN -30 ELSE 0 END AS modifier FROM pages")
def s18(spark, sf_dir):
    chain = F.array(F.concat(F.lit("https://"), F.regexp_replace("url", "^[a-z]+://", "")), F.col("url"))
    return rows(spark, sf_dir).select("page_id", S.redirect(chain)[1].alias("modifier"))


@query("s19_protection", f"""{BASE} SELECT page_id, 'Cloudflare' AS name, 'waf' AS category, 60 AS confidence FROM r WHERE h_server = 'cloudflare' UNION ALL SELECT page_id, 'nginx', 'server', 30 FROM r WHERE h_server LIKE 'nginx%'""")
def s19(spark, sf_dir):
    return protection.detections(protection.with_protection(rows(spark, sf_dir))).select("page_id", "name", "category", "confidence")


SCORE = f"""{BASE}, p AS (SELECT page_id,
  greatest(0, 50 - CASE WHEN h_strict_transport_security IS NULL THEN 15 WHEN {HSTS_AGE} < 15768000 THEN 5 ELSE 0 END - CASE WHEN h_x_content_type_options IS NULL THEN 3 ELSE 0 END - CASE WHEN h_x_frame_options IS NULL THEN 10 ELSE 0 END
    - CASE WHEN h_referrer_policy IS NULL THEN 3 ELSE 0 END - CASE WHEN h_content_security_policy IS NULL THEN 15 ELSE 0 END) AS hp,
  greatest(0, 20 + greatest(0, least(30, trunc((({CSP_SCORE}) + 25) * 30 / 35.0)::INTEGER)) + greatest(-10, least(0, {COOKIE_SCORE})) + greatest(-10, least(0, {CORS_SCORE})) + greatest(-5, least(0, {DISCLOSURE}))
    + CASE WHEN url LIKE 'http://%' THEN -5 ELSE 0 END) AS qp,
  CASE WHEN h_referrer_policy = 'no-referrer' THEN 5 ELSE 0 END + CASE WHEN contains(h_strict_transport_security, 'preload') AND contains(lower(h_strict_transport_security), 'includesubdomains') AND {HSTS_AGE} >= 31536000 THEN 5 ELSE 0 END AS bonus FROM r),
t AS (SELECT page_id, (CASE WHEN hp + qp >= 90 THEN hp + qp + bonus ELSE hp + qp END)::INTEGER AS score FROM p)"""
GRADE = "CASE " + " ".join(f"WHEN score >= {low} THEN '{name}'" for low, name in S.GRADES) + " ELSE 'F' END"


@query("s20_s21_score", f"{SCORE} SELECT page_id, score, {GRADE} AS grade FROM t")
def s20(spark, sf_dir):
    return S.scan(rows(spark, sf_dir)).select("page_id", "score", "grade")


#: Findings in order: category, check, and the severity a page of the derived responses has (null: no finding), written out by remainders of page_id.
_H = "CASE WHEN {} THEN 'high' END"
_M = "CASE WHEN {} THEN 'medium' END"
HEADER_FINDINGS = [
    ("headers", "strict-transport-security", "CASE page_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"), ("headers", "content-security-policy", "CASE WHEN page_id % 7 = 0 THEN 'high' ELSE 'info' END"),
    ("headers", "x-content-type-options", "CASE WHEN page_id % 3 = 1 THEN 'info' ELSE 'medium' END"), ("headers", "x-frame-options", "CASE page_id % 4 WHEN 0 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"),
    ("headers", "referrer-policy", "CASE WHEN page_id % 3 = 1 THEN 'info' ELSE 'low' END"), ("headers", "permissions-policy", "CASE WHEN page_id % 2 = 1 THEN 'info' ELSE 'medium' END"),
    ("headers", "cross-origin-opener-policy", "CASE WHEN page_id % 6 = 1 THEN 'info' ELSE 'low' END"), ("headers", "cross-origin-embedder-policy", "CASE WHEN page_id % 6 = 2 THEN 'info' ELSE 'low' END"),
    ("headers", "cross-origin-resource-policy", "CASE WHEN page_id % 6 = 3 THEN 'info' ELSE 'low' END"), ("headers", "x-xss-protection", "CASE WHEN page_id % 7 = 2 THEN 'low' ELSE 'info' END"),
    ("headers", "reporting-endpoints", "'info'"), ("headers", "nel", "'info'"), ("headers", "x-permitted-cross-domain-policies", "CASE WHEN page_id % 5 = 1 THEN 'info' ELSE 'low' END"),
    ("headers", "x-dns-prefetch-control", "CASE WHEN page_id % 5 = 2 THEN 'low' ELSE 'info' END"), ("headers", "cache-control", "CASE WHEN page_id % 6 <> 0 AND page_id % 4 <> 1 THEN 'medium' ELSE 'info' END"), ("headers", "clear-site-data", "'info'"),
    ("headers", "content-type", "CASE WHEN page_id % 3 = 0 THEN 'low' END"), ("headers", "www-authenticate", "CASE WHEN page_id % 25 = 3 THEN CASE WHEN url LIKE 'https%' THEN 'medium' ELSE 'high' END END"),
]
CSP_FINDINGS = [
    ("csp", "content-security-policy", _H.format("page_id % 7 = 0")), ("csp", "unsafe-inline", _H.format("page_id % 7 = 1")), ("csp", "unsafe-eval", _M.format("page_id % 7 = 3")), ("csp", "broad-source", _H.format("page_id % 7 IN (4, 5)")),
    ("csp", "strict-dynamic", _H.format("page_id % 7 = 6")), ("csp", "http-scheme", _M.format("page_id % 7 = 5")), ("csp", "object-src", _M.format("page_id % 7 IN (1, 3, 4, 6)")), ("csp", "base-uri", _M.format("page_id % 7 IN (1, 3, 4, 5)")),
    ("csp", "form-action", _M.format("page_id % 7 IN (1, 3, 4, 5, 6)")), ("csp", "frame-ancestors", "CASE WHEN page_id % 7 IN (1, 3, 4, 5, 6) THEN 'low' END"), ("csp", "wildcard default-src", _M.format("page_id % 7 = 5")),
    ("csp", "jsonp", _H.format("page_id % 7 = 3")), ("csp", "report-uri", "CASE WHEN page_id % 7 = 3 THEN 'low' END"),
]
COOKIE_FINDINGS = [("cookies", "secure", "CASE WHEN page_id % 6 = 2 THEN 'critical' END"), ("cookies", "httponly", _H.format("page_id % 6 IN (2, 3)")), ("cookies", "csrf", _M.format("page_id % 6 IN (3, 5)"))]
CORS_FINDINGS = [("cors", "wildcard", "CASE WHEN page_id % 8 IN (1, 3) THEN 'critical' END"), ("cors", "wildcard-credentials", "CASE WHEN page_id % 8 = 1 THEN 'critical' END"), ("cors", "origin-credentials", _H.format("page_id % 8 = 2"))]
DISCLOSURE_FINDINGS = [("disclosure", "x-powered-by", _M.format("page_id % 9 = 4")), ("disclosure", "server", _M.format("page_id % 5 IN (1, 3)"))]
BODY_FINDINGS = [("body", "suspicious_comment", _M.format(r"len(list_filter(regexp_extract_all(html, '<!--((?s:.*?))-->', 1), lambda c: regexp_matches(c, '(?i)\b(TODO|FIXME|HACK|BUG|XXX)\b|(password|secret|api_key|token)\s*='))) > 0"))]
REDIRECT_FINDINGS = [("redirect", "http", _H.format("url LIKE 'http://%'"))]


def findings_sql(findings: list[tuple[str, str, str]]) -> str:
    """page_id, pos, category, check, severity of the findings that a page has."""
    parts = ", ".join(f"{{'pos': {i}, 'category': '{a}', 'check': '{b}', 'severity': {c}}}" for i, (a, b, c) in enumerate(findings))
    return f"""SELECT page_id, x.pos AS pos, x.category AS category, x."check" AS "check", x.severity AS severity FROM (SELECT page_id, unnest([{parts}]) AS x FROM pages) WHERE x.severity IS NOT NULL"""


SCANNED = [*HEADER_FINDINGS, *CSP_FINDINGS, *COOKIE_FINDINGS, *CORS_FINDINGS, *DISCLOSURE_FINDINGS, *BODY_FINDINGS, *REDIRECT_FINDINGS]


@query("s22_histogram", f"""{SCORE}, f AS ({findings_sql(SCANNED)}) SELECT {GRADE} AS grade, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM f JOIN t ON f.page_id = t.page_id GROUP BY 1""")
def s22(spark, sf_dir):
    return S.scan(rows(spark, sf_dir)).groupBy(F.col("grade")).agg(*(F.sum(f"counts.{s}").alias(s) for s in ("critical", "high", "medium", "low", "info", "total")))


@query("s23_scan", f"""SELECT page_id, category, "check", severity FROM ({findings_sql(SCANNED)})""")
def s23(spark, sf_dir):
    return S.scan(rows(spark, sf_dir)).select("page_id", F.inline("findings")).drop("detail")


@query("s24_challenge", f"{BASE} SELECT page_id, CASE WHEN h_server = 'cloudflare' THEN CASE WHEN status IN (403, 503) AND contains(lower(html), 'cf-turnstile') THEN 'turnstile' END END AS kind FROM r")
def s24(spark, sf_dir):
    return rows(spark, sf_dir).select("page_id", S.challenge_kind(F.col("html")).alias("kind"))


@query("s25_response_quality", f"{BASE} SELECT page_id, CASE WHEN status IN (401, 403, 429, 503) THEN 'status_' || status::VARCHAR END AS reason FROM r")
def s25(spark, sf_dir):
    return rows(spark, sf_dir).select("page_id", S.response_quality(F.col("html")).alias("reason"))


@query("i17_overall", f"""{SCORE} SELECT page_id, o AS overall, CASE {" ".join(f"WHEN o >= {low} THEN '{name}'" for low, name in meta.AUDIT_BANDS)} ELSE 'F' END AS grade FROM (SELECT page_id, ((0 + 50 + 50 + score) // 4)::INTEGER AS o FROM t)""")
def i17(spark, sf_dir):
    scanned = S.scan(rows(spark, sf_dir))
    overall = meta.overall(meta.seo_score(F.col("html")), F.lit(50), F.lit(50), F.col("score"))
    return scanned.select("page_id", overall.alias("overall")).withColumn("grade", meta.audit_grade(F.col("overall")))


@query("i18_top_issues", f"""
SELECT page_id, place, category, "check", severity, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, pos) AS place
  FROM (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS rank FROM ({findings_sql(SCANNED)}))) WHERE place <= 10""")
def i18(spark, sf_dir):
    return S.top_findings(S.scan(rows(spark, sf_dir))).select("page_id", "place", "category", "check", "severity", rank(F.col("severity")).alias("rank"))


@query("k05_retryable", f"{BASE} SELECT page_id, status IN (429, 500, 502, 503, 504) AS again FROM r")
def k05(spark, sf_dir):
    from ..operators.keyed import retryable

    return rows(spark, sf_dir).select("page_id", retryable(F.col("status")).alias("again"))

"""Tables of a data folder, and the response columns that are derived from pages for tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Header values by page_id: name, modulus, and a value for each remainder that sets one.
DERIVED_HEADERS = {
    "strict-transport-security": (5, {1: "max-age=3600", 2: "max-age=31536000; includeSubDomains; preload", 3: "max-age=16000000; preload", 4: "max-age=31536000"}),
    "content-security-policy": (
        7,
        {
            1: "default-src 'self'; script-src 'self' 'unsafe-inline'",
            2: "default-src 'none'; script-src 'nonce-abc'; object-src 'none'; base-uri 'none'; form-action 'self'; frame-ancestors 'none'",
            3: "script-src 'self' https://cdn.jsdelivr.net 'unsafe-eval'; report-uri /r",
            4: "default-src *; style-src 'unsafe-inline'",
            5: "default-src 'self' *.example.com http:; style-src 'unsafe-inline'; object-src 'none'",
            6: "script-src 'strict-dynamic' 'self'; base-uri 'self'",
        },
    ),
    "x-frame-options": (4, {1: "DENY", 2: "sameorigin", 3: "ALLOWALL"}),
    "x-content-type-options": (3, {1: "nosniff", 2: "sniff"}),
    "referrer-policy": (3, {1: "no-referrer", 2: "unsafe-url"}),
    "permissions-policy": (2, {1: "camera=()"}),
    "cross-origin-opener-policy": (6, {1: "same-origin"}),
    "cross-origin-embedder-policy": (6, {2: "require-corp"}),
    "cross-origin-resource-policy": (6, {3: "same-origin"}),
    "access-control-allow-origin": (8, {1: "*", 2: "https://a.example", 3: "*", 4: "https://b.example"}),
    "access-control-allow-credentials": (8, {1: "true", 2: "TRUE", 3: "false"}),
    "server": (5, {0: "nginx", 1: "nginx/1.18.0", 2: "cloudflare", 3: "Apache/2.4"}),
    "x-powered-by": (9, {4: "PHP/7.4"}),
    "cache-control": (4, {1: "no-store", 2: "public, max-age=60"}),
    "content-encoding": (5, {1: "gzip", 2: "br", 3: "zstd"}),
    "content-type": (3, {0: "text/html", 1: "text/html; charset=utf-8", 2: "application/json"}),
    "x-xss-protection": (7, {1: "0", 2: "1; mode=block"}),
    "x-permitted-cross-domain-policies": (5, {1: "none", 2: "all"}),
    "x-dns-prefetch-control": (5, {1: "off", 2: "on"}),
    "www-authenticate": (25, {3: "Basic realm=x"}),
    "alt-svc": (6, {1: 'h3=":443"'}),
}
DERIVED_COOKIES = (6, {1: "sessionid=1; Secure; HttpOnly; SameSite=Lax", 2: "PHPSESSID=2; Path=/", 3: "auth_token=3; Secure", 4: "_ga=4", 5: "csrftoken=5; Secure; HttpOnly"})
DERIVED_STATUS = (10, {0: 403, 1: 503, 2: 429, 3: 500}, 200)


def _cases(modulus: int, values: dict, rest=None, kind: str = "string") -> Column:
    out = F.lit(rest).cast(kind)
    for r, v in values.items():
        out = F.when(F.col("page_id") % modulus == r, F.lit(v)).otherwise(out)
    return out


def responses(pages: DataFrame) -> DataFrame:
    """``pages`` with status, headers (a map with lower-case names) and set_cookies."""
    entries = F.array(*(F.struct(F.lit(name).alias("key"), _cases(m, v).alias("value")) for name, (m, v) in DERIVED_HEADERS.items()))
    headers = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    cookie = _cases(*DERIVED_COOKIES)
    cookies = F.when(cookie.isNull(), F.array().cast("array<string>")).otherwise(F.array(cookie))
    return pages.withColumns({"status": _cases(DERIVED_STATUS[0], DERIVED_STATUS[1], DERIVED_STATUS[2], "int"), "headers": headers, "set_cookies": cookies})


def responses_sql() -> str:
    """The same derivation as SQL: page_id, url, html, status, cookie, and a column h_<name> for each header."""

    def case(modulus: int, values: dict, rest: str = "NULL") -> str:
        whens = " ".join(f"WHEN page_id % {modulus} = {r} THEN {v if isinstance(v, int) else repr_sql(v)}" for r, v in values.items())
        return f"CASE {whens} ELSE {rest} END"

    columns = [f"{case(m, v)} AS h_{name.replace('-', '_')}" for name, (m, v) in DERIVED_HEADERS.items()]
    return f"SELECT page_id, url, html, {case(DERIVED_STATUS[0], DERIVED_STATUS[1], str(DERIVED_STATUS[2]))} AS status, {case(*DERIVED_COOKIES)} AS cookie, {', '.join(columns)} FROM pages"


def repr_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"

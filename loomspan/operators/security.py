"""Passive security analysis of responses (url, status, html, headers, set_cookies) as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.findings import Rule, histogram, penalty, report
from ..functions.text import visible_text
from .script import CALLS

#: Fixed thresholds of max-age, in seconds: short, and needed for the preload list.
SHORT_AGE, PRELOAD_AGE = 15_768_000, 31_536_000
#: Policies that keep addresses to oneself.
GOOD_REFERRER = ("strict-origin-when-cross-origin", "no-referrer", "same-origin", "strict-origin")
#: Hosts whose scripts answer with any callback.
JSONP_HOSTS = (
    "ajax.googleapis.com", "cdn.google.com", "apis.google.com", "cdnjs.cloudflare.com", "cdn.jsdelivr.net", "unpkg.com", "rawgit.com",
    "raw.githubusercontent.com", "accounts.google.com", "docs.google.com", "translate.googleapis.com", "maps.googleapis.com", "www.googleadservices.com",
)
#: Sources that allow nearly anything.
BROAD_SOURCES = ("https:", "data:", "http:", "*")
#: Parts of session cookies' names, trackers' names, parts of CSRF cookies' names.
SESSION_PARTS = ("sess", "sid", "token", "auth", "login", "phpsessid", "jsessionid", "asp.net_sessionid", "connect.sid", "laravel_session", "wp-settings")
TRACKERS = ("_ga", "_gid", "_fbp", "_fbc", "__gads", "__gpi", "_gcl_au", "IDE", "NID", "fr")
CSRF_COOKIES = ("csrf", "xsrf", "_token", "antiforgery")
#: Headers that tell too much, their severity and what they tell; headers out of use.
TELLING = {
    "x-powered-by": ("medium", "what the server runs"),
    "x-aspnet-version": ("medium", "version of the platform"),
    "x-aspnetmvc-version": ("medium", "version of the framework"),
    "x-generator": ("medium", "what made the site"),
    "x-backend-server": ("high", "name of a host behind"),
    "x-debug-token": ("high", "key to debug data"),
    "x-debug-token-link": ("high", "way to debug data"),
    "x-chromelogger-data": ("high", "debug data itself"),
    "x-runtime": ("low", "time the server took"),
}
OUT_OF_USE = {"public-key-pins": "pinning that browsers gave up", "expect-ct": "a wish that is now the rule"}
#: Marks of stack traces, in the order they are tried.
TRACES = {
    "Java": r"at\s+[\w.]+\.\w+\(\w+\.java:\d+\)",
    "Python": r"Traceback \(most recent call last\)",
    "PHP": r"Fatal error.*in /.*:\d+",
    ".NET": r"(?:NullReferenceException|System\.Web\.HttpException)",
    "Ruby": r"undefined method",
}
#: Parts of names of fields that guard against forged requests.
CSRF_FIELDS = ("csrf", "xsrf", "_token", "authenticity_token", "__requestverificationtoken", "csrfmiddlewaretoken")
#: Hosts of scripts that were taken over.
RISKY_CDNS = ("polyfill.io", "cdn.polyfill.io", "cdn.bootcss.com", "cdn.bootcdn.net")
#: Fixed values of script libraries: a pattern with the version as its group, the first version without known holes, the severity.
LIBRARIES = {
    "jQuery": (r"jquery[.-](\d+\.\d+\.\d+)", (3, 5, 0), "medium"),
    "AngularJS": (r"angular(?:js)?[/.-](\d+\.\d+\.\d+)", (1, 8, 0), "high"),
    "Bootstrap": (r"bootstrap(?:\.min)?\.js\??(?:v=)?(\d+\.\d+\.\d+)", (3, 4, 0), "medium"),
    "Lodash": (r"lodash[@/.-](\d+\.\d+\.\d+)", (4, 17, 21), "medium"),
    "React": (r"react[@/.-](\d+\.\d+\.\d+)", (16, 4, 2), "medium"),
    "Vue.js": (r"vue[@/.-](\d+\.\d+\.\d+)", (2, 5, 17), "medium"),
    "Moment.js": (r"moment(?:\.min)?\.js\??(?:v=)?(\d+\.\d+\.\d+)", (2, 29, 4), "low"),
    "Handlebars": (r"handlebars(?:\.min)?\.js\??(?:v=)?(\d+\.\d+\.\d+)", (4, 7, 7), "high"),
    "DOMPurify": (r"(?:dompurify|purify)[@/.-](\d+\.\d+\.\d+)", (2, 4, 0), "high"),
}
#: The least scores of grades.
GRADES = ((100, "A+"), (90, "A"), (85, "A-"), (80, "B+"), (70, "B"), (65, "B-"), (60, "C+"), (50, "C"), (45, "C-"), (40, "D+"), (30, "D"), (25, "D-"))


def header(name: str) -> Column:
    return F.try_element_at(F.col("headers"), F.lit(name))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts))


def max_age(value: Column) -> Column:
    """Seconds of the first max-age directive, 0 where there is none that is a number."""
    own = F.filter(F.transform(F.split(value, ";"), lambda x: F.trim(x)), lambda p: F.lower(p).startswith("max-age"))
    number = F.regexp_extract(F.coalesce(F.try_element_at(own, F.lit(1)), F.lit("")), r"=\s*(\d+)\s*$", 1)
    return F.coalesce(F.expr("0L") + F.when(number != "", number.cast("bigint")), F.lit(0).cast("bigint"))


def header_rules() -> list[Rule]:
    """Eighteen headers: what is missing, invalid, out of use, or fine."""
    rules: list[Rule] = []

    def add(name: str, *cases: tuple[Column, str, str]) -> None:
        earlier = F.lit(False)
        for when, severity, detail in cases:
            when = F.coalesce(when, F.lit(False))
            rules.append(Rule("headers", name, when & ~earlier, severity, detail))
            earlier = earlier | when

    def simple(name: str, severity: str, label: str) -> None:
        add(name, (header(name).isNull(), severity, f"{label}: missing"), (F.lit(True), "info", f"{label}: set"))

    hsts = header("strict-transport-security")
    age, low = max_age(hsts), F.lower(hsts)
    preload, below = F.contains(low, F.lit("preload")), F.contains(low, F.lit("includesubdomains"))
    add(
        "strict-transport-security", (hsts.isNull(), "high", "not sent: missing"), (age < SHORT_AGE, "medium", "lasts less than half a year"), (preload & below & (age >= PRELOAD_AGE), "info", "fit for the preload list"),
        (preload, "low", "asks for preload but isn't fit for it"), (F.lit(True), "info", "fine"),
    )
    simple("content-security-policy", "high", "policy")
    v = header("x-content-type-options")
    add("x-content-type-options", (v.isNull(), "medium", "not sent: missing"), (F.lower(v) == "nosniff", "info", "types aren't guessed"), (F.lit(True), "medium", "a value browsers don't know"))
    v = header("x-frame-options")
    add("x-frame-options", (v.isNull(), "medium", "not sent: missing"), (F.upper(v).isin("DENY", "SAMEORIGIN"), "info", "framing is limited"), (F.lit(True), "low", "a value browsers don't know"))
    v = header("referrer-policy")
    add("referrer-policy", (v.isNull(), "low", "not sent: missing"), (F.lower(v).isin(*GOOD_REFERRER), "info", "little is passed on"), (F.lit(True), "low", "more is passed on than need be"))
    simple("permissions-policy", "medium", "permissions")
    simple("cross-origin-opener-policy", "low", "opener policy")
    simple("cross-origin-embedder-policy", "low", "embedder policy")
    simple("cross-origin-resource-policy", "low", "resource policy")
    v = header("x-xss-protection")
    add("x-xss-protection", (v.isNull(), "info", "rightly not sent"), (F.trim(v) == "0", "info", "rightly off"), (F.lit(True), "low", "an old filter that does harm is on"))
    for name, label in (("reporting-endpoints", "Reporting-Endpoints"), ("nel", "NEL")):
        add(name, (header(name).isNull(), "info", f"{label}: none needed"), (F.lit(True), "info", f"{label}: set"))
    v = F.lower(header("x-permitted-cross-domain-policies"))
    add("x-permitted-cross-domain-policies", (v.isNull(), "low", "not sent: missing"), (v.isin("none", "master-only"), "info", "limited"), (F.lit(True), "low", "perhaps wider than meant"))
    v = F.lower(header("x-dns-prefetch-control"))
    add("x-dns-prefetch-control", (v.isNull(), "info", "left to the browser"), (v == "off", "info", "names aren't looked up ahead"), (F.lit(True), "low", "names of links are looked up ahead"))
    v, cookies = F.lower(header("cache-control")), F.size("set_cookies") > 0
    bare = cookies & (v.isNull() | (~F.contains(v, F.lit("no-store")) & ~F.contains(v, F.lit("private"))))
    add("cache-control", (bare, "medium", "sets cookies, yet may be stored"), (v.isNull(), "info", "left to the browser"), (F.lit(True), "info", "set"))
    add("clear-site-data", (header("clear-site-data").isNull(), "info", "none needed"), (F.lit(True), "info", "set"))
    v = F.lower(header("content-type"))
    add("content-type", (F.contains(v, F.lit("text/html")) & ~F.contains(v, F.lit("charset")), "low", "encoding of the page not named"))
    basic = F.contains(F.lower(header("www-authenticate")), F.lit("basic"))
    add("www-authenticate", (basic & F.col("url").startswith("https"), "medium", "passwords go in every request"), (basic, "high", "passwords go unencrypted"))
    return rules


def csp_directives(value: Column) -> Column:
    """Directives of the first policy of a header, as a map of name to values; the first of a name counts."""
    first = F.element_at(F.split(value, ","), 1)
    words = F.transform(F.split(first, ";"), lambda d: F.filter(F.split(F.trim(d), r"\s+"), lambda w: w != ""))
    named = F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: F.struct(F.lower(F.element_at(w, 1)).alias("key"), F.slice(w, 2, 1000).alias("value")))
    fresh = F.filter(named, lambda d, i: F.array_position(F.transform(named, lambda x: x["key"]), d["key"]) == i + 1)
    return F.map_from_entries(fresh)


def _values(csp: Column, name: str) -> Column:
    return F.try_element_at(csp, F.lit(name))


def _has(values: Column, word: str) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.lower(v) == word), F.lit(False))


def csp_report(csp: Column) -> tuple[list[Rule], Column]:
    """Rules over a map of directives, and the score."""
    scripts = F.coalesce(_values(csp, "script-src"), _values(csp, "default-src"))
    marked = F.coalesce(F.exists(scripts, lambda v: v.rlike("^'(nonce-|sha256-|sha384-|sha512-)")), F.lit(False))
    broad = F.coalesce(F.exists(scripts, lambda v: v.isin(*BROAD_SOURCES)), F.lit(False))
    loose = _has(scripts, "'unsafe-inline'") & ~marked
    plain = F.filter(F.map_entries(csp), lambda d: F.array_contains(d["value"], "http:"))
    rules = [
        Rule("csp", "unsafe-inline", loose, "high", "inline scripts run unchecked"),
        Rule("csp", "unsafe-eval", _has(scripts, "'unsafe-eval'"), "medium", "text may become code"),
        Rule("csp", "broad-source", broad, "high", "scripts from anywhere"),
        Rule("csp", "strict-dynamic", _has(scripts, "'strict-dynamic'") & ~marked, "high", "trust is passed on from nothing"),
        Rule("csp", "http-scheme", F.size(plain) > 0, "medium", F.concat(F.lit("unencrypted sources for "), F.array_join(F.array_sort(F.transform(plain, lambda d: d["key"])), ", "))),
        Rule("csp", "object-src", ~_has(_values(csp, "object-src"), "'none'"), "medium", "plug-ins aren't shut out"),
        Rule("csp", "base-uri", _values(csp, "base-uri").isNull(), "medium", "addresses can be rebased"),
        Rule("csp", "form-action", _values(csp, "form-action").isNull(), "medium", "forms may be sent anywhere"),
        Rule("csp", "frame-ancestors", _values(csp, "frame-ancestors").isNull(), "low", "framing is left to an older header"),
        *(Rule("csp", f"wildcard {name}", F.coalesce(F.exists(_values(csp, name), lambda v: v.startswith("*.")), F.lit(False)), "medium", f"any subdomain for {name}") for name in ("script-src", "default-src")),
        Rule("csp", "jsonp", F.coalesce(F.exists(scripts, lambda v: _any(F.lower(v), JSONP_HOSTS)), F.lit(False)), "high", "a source that answers with any callback"),
        Rule("csp", "report-uri", _values(csp, "report-uri").isNotNull() & _values(csp, "report-to").isNull(), "low", "reports go the old way only"),
    ]
    score = (
        F.when(broad | loose, -20).when(_has(scripts, "'unsafe-eval'"), -10).when(_has(_values(csp, "style-src"), "'unsafe-inline'"), 0).when(_has(_values(csp, "default-src"), "'none'"), 10).otherwise(5)
    )
    return rules, score


def csp_score(value: Column) -> Column:
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", -25).otherwise(csp_report(csp_directives(value))[1])


def csp_grade(score: Column) -> Column:
    return F.when(score >= 5, "A").when(score >= 0, "B").when(score >= -10, "C").when(score >= -24, "D").otherwise("F")


def csp_findings(value: Column) -> Column:
    none = F.trim(F.coalesce(value, F.lit(""))) == ""
    return F.when(none, report([Rule("csp", "content-security-policy", F.lit(True), "high", "no policy")])).otherwise(report(csp_report(csp_directives(value))[0]))


def cookie(text: Column) -> Column:
    """Name and flags of a Set-Cookie value."""
    attributes = F.transform(F.slice(F.split(text, ";"), 2, 100), lambda a: F.lower(F.trim(a)))
    first = F.element_at(F.split(text, ";"), 1)
    name = F.when(F.contains(first, F.lit("=")), F.trim(F.substring_index(first, "=", 1))).otherwise("")
    site = F.try_element_at(F.filter(attributes, lambda a: a.startswith("samesite=")), F.lit(1))
    secure, domain = F.array_contains(attributes, "secure"), F.exists(attributes, lambda a: a.startswith("domain="))
    scope = F.regexp_replace(F.try_element_at(F.filter(attributes, lambda a: a.startswith("domain=")), F.lit(1)), r"^domain=\.*", "")
    return F.struct(
        name.alias("name"), secure.alias("secure"), F.array_contains(attributes, "httponly").alias("http_only"), F.initcap(F.substring(site, 10, 100)).alias("same_site"),
        (name.startswith("__Host-") & secure & F.array_contains(attributes, "path=/") & ~domain).alias("host_prefix"), (name.startswith("__Secure-") & secure).alias("secure_prefix"),
        _any(F.lower(name), SESSION_PARTS).alias("is_session"), name.isin(*TRACKERS).alias("is_tracker"), scope.alias("domain"),
    )


def cookie_score(cookies: Column) -> Column:
    session = F.filter(cookies, lambda c: c["is_session"])
    return (
        F.when(F.size(cookies) == 0, 0).when(F.exists(session, lambda c: ~c["secure"]), -40).when(F.exists(session, lambda c: ~c["http_only"]), -30)
        .when(F.exists(cookies, lambda c: ~c["secure"]), -20).when(F.exists(cookies, lambda c: c["same_site"].isNotNull()), 5).otherwise(0)
    )


def cookie_findings(cookies: Column, page_host: Column) -> Column:
    """For each cookie, in order: session flags, domain scope; then CSRF cookies without SameSite. A domain of one label counts as a public suffix."""

    def of(c: Column) -> list[Rule]:
        at = lambda check, when, severity, detail: Rule("cookies", check, F.coalesce(when, F.lit(False)), severity, F.concat(c["name"], F.lit(": "), F.lit(detail)))
        suffix = ~F.contains(c["domain"], F.lit("."))
        return [
            at("secure", c["is_session"] & ~c["secure"], "critical", "session may travel unencrypted"),
            at("httponly", c["is_session"] & ~c["http_only"], "high", "session can be read by scripts"),
            at("domain", suffix, "critical", "shared with all sites of a suffix"),
            at("scope", ~suffix & (c["domain"] != page_host) & F.endswith(page_host, F.concat(F.lit("."), c["domain"])), "medium", "shared with hosts above"),
        ]

    csrf = lambda c: [Rule("cookies", "csrf", _any(F.lower(c["name"]), CSRF_COOKIES) & c["same_site"].isNull(), "medium", F.concat(c["name"], F.lit(": guard against forged requests is sent with them")))]
    return F.concat(F.flatten(F.transform(cookies, lambda c: report(of(c)))), F.flatten(F.transform(cookies, lambda c: report(csrf(c)))))


def cors() -> tuple[list[Rule], Column]:
    origin, shared = header("access-control-allow-origin"), F.coalesce(F.lower(header("access-control-allow-credentials")) == "true", F.lit(False))
    wild = F.coalesce(origin == "*", F.lit(False))
    rules = [
        Rule("cors", "wildcard", wild, "critical", "any site may read"),
        Rule("cors", "wildcard-credentials", wild & shared, "critical", "any site, with credentials"),
        Rule("cors", "origin-credentials", origin.isNotNull() & ~wild & shared, "high", "one site, with credentials"),
    ]
    return rules, F.when(wild, -50).when(origin.isNotNull() & shared, -20).otherwise(0)


def disclosure_rules() -> list[Rule]:
    told = [Rule("disclosure", name, header(name).isNotNull(), severity, detail) for name, (severity, detail) in TELLING.items()]
    server = Rule("disclosure", "server", F.coalesce(header("server").rlike(r"^[^/]*/[0-9]"), F.lit(False)), "medium", "version of the server")
    return [*told, server, *(Rule("disclosure", name, header(name).isNotNull(), "low", detail) for name, detail in OUT_OF_USE.items())]


def private_address(text: Column) -> Column:
    """The first address of a private net in a text."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"), F.lit(1))
    part = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    nets = rf"^(?:10\.{part}|127\.{part}|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.{part}\.{part}$"
    return F.try_element_at(F.filter(found, lambda a: a.rlike(nets)), F.lit(1))


def body_rules() -> list[Rule]:
    """Findings in markup; needs ``xss``, from ``pages.with_markup_risks``."""
    html, url = F.col("html"), F.col("url")
    trace = F.coalesce(*(F.when(html.rlike(p), F.lit(name)) for name, p in TRACES.items()))
    comments = F.regexp_extract_all(html, F.lit(r"<!--([\s\S]*?)-->"), F.lit(1))
    bad = F.try_element_at(F.filter(comments, lambda c: c.rlike(r"(?i)\b(TODO|FIXME|HACK|BUG|XXX)\b|(password|secret|api_key|token)\s*=")), F.lit(1))
    generator = F.regexp_extract(html, r"""(?i)<meta\s+name\s*=\s*["']generator["']\s+content\s*=\s*["']([^"']*\d[^"']*)["']""", 1)
    events, script_urls = F.col("xss.handlers"), F.col("xss.script_urls")
    forms = F.regexp_extract_all(html, F.lit(r"""(?i)<form\b[^>]*method\s*=\s*["']?post["']?[^>]*>([\s\S]*?)</form>"""), F.lit(1))
    hidden = lambda f: F.regexp_extract_all(f, F.lit(r"""(?i)<input\b[^>]*type\s*=\s*["']?hidden["']?[^>]*name\s*=\s*["']([^"']+)["']"""), F.lit(1))
    open_form = F.exists(forms, lambda f: ~F.exists(hidden(f), lambda n: _any(F.lower(n), CSRF_FIELDS)))
    source_map = F.regexp_extract(html, r"//[#@]\s*sourceMappingURL\s*=\s*(\S+)", 1)
    return [
        Rule("body", "private_ip", private_address(html).isNotNull(), "medium", F.concat(F.lit("address of a private net: "), private_address(html))),
        Rule("body", "stack_trace", trace.isNotNull(), "high", F.concat(trace, F.lit(" stack trace"))),
        Rule("body", "suspicious_comment", bad.isNotNull(), "medium", F.concat(F.lit("comment: "), F.left(bad, F.lit(80)))),
        Rule("body", "generator_version", generator != "", "medium", F.concat(F.lit("made by "), generator)),
        Rule("body", "directory_listing", html.rlike(r"(?i)<(?:title|h1)>Index of /|Directory listing for /"), "medium", "list of a folder"),
        Rule("body", "session_in_url", url.rlike(r"(?i)(?:jsessionid|phpsessid|sid|session_id|sessionid|aspsessionid)[=;][A-Za-z0-9]{8,}"), "high", "session in the address"),
        Rule("body", "sensitive_url_param", url.rlike(r"(?i)[?&](password|passwd|pwd|secret|token|api_key|apikey|access_token|auth|authorization)="), "high", "secret in the address"),
        Rule("body", "insecure_form_action", url.startswith("https://") & html.rlike(r"""(?i)<form\s[^>]*action\s*=\s*["']http://[^"']*["']"""), "high", "a form is sent unencrypted"),
        Rule("body", "xss_event_handlers", events > 0, "medium", F.concat(events.cast("string"), F.lit(" handlers in tags"))),
        Rule("body", "xss_javascript_url", script_urls > 0, "high", "a link that is a script"),
        Rule("body", "exposed_source_map", source_map != "", "medium", F.concat(F.lit("source map: "), source_map)),
        Rule("body", "form_no_csrf_token", open_form, "medium", "a form without a guard against forged requests"),
    ]


def resources() -> Column:
    """Scripts and stylesheets of the page: kind, url, host, integrity, and whether they are of another host."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<(?:script\b[^>]*\ssrc|link\b[^>]*\srel=.?stylesheet)\b[^>]*>"), F.lit(0))
    attribute = lambda t, name: F.regexp_extract(t, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)
    own = urls.host(F.col("url"))

    def one(t: Column) -> Column:
        script = F.lower(t).startswith("<script")
        target = F.when(script, attribute(t, "src")).otherwise(attribute(t, "href"))
        full = F.when(target.startswith("//"), F.concat(F.lit("https:"), target)).otherwise(target)
        name = urls.host(full)
        return F.struct(F.when(script, "script").otherwise("style").alias("kind"), target.alias("target"), name.alias("host"), (attribute(t, "integrity") != "").alias("has_sri"), F.coalesce(name != own, F.lit(False)).alias("cross"))

    return F.transform(tags, one)


def sri(found: Column) -> tuple[list[Rule], Column]:
    """Findings and modifier of subresource integrity on other hosts' resources."""
    cross = F.filter(found, lambda r: r["cross"])
    n, bare = F.size(cross), F.filter(cross, lambda r: ~r["has_sri"])
    insecure = F.exists(bare, lambda r: r["target"].startswith("http:"))
    missing = F.size(bare)
    hosts = F.array_sort(F.array_distinct(F.transform(bare, lambda r: r["host"])))
    rules = [
        Rule("sri", "none", (n > 0) & (missing == n), "critical", "nothing from elsewhere is checked"),
        Rule("sri", "some", (missing > 0) & (missing < n), "medium", F.concat(F.lit("unchecked: "), F.array_join(hosts, ", "))),
    ]
    return rules, F.when(n == 0, 0).when(missing == 0, 5).when(insecure, -50).otherwise(F.greatest(F.lit(-25), missing * -5))


def supply_chain(found: Column) -> list[Rule]:
    scripts = F.array_distinct(F.filter(found, lambda r: (r["kind"] == "script") & r["cross"]))
    risky = F.filter(scripts, lambda r: r["host"].isin(*RISKY_CDNS))
    return [
        Rule("supply", "risky_cdn", F.size(risky) > 0, "high", F.array_join(F.array_sort(F.array_distinct(F.transform(risky, lambda r: r["host"]))), ", ")),
        Rule("supply", "third_party", F.size(scripts) > 0, "info", F.concat(F.size(scripts).cast("string"), F.lit(" third-party scripts"))),
    ]


def mixed_rules() -> list[Rule]:
    secure = F.col("url").startswith("https://")
    active = {"script": "src", "iframe": "src", "form": "action"}
    passive = {"img": "src", "video": "src", "audio": "src"}
    found = lambda tag, name: F.size(F.regexp_extract_all(F.col("html"), F.lit(rf"""(?is)<{tag}\b[^>]*\s{name}\s*=\s*["']http://[^"']*["']"""), F.lit(0)))
    style = F.size(F.filter(F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)rel\s*=\s*.?stylesheet") & t.rlike(r"""(?i)href\s*=\s*["']http://""")))
    rules = [Rule("mixed", t, secure & (found(t, a) > 0), "high", F.concat(found(t, a).cast("string"), F.lit(f" insecure {t}"))) for t, a in active.items()]
    rules.append(Rule("mixed", "stylesheet", secure & (style > 0), "high", F.concat(style.cast("string"), F.lit(" insecure stylesheet"))))
    return rules + [Rule("mixed", t, secure & (found(t, a) > 0), "medium", F.concat(found(t, a).cast("string"), F.lit(f" insecure {t}"))) for t, a in passive.items()]


def library_rules(found: Column) -> list[Rule]:
    """Script libraries below the first version without known holes."""

    def rule(name: str, pattern: str, safe: tuple[int, ...], severity: str) -> Rule:
        versions = F.filter(F.transform(found, lambda r: F.regexp_extract(F.lower(r["target"]), pattern, 1)), lambda v: v != "")
        old = F.filter(versions, lambda v: F.transform(F.split(v, r"\."), lambda x: x.cast("int")) < F.array(*(F.lit(x) for x in safe)))
        return Rule("library", name, F.size(old) > 0, severity, F.concat(F.lit(f"{name} "), F.coalesce(F.try_element_at(old, F.lit(1)), F.lit(""))))

    return [rule(name, *of) for name, of in LIBRARIES.items()]


def dangerous_rules(found: Column) -> list[Rule]:
    """Calls of inline scripts (``script_calls``, from ``pages.with_markup_risks``): a finding for each kind."""
    return [Rule("script", name, F.array_contains(found, name), severity, f"{name} in an inline script") for name, severity in CALLS.items()]


def redirect(chain: Column) -> tuple[list[Rule], Column]:
    """``chain``: the URLs of a fetch in order."""
    last = F.element_at(chain, -1)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(chain) - 1, F.lit(1))), lambda i: F.struct(F.element_at(chain, i).alias("a"), F.try_element_at(chain, i + 1).alias("b")))
    falls = F.size(F.filter(steps, lambda s: s["a"].startswith("https://") & F.coalesce(s["b"].startswith("http://"), F.lit(False))))
    away = F.coalesce(urls.host(F.element_at(chain, 1)) != urls.host(last), F.lit(False))
    rules = [
        Rule("redirect", "http", last.startswith("http://"), "high", "ends unencrypted"),
        Rule("redirect", "downgrade", falls > 0, "high", "encryption is left on the way"),
        Rule("redirect", "cross_host", away, "info", "Redirect to another host"),
    ]
    return rules, F.greatest(F.lit(-30), F.when(last.startswith("http://"), -20).otherwise(0) - falls * 10)


def grade(score: Column) -> Column:
    out = F.lit("F")
    for low, name in reversed(GRADES):
        out = F.when(score >= low, name).otherwise(out)
    return out


def clamp(value: Column, low: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(0)))


def truncated(a: Column, b: int) -> Column:
    """Integer division towards zero."""
    return F.when(a >= 0, F.floor(a / b)).otherwise(F.ceil(a / b)).cast("int")


def score_pools(findings: Column, csp_points: Column, modifiers: dict[str, Column]) -> Column:
    """Two pools of fifty points: headers, and the quality of what is there; bonuses from ninety on."""
    off = lambda check, severity: F.exists(findings, lambda f: (f["check"] == check) & (f["severity"] == severity) & f["detail"].endswith("missing"))
    missing = {"strict-transport-security": ("high", 15), "x-content-type-options": ("medium", 3), "x-frame-options": ("medium", 10), "referrer-policy": ("low", 3), "content-security-policy": ("high", 15)}
    headers = F.lit(50)
    for check, (severity, points) in missing.items():
        headers = headers - F.when(off(check, severity), points).otherwise(0)
    short = F.exists(findings, lambda f: (f["check"] == "strict-transport-security") & (f["severity"] == "medium"))
    headers = headers - F.when(short, 5).otherwise(0)
    quality = F.lit(20) + F.greatest(F.lit(0), F.least(F.lit(30), truncated((csp_points + 25) * 30, 35)))
    limits = {"cookies": -10, "cors": -10, "sri": -5, "disclosure": -5, "body": -5, "library": -10, "script": -10, "redirect": -5}
    for name, value in modifiers.items():
        quality = quality + clamp(value, limits[name])
    total = F.greatest(headers, F.lit(0)) + F.greatest(quality, F.lit(0))
    hsts = F.lower(header("strict-transport-security"))
    quiet = F.coalesce(F.lower(header("referrer-policy")).isin("no-referrer", "same-origin"), F.lit(False))
    preload = F.coalesce(F.contains(hsts, F.lit("preload")) & F.contains(hsts, F.lit("includesubdomains")) & (max_age(hsts) >= PRELOAD_AGE), F.lit(False))
    bonus = F.when(quiet, 5).otherwise(0) + F.when(preload, 5).otherwise(0)
    return F.greatest(F.lit(0), F.when(total >= 90, total + bonus).otherwise(total)).cast("int")


def scan(responses: DataFrame) -> DataFrame:
    """All analyses of ``responses``: their findings, modifiers, the score, its grade, and counts by severity.

    A column ``chain`` (URLs of the fetch in order) is used if there.
    """
    chain = F.col("chain") if "chain" in responses.columns else F.array("url")
    cookies = F.transform("set_cookies", cookie)
    from .pages import with_markup_risks

    rows = responses if "script_calls" in responses.columns else with_markup_risks(responses)
    rows = rows.withColumns({"__resources": resources(), "__cookies": cookies})
    found = F.col("__resources")
    cors_rules, cors_points = cors()
    sri_rules, sri_points = sri(found)
    redirect_rules, redirect_points = redirect(chain)
    rows = rows.withColumns({
        "header_findings": report(header_rules()), "csp_findings": csp_findings(header("content-security-policy")), "csp_points": csp_score(header("content-security-policy")),
        "cookie_findings": cookie_findings(F.col("__cookies"), urls.host(F.col("url"))), "cookie_points": cookie_score(F.col("__cookies")), "cors_findings": report(cors_rules), "cors_points": cors_points,
        "sri_findings": report(sri_rules), "sri_points": sri_points, "supply_findings": report(supply_chain(found)), "mixed_findings": report(mixed_rules()), "disclosure_findings": report(disclosure_rules()),
        "body_findings": report(body_rules()), "library_findings": report(library_rules(found)), "script_findings": report(dangerous_rules(F.col("script_calls"))), "redirect_findings": report(redirect_rules), "redirect_points": redirect_points,
    })
    kinds = ("header", "csp", "cookie", "cors", "sri", "supply", "mixed", "disclosure", "body", "library", "script", "redirect")
    modifiers = {
        "cookies": F.col("cookie_points"), "cors": F.col("cors_points"), "sri": F.col("sri_points"), "disclosure": penalty(F.col("disclosure_findings"), -30), "body": penalty(F.col("body_findings"), -30),
        "library": penalty(F.col("library_findings"), -25), "script": penalty(F.col("script_findings"), -30), "redirect": F.col("redirect_points"),
    }
    rows = rows.withColumn("score", score_pools(F.col("header_findings"), F.col("csp_points"), modifiers)).withColumn("findings", F.concat(*(F.col(f"{k}_findings") for k in kinds)))
    return rows.withColumns({"grade": grade(F.col("score")), "csp_grade": csp_grade(F.col("csp_points")), "counts": histogram(F.col("findings"))}).drop("__resources", "__cookies", "script_calls", "xss")


def challenge_kind(html: Column) -> Column:
    """What kind of challenge a response of the protecting proxy is: server, status and marks of the page decide."""
    mine = F.coalesce(F.contains(F.lower(header("server")), F.lit("cloudflare")), F.lit(False))
    low, status = F.lower(html), F.col("status")
    has = lambda *marks: _any(low, marks)
    barred, fine = status.isin(403, 503), status == 200
    widget = has("turnstile-wrapper", "cf-turnstile")
    kind = (
        F.when((status == 503) & has("challenge-platform"), "js_challenge").when(barred & widget, "turnstile").when(barred & has("you have been blocked", "cf-error-details"), "block")
        .when(fine & F.coalesce(F.contains(header("cf-mitigated"), F.lit("challenge")), F.lit(False)), "managed_challenge").when(fine & widget, "turnstile").when(fine & has("_cf_chl_opt", "challenge-platform"), "managed_challenge")
    )
    return F.when(mine, kind)


def response_quality(html: Column) -> Column:
    """Why a response is worth another try: a status, or a large page with next to no text (scripts' text counts)."""
    text = F.length(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", ""), r"[\s\p{Z}]+", ""))
    empty = (F.col("status") == 200) & (F.octet_length(html) > 5000) & ~F.coalesce(F.contains(header("content-type"), F.lit("json")), F.lit(False)) & (text < 100)
    return F.when(F.col("status").isin(401, 403, 429, 503), F.concat(F.lit("status_"), F.col("status").cast("string"))).when(empty, "empty_page")


def top_findings(scanned: DataFrame, n: int = 10) -> DataFrame:
    """The n worst findings of each page, in the order they were made within a severity."""
    flat = scanned.select("page_id", F.posexplode("findings").alias("pos", "f")).select("page_id", "pos", "f.*")
    from ..functions.findings import rank

    place = F.row_number().over(Window.partitionBy("page_id").orderBy(rank(F.col("severity")), "pos"))
    return flat.withColumn("place", place).where(F.col("place") <= n)


__all__ = ["visible_text", "scan", "top_findings"]

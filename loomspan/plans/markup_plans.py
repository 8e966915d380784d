"""Queries on markup: selectors, scripts, sanitizing, protection, malformed addresses, cookie scopes, answers of an image search, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, css, dom, fingerprint, keyed, lens, pages, payloads, protection, sanitize, script, suffixes
from ..operators import security as S
from ..operators.storage import Store
from ..sources import saved
from ..sources.tables import load
from .case_plans import by_kernel
from .case_plans import register as register_cases
from .dom_plans import PLAIN, SPACED, TITLE
from .page_plans import HOST

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def cases(name: str, rows: list[tuple[str, str]], run) -> None:
    from . import case_plans

    register_cases(name, rows, run)
    QUERIES[name], SQL[name] = case_plans.QUERIES.pop(name), case_plans.SQL.pop(name)


# --- selectors ---

NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"


@query("e38_css_select", f"""
SELECT page_id, len(regexp_extract_all({NAV}, '<a href="/'))::INTEGER AS n_links, regexp_extract_all({NAV}, '<a href="([^"]*)"', 1)[2] AS second, list_reverse(regexp_extract_all({NAV}, '<a href="([^"]*)"', 1))[1] AS last,
       {SPACED.format(PLAIN.format("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"))} AS ad, {SPACED.format(PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS heading FROM pages""")
def e38(spark, sf_dir):
    found = pages.select_beside(load(spark, sf_dir, "pages"), links="nav > ul > li a[href^='/']", second="nav li:nth-child(2) > a@href", last="li:last-child:not(:has(> ul)) a[href]@href", ad="nav ~ div.ad", heading="body > article h1:first-child")
    first = lambda c: F.try_element_at(c, F.lit(1))
    return found.select("page_id", F.size("links").alias("n_links"), first("second").alias("second"), first("last").alias("last"), first("ad").alias("ad"), first("heading").alias("heading"))


@query("e38_css_rows", f"SELECT page_id, generate_subscripts(h, 1)::INTEGER - 1 AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all({NAV}, '<a href=\"([^\"]*)\"', 1) AS h FROM pages)")
def e38b(spark, sf_dir):
    return pages.select(load(spark, sf_dir, "pages"), "nav a[href]", "href").select("page_id", "pos", "href")


_LIST = "<nav><ul class='m x'><li><a href='/A{id}' rel='no follow' lang=en-US>A</a><li class=sel><a href='https://b.c/d.PDF' data-q='1'>B{id}</a><li>C</ul></nav><div class='ad' id=d1><p>one</p><p>two <b>x{id}</b></p><span></span></div><article><h1>T{id}</h1><p>last</p></article>"
SELECTED = [
    ("li", "A|B{id}|C"), ("ul.m.x > li", "A|B{id}|C"), ("nav a[href^='/']", "A"), ("a[href$='.pdf' i]", "B{id}"), ("a[href$='.pdf']", ""), ("a[rel~=follow]", "A"), ("a[lang|=en]", "A"), ("[data-q='1'], h1", "B{id}|T{id}"), ("a[href*='c/d']", "B{id}"), ("a[href!='/A{id}']", "B{id}"),
    ("li:nth-child(2)", "B{id}"), ("li:nth-child(odd)", "A|C"), ("li:nth-child(-n+2)", "A|B{id}"), ("li:last-child", "C"), ("p:not(:first-child)", "two x{id}|last"), ("li:has(a)", "A|B{id}"), ("li:not(:has(> a))", "C"), ("li:has(+ li.sel)", "A"), ("div#d1 p + p", "two x{id}"), ("h1 ~ p", "last"), ("div > p b", "x{id}"),
    ("p:nth-last-child(2)", "two x{id}"), ("p:nth-of-type(2n)", "two x{id}"), ("p:contains('two')", "two x{id}"), (":is(h1, b)", "x{id}|T{id}"), ("div span:empty", ""), ("LI.sel A", "B{id}"), ("p > li", ""),
]


def _selected(text: str) -> str:
    selector, _, html = text.partition("\x1f")
    return "|".join(dom.squeeze(n.text) for n in css.Page(dom.parse(html)).select(css.compiled(selector)))


cases("e38_selector_cases", [(f"{s}\x1f{_LIST}", want) for s, want in SELECTED], by_kernel(_selected))

# --- malformed addresses ---


@query("e20_malformed_urls", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://[x' || page_id::VARCHAR END AS image, (len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref="([^"]*)"', 1)) + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END)::INTEGER AS internal, 0 AS external FROM pages""")
def e20(spark, sf_dir):
    i = F.col("page_id")
    odd = F.when(i % 3 == 0, F.concat(F.lit('<p><img alt="a" src="http://[x'), i.cast("string"), F.lit('"><a href="http://[::1/y">t</a></p><![odd[</article>'))).otherwise("</article>")
    url = F.when(i % 5 == 0, F.concat(F.lit("http://[::1"), i.cast("string"))).otherwise(F.col("url"))
    given = load(spark, sf_dir, "pages").withColumns({"html": F.replace("html", F.lit("</article>"), odd), "url": url})
    read = pages.read_pages(given, "markdown", info=()).select("page_id", F.nullif(F.regexp_extract("content", r"!\[a\]\((http://\[x\d+)\)", 1), F.lit("")).alias("image"))
    return read.join(pages.page_links(given).select("page_id", "internal", "external"), "page_id")


STORY = "Plain words of story {id} go on here. " * 8
HEADED = [
    (f"<body><h2>Lost {{id}}</h2><article><p>{STORY}</p></article></body>", f"## Lost {{id}}\n\n{STORY.strip()}"), (f"<body><div class='sidebar'><h2>Noise {{id}}</h2></div><article><p>{STORY}</p></article></body>", STORY.strip()),
    (f"<body><article><h2>Kept {{id}}</h2><p>{STORY}</p></article></body>", f"## Kept {{id}}\n\n{STORY.strip()}"), (f"<body><h2>Alone {{id}}</h2><p>short</p><article><p>{STORY}</p></article></body>", f"## Alone {{id}}\n\n{STORY.strip()}"),
]
cases("e17_heading_cases", HEADED, by_kernel(lambda html: dom.extract(html, "https://site.example/a", "markdown")["content"]))

# --- scripts ---

SCRIPTS = {
    1: ("eval(x)", 1), 2: ("var a = 'eval(1)'; // eval(2)", 0), 3: ("document.write('x'); el['innerHTML'] = y", 2), 4: ("function f() { eval(1) } new Function('a')", 1), 5: ("setTimeout('f()', 1); x = /eval(1)/", 1),
}


@query("s16_s17_scripts", f"SELECT page_id, (page_id % 4 = 0)::INTEGER AS libraries, CASE page_id % 6 {' '.join(f'WHEN {k} THEN {n}' for k, (_, n) in SCRIPTS.items())} ELSE 0 END AS calls FROM pages")
def s16(spark, sf_dir):
    i = F.col("page_id")
    said = F.lit("")
    for k, (text, _) in SCRIPTS.items():
        said = F.when(i % 6 == k, f"<script>{text}</script>").otherwise(said)
    library = F.when(i % 4 == 0, '<script src="https://c.example/jquery-1.12.4.min.js"></script>').otherwise("")
    given = pages.with_markup_risks(load(spark, sf_dir, "pages").withColumn("html", F.concat("html", said, library))).withColumn("r", S.resources())
    return given.select("page_id", F.size(S.report(S.library_rules(F.col("r")))).alias("libraries"), F.size(S.report(S.dangerous_rules(F.col("script_calls")))).alias("calls"))


CALLED = [
    ("eval(a{id}); document.write(b)", "eval document.write"), ("var x = 'eval({id})'; /* eval(3) */ `eval(${4})`", ""), ("function f() { eval({id}) }\nf()", ""), ("window['eval'](x{id})", "eval"), ("el['innerHTML'] = y{id}; a.b.outerHTML += z", "innerHTML outerHTML"), ("if (a{id}) { eval(b) } else document['writeln'](c)", "eval document.write"),
    ("x = /eval({id})/; y = a / eval(2) / 3", ""), ("new Function('a{id}')\nFunction('b')", "Function Function"), ("setTimeout('x{id}()', 1); setTimeout(function () { eval(2) }, 2)", "setTimeout-string"), ("(function () { eval({id}) })()", ""), ("a && eval({id})", ""), ("eval({id}", ""),
    ("foo(eval({id}), () => eval(2))", "eval"), ("a = b\neval({id})", "eval"), ("for (;;) { eval({id}) }", ""), ("x = y = eval({id}), eval(2)", "eval eval"), ("class A { m() { eval(1) } }\neval({id})", "eval"), ("let s = 'a", ""), ("let q = `${`}` + '{'}`; eval({id})", "eval"),
]
cases("s17_statement_cases", CALLED, by_kernel(lambda t: " ".join(script.calls(t))))
PAD = "words of state " * 8
STATES = [
    ("window.__A = {a: {id}, 'b': [1, 2,], \"c\": '" + PAD + "'};", '__A {"a":{id},"b":[1,2],"c":"' + PAD + '"}'), ("self.__B = JSON.parse('{\"a\":\"" + PAD + "{id}\"}')", '__B {"a":"' + PAD + '{id}"}'),
    ("var __C = ['a' + \"b\" + `c` + {id}, !0, !1, void 0, -1.5, 0x10, function () {}, '" + PAD + "']", '__C ["abc{id}",true,false,null,-1.5,16,null,"' + PAD + '"]'),
    ("window.__D = window.__D || {}; __D.x = '" + PAD + "'; window.__D['y'] = Object.assign({}, {z: {id}}, {w: 2})", '__D {"x":"' + PAD + '","y":{"z":{id},"w":2}}'), ("(function () { window.__E = {a: load(), t: '" + PAD + "{id}', f() {} } })()", '__E {"t":"' + PAD + '{id}"}'),
    ("try { window.__G = {'" + PAD + "': [, {id}]} } catch (e) {}", '__G {"' + PAD + '":[null,{id}]}'), ("window.__H = {a: '" + PAD + "{id}'", ""), ("if (!window.__I) window.__I = {a: '" + PAD + "\\u00e9\\x41\\n{id}'}", '__I {"a":"' + PAD + 'éA\\n{id}"}'),
    ("window.__J = {short: {id}}", ""), ("window.state = {a: '" + PAD + "{id}'}", ""), ("const base = {a: {id}}; window.__K = {...base, b: base.a, c: '" + PAD + "'}", '__K {"a":{id},"b":{id},"c":"' + PAD + '"}'),
    ("(self.__next_f = self.__next_f || []).push([1, '" + PAD + "{id}'])", '__next_f [[1,"' + PAD + '{id}"]]'),
]
cases("js01_state_cases", STATES, by_kernel(lambda t: " ".join(f"{n} {v}" for n, v in script.state([t]))))
PROSE = [
    ("Sixteen chars {id}!", "Sixteen chars {id}!"), ("http://a.example/{id} is an address", ""), ("//cdn.example/{id} and words", ""), ("./path of {id} some file", ""), ("a {id} {b: c} rule of style here", ""), ("1fr {id} Auto columns in a grid", ""), ("Card-1 card-2 area names {id}", ""), ('He said "quoted words" {id}', ""),
    ("lower words only in a row {id}", ""), ("16px 0 10% 2em 3rem 4px {id}px", ""), ("Unbrokentextofmanycharacters{id}withoutanyblankinit", ""), ("Words of a file named {id}.png", ""), ("12345 67890 12345 {id} A", ""), ("<b>Bold</b> words of page {id} here", "Bold words of page {id} here"), ("<i><b><u><s>Ab{id}</s></u></b></i> x", ""),
]
cases("js04_prose_cases", PROSE, by_kernel(lambda t: dom.readable(t) or ""))

# --- what a sanitizer takes ---

RISKS = [
    ("<a href='java\tscript:x({id})'>a</a>", "0 1 <a>a</a>"), ("<a href='&#106;avascript:{id}'>a</a>", "0 1 <a>a</a>"), ("<odd onodd={id} onclick='x'>w</odd>", "2 0 w"), ("<p title=t{id} onload='a'>b<br></p>", '1 0 <p title="t{id}">b<br></p>'), ("<img src='data:image/png,{id}' alt=a>", '0 0 <img alt="a">'),
    ("<a href=' \x01JavaScript:{id}'>x</a>", "0 1 <a>x</a>"), ("<a href='https://x.example/?javascript:{id}'>x</a>", '0 0 <a href="https://x.example/?javascript:{id}">x</a>'), ("<script>var a = 'onclick={id}'</script>t", "0 0 t"), ("<form action='vbscript:{id}'><button formaction='javascript:b'>s</button></form>", "0 2 s"),
]


def _risk(html: str) -> str:
    doc = dom.parse(html)
    return f"{' '.join(map(str, sanitize.lost(doc)))} {sanitize.sanitized(doc)}"


cases("s13_sanitizer_cases", RISKS, by_kernel(_risk))


@query("s13_xss", "SELECT page_id, CASE page_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 0 END AS handlers, CASE WHEN page_id % 4 = 2 THEN 1 ELSE 0 END AS script_urls FROM pages")
def s13(spark, sf_dir):
    i = F.col("page_id")
    more = F.when(i % 4 == 1, '<p onclick="a()">x</p>').when(i % 4 == 2, '<a href="java&#x09;script&colon;a()">x</a>').when(i % 4 == 3, "<odd onx=1 ony='2'></odd>").otherwise("<p>on x = javascript</p>")
    return pages.with_markup_risks(load(spark, sf_dir, "pages").withColumn("html", F.concat("html", more))).select("page_id", "xss.handlers", "xss.script_urls")


# --- protection ---

#: By page_id % 9: class of marks, product, category, confidence.
MARKED = {
    0: ("cookies", "DataDome", "bot_detection", 70), 1: ("cookies_prefix", "Imperva", "waf", 70), 2: ("cookies_regex", "F5 BIG-IP", "waf", 60), 3: ("headers", "Imperva", "waf", 40), 4: ("headers_regex", "AWS WAF", "waf", 40),
    5: ("scripts", "Fingerprint", "fingerprinting", 70), 6: ("html_patterns", "hCaptcha", "captcha", 40), 7: ("url_patterns", "Auth0", "auth_security", 50),
}


def _marked(spark, sf_dir):
    i = F.col("page_id") % 9
    cookies = F.when(i == 0, F.array(F.lit("DataDome=1; Path=/"))).when(i == 1, F.array(F.lit("a=b"), F.lit("incap_ses_7=x"))).when(i == 2, F.array(F.lit("TS01ab23cd=x"))).otherwise(F.array().cast("array<string>"))
    headers = F.when(i == 3, F.create_map(F.lit("X-Iinfo"), F.lit("1"))).when(i == 4, F.create_map(F.lit("x-amzn-waf-action"), F.lit("captcha"))).otherwise(F.create_map().cast("map<string,string>"))
    html = F.when(i == 5, F.concat("html", F.lit("<script>FingerprintJS.load()</script>"))).when(i == 6, F.concat("html", F.lit("<div class='big h-captcha'></div>"))).otherwise(F.col("html"))
    url = F.when(i == 7, "https://x.auth0.com/login").otherwise("https://plain.example/")
    return load(spark, sf_dir, "pages").select("page_id", url.alias("url"), html.alias("html"), headers.alias("headers"), cookies.alias("set_cookies"))


_MARKED_SQL = ", ".join(f"({k}, '{c}', '{n}', '{g}', {p})" for k, (c, n, g, p) in MARKED.items())


@query("s19_signal_classes", f"SELECT page_id, name, category, confidence, class FROM pages JOIN (VALUES {_MARKED_SQL}) AS m(k, class, name, category, confidence) ON page_id % 9 = k")
def s19(spark, sf_dir):
    found = protection.detections(protection.with_protection(_marked(spark, sf_dir)))
    return found.select("page_id", "name", "category", "confidence", F.substring_index(F.col("marks")[0], ":", 1).alias("class"))


@query("s19_login", f"""
SELECT page_id, unnest(list_filter(['no_captcha', 'no_bot_detection', 'no_fingerprinting'], lambda c: CASE c WHEN 'no_captcha' THEN coalesce(category, '') NOT IN ('captcha', 'bot_detection') WHEN 'no_bot_detection' THEN coalesce(category, '') NOT IN ('bot_detection', 'waf') ELSE coalesce(category, '') <> 'fingerprinting' END)) AS missing
FROM pages LEFT JOIN (VALUES {_MARKED_SQL}) AS m(k, class, name, category, confidence) ON page_id % 9 = k""")
def s19b(spark, sf_dir):
    told = protection.with_protection(_marked(spark, sf_dir)).withColumn("f", protection.login_findings())
    return told.select("page_id", F.explode("f.check").alias("missing"))


# --- scopes of cookies ---

#: Rules of our own making in the public list's form.
SUFFIX_RULES = ("com", "example", "co.example", "*.wild", "!city.wild", "deep.co.example")


@query("s06_cookie_scope", f"""
WITH r(rule) AS (VALUES {", ".join(f"('{r}')" for r in SUFFIX_RULES)}),
c AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'com' WHEN 1 THEN 'co.example' WHEN 2 THEN 'shop' || (page_id % 3)::VARCHAR || '.co.example' WHEN 3 THEN 'a.wild' WHEN 4 THEN 'city.wild' WHEN 5 THEN 'other' WHEN 6 THEN 'x.deep.co.example' END AS domain FROM pages),
d AS (SELECT DISTINCT domain, string_split(domain, '.') AS labels FROM c WHERE domain IS NOT NULL),
cuts AS (SELECT domain, len(labels) AS n, k, array_to_string(labels[len(labels) - k + 1:], '.') AS piece FROM d, range(1, 9) AS t(k) WHERE k <= len(labels)),
met AS (SELECT domain, n, max(CASE WHEN rule = '!' || piece THEN k - 1 END) AS exc, max(CASE WHEN rule = piece THEN k WHEN rule = '*.' || piece AND k < n THEN k + 1 END) AS longest FROM cuts LEFT JOIN r ON rule IN (piece, '!' || piece, '*.' || piece) GROUP BY domain, n)
SELECT c.page_id, c.domain, CASE WHEN coalesce(exc, longest, 1) >= n THEN 'suffix' WHEN c.domain IS NOT NULL THEN 'wide' END AS scope FROM c LEFT JOIN met ON met.domain = c.domain""")
def s06(spark, sf_dir):
    i = F.col("page_id")
    domain = (
        F.when(i % 8 == 0, "com").when(i % 8 == 1, ".Co.Example").when(i % 8 == 2, F.concat(F.lit("shop"), (i % 3).cast("string"), F.lit(".co.example"))).when(i % 8 == 3, "a.wild").when(i % 8 == 4, "city.wild")
        .when(i % 8 == 5, "other").when(i % 8 == 6, "x.deep.co.example")
    )
    given = load(spark, sf_dir, "pages").select("page_id", domain.alias("domain"), F.concat(F.lit("www."), F.coalesce(suffixes.tidy_name(domain), F.lit("none"))).alias("page_host"))
    rules = spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    return suffixes.cookie_scopes(given, rules).select("page_id", suffixes.tidy_name(F.col("domain")).alias("domain"), "scope")


# --- answers of an image search ---


@query("r04_lens_ways", """
SELECT page_id AS id, k::INTEGER AS pos, 'https://m' || k::VARCHAR || '.example/' || page_id::VARCHAR AS page_url, CASE WHEN page_id % 4 = 3 THEN 'Plain' ELSE 'Title ' || k::VARCHAR END AS title, 'm' || k::VARCHAR || '.example' AS domain,
       CASE page_id % 4 WHEN 1 THEN 'keys' WHEN 2 THEN 'callbacks' ELSE 'links' END AS way FROM pages, (VALUES (0), (1)) AS t(k) WHERE page_id % 4 > 0 AND (k = 0 OR page_id % 4 < 3)""")
def r04(spark, sf_dir):
    i = F.col("page_id").cast("string")
    at = lambda k: F.concat(F.lit(f"https://m{k}.example/"), i)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    keys = text('<script>google.ldi={"dimg_b":"x{y","dimg_a":"z\\u003d"};</script><div data-iid="dimg_a"><a href="', at(0), '">Title 0</a></div><a href="', at(1), '"><img data-iid="dimg_b">Title 1</a><a href="https://other.example/">no key</a>')
    calls = text('<script>AF_initDataCallback({key: "ds:1", data:[null, [["', at(0), '","Title 0", 3],["', at(1), '","Title 1"],["https://www.google.com/search?q=1","Own"]]], sideChannel: {}});</script><a href="https://late.example/x">late</a>')
    plain = text('<a href="https://www.google.com/x">own</a><a href="', at(0), '"> Plain </a><a href="/rel">rel</a>')
    body = F.when(F.col("page_id") % 4 == 1, keys).when(F.col("page_id") % 4 == 2, calls).when(F.col("page_id") % 4 == 3, plain).otherwise("<p>nothing</p>")
    return lens.lens_matches(load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), body.alias("body"))).select("id", "pos", "page_url", "title", "domain", "way")


# --- schedules ---


@query("k02_schedule", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, CASE WHEN event_id % 50 = 7 THEN epoch(ts) + 90000.0 END AS until, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE 3600.0 * (user_id % 3) END AS delay,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, t::DOUBLE AS start, until AS held FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, greatest(e.t, s.start + e.delay, coalesce(s.held, e.t))::DOUBLE, greatest(coalesce(s.held, e.until), coalesce(e.until, s.held)) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, round(start, 3) AS start FROM s""")
def k02(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    given = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), t.alias("ts"), F.when(F.col("event_id") % 50 == 7, t + 90000.0).alias("until"), F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(3600.0 * (F.col("user_id") % 3)).alias("delay"))
    return keyed.schedule(given, key="user_id").select(F.col("seq").alias("event_id"), F.round("start", 3).alias("start"))


# --- technologies by a rule table ---

#: Rules and implications of our own making.
TECH_RULES = [
    ("Loomer", "cms", "meta", "generator", r"^Loomer(?: ([\d.]+))?\;version:\1"), ("Loomer", "cms", "html", None, r"class=\"loomer-\;confidence:50"), ("Weft", "framework", "script", None, r"/weft(?:-([\d.]+))?(?:\.min)?\.js\;version:\1"), ("Weft", "framework", "header", "x-weft", ""),
    ("Shuttle", "server", "header", "server", r"shuttle(?:/([\d.]+))?\;version:\1"), ("Bobbin", "analytics", "cookie", "_bobbin", ""), ("Selvage", "cdn", "url", None, r"\.selvage\.example/\;confidence:30"), ("Heddle", "framework", "script", None, r"heddle@(\S+)\;version:\1"),
]
TECH_IMPLIES = [("Loomer", "Weft", 80), ("Weft", "Thread", 100), ("Thread", "Fibre", 60), ("Fibre", "Thread", 100), ("Bobbin", "Thread", 20)]


@query("i14_fingerprint", f"""
WITH RECURSIVE own AS (
  SELECT page_id, 'Loomer' AS name, 100 AS confidence, CASE WHEN page_id % 12 = 0 THEN '4.' || page_id::VARCHAR END AS version FROM pages WHERE page_id % 6 = 0
  UNION ALL SELECT page_id, 'Weft', 100, CASE WHEN page_id % 2 = 0 THEN '2.0.' || (page_id % 10)::VARCHAR END FROM pages WHERE page_id % 6 = 1 OR page_id % 6 = 2
  UNION ALL SELECT page_id, 'Shuttle', 100, '1.2' FROM pages WHERE page_id % 4 = 3 UNION ALL SELECT page_id, 'Bobbin', 100, NULL FROM pages WHERE page_id % 5 = 4
  UNION ALL SELECT page_id, 'Selvage', 30, NULL FROM pages WHERE page_id % 7 = 5 UNION ALL SELECT page_id, 'Heddle', 100, NULL FROM pages WHERE page_id % 6 = 3
), imp(a, b, c) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in TECH_IMPLIES)}),
chain AS (SELECT a, b, c FROM imp UNION SELECT chain.a, imp.b, least(chain.c, imp.c) FROM chain JOIN imp ON imp.a = chain.b WHERE imp.b <> chain.a),
every AS (SELECT page_id, name, confidence, version, true AS seen FROM own UNION ALL SELECT page_id, b, least(confidence, c), NULL, false FROM own JOIN (SELECT a, b, max(c) AS c FROM chain GROUP BY a, b) ON a = name)
SELECT page_id, name, max(confidence)::INTEGER AS confidence, max(version) AS version, NOT bool_or(seen) AS implied FROM every GROUP BY page_id, name""")
def i14(spark, sf_dir):
    i = F.col("page_id")
    n = i.cast("string")
    more = (
        F.when(i % 12 == 0, F.concat(F.lit('<meta name="generator" content="Loomer 4.'), n, F.lit('"><p class="loomer-x">x</p>'))).when(i % 6 == 0, '<meta name="Generator" content="loomer">')
        .when(i % 6 == 2, F.concat(F.lit('<script src="/js/weft-2.0.'), (i % 10).cast("string"), F.lit('.min.js"></script>'))).when(i % 6 == 3, '<script src="https://c.example/heddle@1.0/long/path.js"></script>').otherwise("")
    )
    pairs = F.array_compact(F.array(F.when(i % 6 == 1, F.struct(F.lit("X-Weft").alias("key"), F.lit("").alias("value"))), F.when(i % 4 == 3, F.struct(F.lit("server").alias("key"), F.lit("Shuttle/1.2").alias("value")))))
    cookies = F.when(i % 5 == 4, F.array(F.lit("_bobbin=1; Path=/"))).otherwise(F.array().cast("array<string>"))
    url = F.when(i % 7 == 5, "https://a.selvage.example/x").otherwise("https://plain.example/")
    given = load(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.concat("html", more).alias("html"), F.map_from_entries(pairs).alias("headers"), cookies.alias("set_cookies"))
    return fingerprint.detect(given, spark.createDataFrame(TECH_RULES, fingerprint.RULES), spark.createDataFrame(TECH_IMPLIES, fingerprint.IMPLIES))


# --- saved pages and handlers ---


@query("sk02_saved_pages", f"""
SELECT regexp_replace({HOST}, '[^\\p{{L}}\\p{{N}}.-]', '_', 'g') AS domain, regexp_replace({HOST}, '[^\\p{{L}}\\p{{N}}.-]', '_', 'g') || '_' || left(sha256(url), 16) || '.html' AS file, md5(html) AS digest FROM pages""")
def sk02(spark, sf_dir):
    """Written to the shared folder by domain, and read back by the data source."""
    saved.register(spark)
    path = saved.located(spark, f"{Store(spark, 'saved').base}/html")
    crawl.save_html(load(spark, sf_dir, "pages").select("url", "html"), path)
    return spark.read.format("saved_pages").load(path).select("domain", "file", F.md5("html").alias("digest"))


@query("e37_handlers", f"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'threads' ELSE 'page' END AS handler, CASE page_id % 3 WHEN 0 THEN 'r/s' ELSE {TITLE} END AS title, CASE page_id % 3 WHEN 0 THEN '[' || page_id::VARCHAR || '] T (by a)' END AS content FROM pages""")
def e37(spark, sf_dir):
    """Answers of a forum among pages: its handler reads them, pages go to the reader."""
    i = F.col("page_id")
    thread = F.concat(F.lit('{"data":{"children":[{"data":{"subreddit":"s","title":"T","score":'), i.cast("string"), F.lit(',"author":"a"}}]}}'))
    given = load(spark, sf_dir, "pages").select("page_id", F.when(i % 3 == 0, "https://www.reddit.com/r/s.json").otherwise(F.col("url")).alias("url"), F.when(i % 3 == 0, thread).otherwise(F.col("html")).alias("html"))
    text = payloads.thread_text(F.col("html"))
    threads = saved.Handler("threads", lambda: F.col("url").rlike(r"^https://(?:www\.)?reddit\.com/.*\.json$"), lambda: (text["title"], F.array_join(text["lines"], "\n")))
    read = saved.handled(given, [threads])
    return read.select("page_id", "handler", "title", F.when(F.col("handler") != "page", F.col("content")).alias("content"))

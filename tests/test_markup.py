"""Selectors, scripts, sanitizing, protection, suffixes, schedules and crawls, against brute force and on odd inputs."""

import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.operators import crawl, css, dom, keyed, lens, pages, protection, sanitize, script, suffixes
from loomspan.sources import saved

BITS = [
    "<a href='http://[x'>", "<img src='http://[y' alt=a>", "<![foo]>", "<!", "<script>", "</script>", "<div ", "class='a b'", "id=i", ">", "<ul><li>", "&#xD800;", "\ud800", "<p>text ", "<table><tr><td>", "<form action='http://[::1'>", "<video src='//['>", "</p>",
    "<meta property='og:image' content='http://[z'>", "<script type='application/ld+json'>" + "[" * 3000, "<script>window.__A={a:'\\ud800", "<style>@import url(http://[q)", "<b>" * 50, "</div>", "<h1>T", "<svg><![CDATA[ x ]]>", "<blockquote>" * 30, "\x00", "<a href=\"java\nscript:x\" onclick=1>", "`${", "eval(", "]}",
]


def odd_page(draw):
    return "".join(draw.choice(BITS) for _ in range(draw.randrange(60)))


def test_no_page_fails_a_reader(spark):
    """Malformed addresses, declarations, nesting, scripts and halves of characters: every report gives a row."""
    draw = random.Random(4)
    html = [odd_page(draw).encode("utf-8", "replace").decode() for _ in range(150)] + ["", None, "<ul><li>" * 3000 + "x", "<div>" * 5000, '<script>window.__S = {"a": "' + "words \\ud800 here " * 10 + '"}</script>']
    rows = [(i, ("http://[::1", "https://e.x/a", None, "::")[i % 4], h, {}, []) for i, h in enumerate(html)]
    given = spark.createDataFrame(rows, "page_id long, url string, html string, headers map<string,string>, set_cookies array<string>").repartition(3)
    for fmt in ("text", "markdown", "html", "llm"):
        assert pages.read_pages(given, fmt).count() == len(rows)
    for report in (pages.page_links, pages.accessibility, pages.performance, pages.page_features, pages.with_markup_risks, pages.node_scores, protection.with_protection, lambda x: pages.select(x, "a"), lambda x: pages.select_beside(x, a="b:has(i)"), pages.page_forms, pages.page_media, pages.audit):
        assert report(given.withColumn("status", F.lit(200))).write.format("noop").mode("overwrite").save() is None


def test_scripts_and_trees_never_fail():
    draw = random.Random(5)
    marks = ["window.__A", " = ", "{", "}", "[", "]", "(", ")", "'a'", '"b', "`${x}`", "`", "/re/g", "/", "\n", ";", ",", "eval", "new ", "Function", "if ", "else ", "var ", "x", ".push", ".innerHTML", "=>", "function ", "1e5", "0x", "...", "/*", "*/", "//", "\\", "?.", "é", "#", "return ", "for ", "do ", "try ", "class "]
    for _ in range(3000):
        text = "".join(draw.choice(marks) for _ in range(draw.randrange(40)))
        script.calls(text)
        script.state([text])
    deep = "window.__A = " + "[" * 5000 + "]" * 5000
    ((_, kept),) = script.state([deep])
    assert script.DEEPEST / 2 < kept.count("[") <= script.DEEPEST and script.calls("eval(" * 3000 + ")" * 3000)[:1] == ["eval"]
    with pytest.raises(script.Malformed):
        script.tokens("'open")
    assert [t.text for t in script.tokens("a = b / c / d; e = /[/]x/.test(`${ {a: '}'} }`)")] == ["a", "=", "b", "/", "c", "/", "d", ";", "e", "=", "/[/]x/", ".", "test", "(", "${ {a: '}'} }", ")"]


@pytest.mark.parametrize("bad", ["", ">", "a >", "a[", "a:odd", "li:nth-child(x)", "a,,b", "a:not(", "..x", "a[b=]", ":has()", "a!b"])
def test_selectors_that_cannot_be_read(bad):
    with pytest.raises(ValueError):
        css.compiled(bad)


def test_selectors_are_brute_force():
    """Compounds and combinators against a plain check of every element."""
    draw = random.Random(6)
    tags, classes = ["div", "p", "b"], ["x", "y"]

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(draw.randrange(4))) if depth else "t"
        return f"<{(t := draw.choice(['div', 'section', 'b']))} class='{' '.join(c for c in classes if draw.random() < 0.4)}'>{inner}</{t}>"

    def simple(n, s):
        tag, _, cls = s.partition(".")
        return (not tag or tag == n.tag) and (not cls or cls in n.get("class").split())

    def fits(n, parts):
        if not simple(n, parts[-1]):
            return False
        if len(parts) == 1:
            return True
        link, rest = parts[-2], parts[:-2]
        around = [c for c in n.parent.children if not isinstance(c, str)] if n.parent is not None else []
        at = next((i for i, s in enumerate(around) if s is n), 0)
        behind = {" ": list(n.up()), ">": [n.parent] if n.parent is not None else [], "+": around[max(0, at - 1) : at], "~": around[:at]}[link]
        return any(fits(b, rest) for b in behind)

    for _ in range(60):
        doc = dom.parse(tree(5))
        page = css.Page(doc)
        for _ in range(12):
            parts = [draw.choice(["div", "section", "b", ".x", "b.y", "div.x"])]
            while draw.random() < 0.6:
                parts += [draw.choice([" ", ">", "+", "~"]), draw.choice(["div", "b", ".x", ".y", "section.y"])]
            want = [n for n in doc.walk() if fits(n, parts)]
            assert page.select(css.compiled(" ".join(parts))) == want, parts


def naive(rules, headers, cookies, html, url):
    """All rules, one after the other, every expression on every text."""
    out = []
    for rule in rules:
        points, low = 0, [c.lower() for c in cookies]
        heads = {k.lower(): v for k, v in headers.items()}
        tests = {
            "cookies": lambda m: m.lower() in low, "cookies_prefix": lambda m: any(c.startswith(m.lower()) for c in low), "cookies_regex": lambda m: any(re.search(m, c) for c in cookies), "headers": lambda m: m[1].lower() in heads.get(m[0].lower(), "\0").lower() and m[0].lower() in heads,
            "headers_regex": lambda m: any(re.search(m, k) for k in heads), "scripts": lambda m: re.search(m, html), "html_patterns": lambda m: re.search(m, html), "url_patterns": lambda m: re.search(m, url),
        }
        for kind in protection.CLASSES:
            if any(tests[kind](m) for m in rule.signals.get(kind, ())):
                points += rule.boost[protection.KIND[kind]]
        if points:
            out.append((rule.name, min(100, points)))
    return sorted(out, key=lambda x: -x[1])


def test_protection_is_brute_force():
    draw = random.Random(7)
    more = tuple(protection.Rule(f"r{i}", "waf", {"scripts": 10, "cookies": 20, "url_patterns": 5}, {"scripts": (rf"(?i)tok{i}|T{i}x", rf"a{i % 7}.*b"), "cookies_regex": (rf"^c{i}$",), "cookies_prefix": (f"p{i}",), "url_patterns": (rf"/(?:u{i}|v{i})/", "[0-9]{9}")}) for i in range(40))
    rules = protection.RULES + more
    matcher = protection.Matcher(rules)
    words = ["TOK3", "t7x", "T8x", "a5 b", "js.datadome.co", "class='g-recaptcha'", "FingerprintJS.load", "x"]
    for _ in range(400):
        headers = {draw.choice(["Server", "X-IINFO", "x-akamai-z", "CF-Ray"]): draw.choice(["CloudFlare", "", "nginx"]) for _ in range(2)}
        cookies = [draw.choice(["c3", "P12z", "_PXvid", "TS0123abcd", "__cf_bm", "z"]) for _ in range(2)]
        html, url = " ".join(draw.choice(words) for _ in range(4)), draw.choice(["https://a.okta.com/x", "http://h/u5/", "http://h/123456789", "http://h/"])
        assert [(n, c) for n, _, c, _ in matcher.match(headers, cookies, html, url)] == naive(rules, headers, cookies, html, url)
    assert protection.needed_texts("(?:abc|de)x") is None and protection.needed_texts("(?:abc|defg)x?") == {"abc", "defg"} and protection.needed_texts("a*long(?:text)?") == {"long"}


def test_suffixes_are_brute_force(spark):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "b.c.d", "*.x.y", "", "COM"]

    def brute(name):
        labels = name.lower().strip(". ").split(".")
        found, exc = 1, None
        for rule in rules:
            r = rule.lower().lstrip("!").split(".")
            if rule and len(r) <= len(labels) and all(a in ("*", b) for a, b in zip(r, labels[-len(r) :])):
                exc, found = (len(r) - 1, found) if rule.startswith("!") else (exc, max(found, len(r)))
        k = exc if exc is not None else found
        return ".".join(labels[-k:]), ".".join(labels[-k - 1 :]) if k < len(labels) else None

    names = ["a.com", "com", "a.b.co.uk", "co.uk", "www.ck", "a.www.ck", "z.ck", "a.z.ck", "ck", "q.b.c.d", "c.d", "p.q.x.y", "q.x.y", "x.y", "A.Com.", "local", ".".join("l" * 60)]
    got = {r.name: (r.suffix, r.site) for r in suffixes.suffixes(spark.createDataFrame([(n,) for n in [*names, None, "", names[0]]], "name string"), spark.createDataFrame([(r,) for r in rules], "rule string")).collect()}
    assert got == {n.lower().strip("."): brute(n) for n in names}


@pytest.mark.parametrize("block", [7, 65_536])
def test_schedule_is_a_fold(spark, block):
    """A hot key over many blocks, keys of one request, marks, ties, nulls."""
    draw = random.Random(block)
    rows = [("hot" if draw.random() < 0.7 else f"d{draw.randrange(20)}", float(draw.randrange(300)), i, None if draw.random() < 0.9 else float(draw.randrange(400)), 0.0) for i in range(400)]
    rows = [(d, t, i, u, float(len(d)) / 2 if d != "d3" else None) for d, t, i, u, _ in rows] + [(None, 1.0, 900, None, 1.0), ("d1", None, 901, None, 1.0)]
    want, state = {900: None, 901: None}, {}
    for d, t, i, u, delay in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        start, held = state.get(d, (None, None))
        at = max([t] + ([start + (delay or 0)] if start is not None else []) + ([held] if held is not None else []))
        state[d] = (at, max((x for x in (held, u) if x is not None), default=None))
        want[i] = at
    given = spark.createDataFrame(rows, "domain string, ts double, seq long, until double, delay double").repartition(5)
    got = {r.seq: r.start for r in keyed.schedule(given, block=block).collect()}
    assert got.keys() == want.keys() and all(want[i] is got[i] is None or abs(got[i] - want[i]) < 1e-6 for i in want)


def test_crawl_keeps_one_set_of_bodies_and_heeds_robots_first(spark):
    page = lambda title, *to: f"<title>{title}</title>" + "".join(f'<a href="{x}">l</a>' for x in to)
    store = [("https://s.x/a", page("A", "/b", "/private/p", "/z")), ("https://s.x/b", page("B", "/c")), ("https://s.x/c", page("B", "/c")), ("https://s.x/private/p", "<p>secret body</p>"), ("https://s.x/z", "<p>secret body</p>")]
    robots = spark.createDataFrame([("s.x", "User-agent: *\nDisallow: /private/\n")], "host string, body string")
    seeds = spark.createDataFrame([("https://s.x/a",)], "url string")
    got = {r.url[len("https://s.x/") :]: (r.depth, r.error, r.title) for r in crawl.crawl(spark, seeds, spark.createDataFrame(store, "url string, html string"), robots).collect()}
    assert got == {"a": (0, None, "A"), "b": (1, None, "B"), "private/p": (1, "blocked by robots", None), "z": (1, None, ""), "c": (2, "duplicate content", None)}


def test_saved_pages_are_read_as_they_were(spark, tmp_path):
    """What the writers put into their folders, byte for byte."""
    rows = [(i, f"https://h{i % 2}.x/p{i}", None if i == 3 else f"<p>line {i}\r\nnext é</p>\n", 200, f"# T{i}\n\ntext" if i % 2 else "") for i in range(6)]
    given = spark.createDataFrame(rows, "page_id long, url string, html string, status int, markdown string")
    crawl.save_html(given.select("url", "html"), f"{tmp_path}/html")
    saved = spark.read.text(f"{tmp_path}/html", wholetext=True)
    names = given.where("html is not null").select(crawl.domain_name(F.col("url")).alias("domain"), crawl.file_name(F.col("url")).alias("file"), "html")
    assert sorted((r.domain, r.file, r.value) for r in saved.collect()) == sorted((r.domain, r.file, r.html + "\n") for r in names.collect())  # the writer ends a file with a line's end
    crawl.save_markdown(given.select("url", "status", "markdown", "page_id"), f"{tmp_path}/md", "page_id")
    index = {r.url: r.file for r in spark.read.json(f"{tmp_path}/md/index").collect()}
    assert index == {f"https://h1.x/p{i}": f"page_{n:04d}.md" for n, i in enumerate((1, 3, 5))}
    texts = {r.file: r.value.removesuffix("\n") for r in spark.read.text(f"{tmp_path}/md/pages", wholetext=True).collect()}
    assert texts == {f"page_{n:04d}.md": f"# T{i}\n\ntext" for n, i in enumerate((1, 3, 5))}


def test_lens_ways_and_brackets():
    assert lens.balanced("({'a)': \"]\"})x", 0) == 13 and lens.balanced("([)", 0) == -1 and lens.balanced("(", 0) == -1
    assert lens.matches("<script>google.ldi={broken</script><a href='https://a.example/x'>A</a>") == ("links", [("https://a.example/x", "A")])
    assert lens.matches("AF_initDataCallback({data:[[\"https://b.example/long-path\"") == ("none", [])


def test_sanitizer_leaves_no_risk():
    draw = random.Random(8)
    for _ in range(300):
        doc = dom.parse(odd_page(draw))
        clean = dom.parse(sanitize.sanitized(doc))
        assert sanitize.lost(clean) == (0, 0) and not clean.find("script", "style", "form")


def test_copies_of_a_url_are_saved_apart(spark, tmp_path):
    rows = [("https://h.x/p", f"<p>{i // 2}</p>\n") for i in range(8)] + [("https://h.x/q", "q")]
    crawl.save_html(spark.createDataFrame(rows, "url string, html string").coalesce(1), f"{tmp_path}/html")
    saved.register(spark)
    got = spark.read.format("saved_pages").load(f"{tmp_path}/html").collect()
    assert sorted(r.html for r in got) == sorted(h for _, h in rows) and len({r.file for r in got}) == 2


def test_driver_knows_parts_of_saved_pages_not_pages(spark, tmp_path):
    rows = [(f"https://h{i}.x/p", f"<p>{i}</p>") for i in range(1100)] + [("https://hot.x/p", "same")] * 900 + [(None, "no address")]
    given = spark.createDataFrame(rows, "url string, html string").repartition(2)
    saved.register(spark)
    for _ in range(2):  # the second time overwrites the first
        crawl.save_html(given, f"{tmp_path}/html")
        read = spark.read.format("saved_pages").load(f"{tmp_path}/html")
        assert read.rdd.getNumPartitions() <= 6  # about 1,000 pages of each task, by 500
        assert sorted(r.html for r in read.collect()) == sorted(h for _, h in rows)
    assert read.where("domain = 'unknown'").collect() == [("unknown", None, "no address")]
    assert read.select("domain", "file").distinct().count() == 1102
    parts = saved._Reader(f"{tmp_path}/html").partitions()
    assert len(pickle.dumps(parts)) < 2000
    given.limit(0).select(F.lit("d").alias("domain"), F.lit("f").alias("file"), "html").write.format("saved_pages").mode("overwrite").save(f"{tmp_path}/html")
    assert read.sparkSession.read.format("saved_pages").load(f"{tmp_path}/html").count() == 0


def test_saved_pages_leave_nothing_of_failed_attempts(spark, tmp_path):
    saved.register(spark)
    given = spark.createDataFrame([("a/b", "x=%", "one"), ("", "y", "two")], "domain string, file string, html string")
    given.write.format("saved_pages").mode("append").save(f"{tmp_path}/html")
    broken = F.when(F.col("html") == "two", F.raise_error(F.lit("broken"))).otherwise(F.col("html"))
    with pytest.raises(Exception, match="broken"):
        given.coalesce(1).withColumn("html", broken).write.format("saved_pages").mode("overwrite").save(f"{tmp_path}/html")
    given.write.format("saved_pages").mode("append").save(f"{tmp_path}/html")
    got = spark.read.format("saved_pages").load(f"{tmp_path}/html").collect()
    assert sorted((r.file, r.html, r.domain) for r in got) == [("x=%", "one", "a/b")] * 2 + [("y", "two", None)] * 2
    writer = saved._Writer(f"{tmp_path}/html", ["domain", "file"], True)
    left = tmp_path / "html" / f"task={writer.job}-0-7" / "part=0"
    left.mkdir(parents=True)
    writer.commit([saved.Written(f"task={writer.job}-0-8")])
    assert [x.name for x in (tmp_path / "html").iterdir()] == ["_SUCCESS"]
    with pytest.raises(Exception, match="not|No such"):
        spark.read.format("saved_pages").load(f"{tmp_path}/gone").collect()
    assert saved.located(spark, f"{tmp_path}/html") == f"file:{tmp_path}/html" and saved.located(spark, "file:///a") == "file:/a"

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import cleanup, crawl, dom, fusion, keyed, pages, security
from loomspan.sources.tables import load, responses

from .conftest import SMALL

ARTICLE = "<html><head><title>T</title></head><body><nav><a href='/n'>nav</a></nav><div class='ad'>buy</div><article><h1>Head</h1><p>" + "Plain words of the story. " * 30 + "</p><ul><li>one<li>two</ul><p><b>bold</b> <a href='/x'>link</a></p></article><footer>foot</footer></body></html>"


def test_noise():
    cases = {
        "<nav>x</nav>": True, "<div class='ad-top'>x</div>": True, "<div class='UnderlineNav'>x</div>": False, "<div id='onetrust-banner'>x</div>": True, "<div hidden>x</div>": False, "<p style='display: none'>x</p>": True,
        "<div class='sidebar'>" + "w " * 3000 + "</div>": False, "<form>" + "w " * 300 + "</form>": False, "<form class='newsletter'>" + "w " * 300 + "</form>": True, "<div id='header-root'>x</div>": False, "<div role='banner'>x</div>": True,
    }
    for html, want in cases.items():
        assert dom.is_noise(dom.parse(html).children[0]) is want, html


def test_extraction_formats():
    text = dom.extract(ARTICLE, "https://e.x/p")["content"]
    assert "Plain words" in text and "buy" not in text and "foot" not in text
    md = dom.extract(ARTICLE, "https://e.x/p", "markdown")["content"]
    assert md.startswith("# Head") and "* one\n* two" in md and "**bold**" in md and "[link](https://e.x/x)" in md
    assert dom.extract("", "u")["content"] == ""


def test_gate_takes_the_whole_page():
    body = "<p>" + "outside words " * 200 + "</p>"
    found = dom.extract(f"<body>{body}<article class='content'><p>{'tiny text inside here ' * 4}</p></article></body>")
    assert found["note"] == "extraction_rejected_low_text_ratio" and "outside" in found["content"]


def test_broken_markup():
    doc = dom.parse("<p><b>open<br><p>next<script>var t='</p>'</script><ul><li>a<li>b</ul>")
    assert [p.text for p in doc.find("p")][:1] == ["open"] and len(doc.find("li")) == 2 and "var" not in doc.visible()


def test_forms_and_media():
    f = dom.forms(dom.parse("<form action='/s' method=post><input name=a value=1><input name=b disabled value=2><select name=c><option value=x><option value=y selected></select><textarea name=d>t u</textarea></form>"))[0]
    assert f["method"] == "POST" and dom.form_data(f) == "a=1&c=y&d=t+u"
    m = dom.media(dom.parse("<meta property='og:image' content='/o.jpg'><img src='/a.png' width=50 height=50><img srcset='/s.jpg 100w, /b.jpg 900w'><img src='/site-logo.png'><video src='v.mp4'></video><script type='application/ld+json'>{\"@graph\":[{\"@type\":\"VideoObject\",\"contentUrl\":\"https://c/v.webm\"}]}</script>"), "https://h/")
    assert [(x["url"], x["kind"]) for x in m] == [("https://h/o.jpg", "image"), ("https://h/b.jpg", "image"), ("https://h/v.mp4", "video"), ("https://c/v.webm", "video")]


def test_islands_and_script_state():
    doc = dom.parse('<script type="application/json">{"x":{"heading":"A Heading","body":"This is a body of enough words."},"quote":"Such a fine thing it is","author":"Me"}</script><script>window.__DATA = {"k": "' + "v" * 120 + '"};</script>')
    assert "## A Heading\n\nThis is a body of enough words." in dom.data_island(doc, "") and "> — Me" in dom.data_island(doc, "")
    assert [n for n, _ in dom.script_state(doc)] == ["__DATA"]


STEP_CASES = {
    "decode_entities": [("&amp;lt; &#65; &#x42; &nope;", "&lt; A B &nope;")],
    "strip_leaked_js": [("text self.__next_f", "text"), ("```\nself.__x\n```", "```\nself.__x\n```")],
    "collapse_spaced": [("S t a r t now", "Start now")],
    "linked_images": [("[![alt](i.png)](l)", "[alt](l)\n")],
    "collapse_logos": [("![A](a)\n\n![B](b)\ntext", "A, B\ntext"), ("![A](a)\ntext", "text")],
    "strip_bare_image_refs": [("pic.png\nok", "ok")],
    "strip_emphasis": [("**a** __b__ *c* _d_", "a b c d")],
    "strip_ui_controls": [("menu next 3\nmenu of the day", "menu of the day")],
    "strip_bare_numbers": [("a\n\n42\n\nb", "a\n\n\nb"), ("a\n42\nb", "a\n42\nb")],
    "dedup_vs_headings": [("# Title\ntitle\nmore", "# Title\nmore")],
    "strip_empty_headings": [("## Footer\n# ok\n## ---", "# ok")],
    "collapse_ws": [("a  \n\n\n\nb\n", "a\n\nb")],
    "dedup_blocks": [("The same block of words here.\n\nThe same block of words here.\n\nother", "The same block of words here.\n\nother")],
    "dedup_commas": [("a, b, c, a, b, c", "a, b, c")],
    "strip_trailing_headings": [("# a\ntext\n## b\n## c\n", "# a\ntext\n")],
    "strip_css_classes": [("flex p-4 mt-2 word", None), ("plain words here", "plain words here")],
    "merge_stats": [("99%\n\nof all users", "99% of all users")],
    "dedup_phrases": [("one two three one two three end", "one two three end")],
}


def test_steps():
    for name, cases in STEP_CASES.items():
        for given, want in cases:
            assert cleanup.STEPS[name](given) == (want or ""), (name, given)


def test_blank_step_is_idempotent():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(" \na.") for _ in range(40))
        once = cleanup.tidy_blanks(t)
        assert cleanup.tidy_blanks(once) == once


def test_links_are_collected():
    text, links = cleanup.clean("Read [the guide](https://a/b) or [reply](https://a/c), [the guide](https://a/b).")
    assert text == "Read the guide or reply, the guide." and links == [("the guide", "https://a/b")]


def test_budget_is_the_sequential_fold(spark):
    rng = random.Random(4)
    for _ in range(4):
        rows = [(i, rng.choice(["/a/x", "/a/b/y", "/c", "/d/e"])) for i in range(60)]
        limits = {p: rng.randrange(12) for p in rng.sample(["*", "/a", "/a/b", "/d"], 3)}
        used, want = dict.fromkeys(limits, 0), {}
        for i, path in rows:
            p = max((k for k in limits if k != "*" and path.startswith(k)), key=len, default=None)
            ok = ("*" not in limits or used["*"] < limits["*"]) and (p is None or used[p] < limits[p])
            want[i] = ok
            for k in (p, "*"):
                if ok and k in limits:
                    used[k] += 1
        got = {r.seq: r.allowed for r in crawl.within_budget(spark.createDataFrame(rows, "seq int, path string"), limits).collect()}
        assert got == want


def test_robots(spark):
    body = "User-agent: bot\nUser-agent: other\nDisallow: /p\nAllow: /p/ok$\n\nUser-agent: *\nDisallow: /\n"
    rules = crawl.robots_rules(spark.createDataFrame([("h.x", body)], "host string, body string"), "mybot/1")
    urls = ["https://h.x/p/a", "https://h.x/p/ok", "https://h.x/p/okay", "https://h.x/q", "https://other.x/p"]
    got = {r.url: r.allowed for r in crawl.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert [got[u] for u in urls] == [False, True, False, True, True]


def test_crawl(spark):
    page = lambda *hrefs, t="": f"<title>{t}</title>" + "".join(f"<a href='{h}'>x</a>" for h in hrefs)
    store = [("https://s.x/", page("/a", "/b", "/b#f", "https://away.y/", "mailto:x", t="home")), ("https://s.x/a", page("/c", "/blocked", t="a")), ("https://s.x/b", page("/c", t="a").replace("/c", "/c")), ("https://s.x/c", page("/d", t="c")), ("https://s.x/d", "d")]
    store[2] = ("https://s.x/b", store[1][1])
    got = crawl.crawl(spark, spark.createDataFrame([("https://s.x",)], "url string"), spark.createDataFrame(store, "url string, html string"), spark.createDataFrame([("s.x", "User-agent: *\nDisallow: /blocked")], "host string, body string"), crawl.CrawlConfig(max_depth=2))
    rows = {r.url: (r.depth, r.error) for r in got.collect()}
    assert rows == {"https://s.x/": (0, None), "https://s.x/a": (1, None), "https://s.x/b": (1, "duplicate content"), "https://s.x/c": (2, None), "https://s.x/blocked": (2, "blocked by robots")}
    assert crawl.crawl_summary(got).head().pages == 3


def test_fusion_ignores_the_order_of_rows(spark):
    rows = [(li, r, u, f"t{li}{r}", f"e{li}") for li, us in enumerate((["a", "b", ""], ["b", "c"], ["c", "a"])) for r, u in enumerate(us)]
    schema = "list int, rank int, url string, title string, engine string"
    one = [tuple(r) for r in fusion.fuse(spark.createDataFrame(rows, schema)).collect()]
    two = [tuple(r) for r in fusion.fuse(spark.createDataFrame(rows[::-1], schema).repartition(3)).collect()]
    assert one == two and [r[0] for r in one] == ["b", "a", "c"] or one[0][1] >= one[-1][1]


def test_streams(spark):
    schema = "array<struct<kind:string,url:string,height:int,bitrate:int,ciphered:boolean>>"
    rows = [([("combined", "c360", 360, 1, False), ("combined", "c360b", 360, 1, False), ("video", "v720", 720, 5, False), ("video", "v1080", 1080, 5, False), ("video", "vx", 700, 9, True), ("audio", "a1", None, 3, False)],), ([("combined", "c720", 720, 1, False), ("video", "v720", 720, 9, False)],)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, f"s {schema}").select(fusion.select_streams(F.col("s"), 720)).collect()]
    assert got == [("v720", "a1", 720), ("c720", None, 720)]


def test_rate_limit(spark):
    rows = [(1, i, float(t)) for i, t in enumerate([0, 1, 2, 9, 10, 11, 12, 21])]
    got = {r.event_id: r.allowed for r in keyed.rate_limit(spark.createDataFrame(rows, "user_id long, event_id long, ts double"), 2, 10.0).collect()}
    assert [got[i] for i in range(8)] == [True, True, False, False, True, True, False, True]


@pytest.mark.parametrize("block", [7, 64, 262_144])
def test_rate_limit_in_blocks_is_the_fold(spark, block):
    rnd = random.Random(block)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), i, float(rnd.randrange(300))) for i in range(400)] + [(1, 400, None), (9, 401, 5.0)]
    want, state = {}, {}
    for k, i, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        start, n = state.get(k, (None, 0))
        start, n = (t, 1) if start is None or t - start >= 11.0 else (start, n + 1)
        state[k], want[i] = (start, n), n <= 3
    want[400] = None
    frame = spark.createDataFrame(rows, "user_id long, event_id long, ts double").repartition(3)
    assert {r.event_id: r.allowed for r in keyed.rate_limit(frame, 3, 11.0, block=block).collect()} == want
    assert keyed.rate_limit(frame.limit(0), 3, 11.0, block=block).collect() == []


@pytest.mark.parametrize("block", [5, 50, 262_144])
def test_evicting_cache_in_blocks_is_the_fold(spark, block):
    rnd = random.Random(block)
    rows = [(rnd.choice([None, *"aaaabcdefgh"]), float(i // 2), i, rnd.choice(["read", "write"]), i * 2) for i in range(300)]
    want, cache = {}, {}
    for k, t, i, kind, _ in rows:
        want[i] = None if kind == "write" else k in cache and t - cache[k] < 12.0
        if kind == "write":
            cache.pop(k, None)
            cache[k] = t
            if len(cache) > 4:
                del cache[next(iter(cache))]
    frame = spark.createDataFrame(rows, "key string, ts double, seq long, kind string, extra long").repartition(3)
    got = keyed.live_until_evicted(frame, 12.0, 4, block=block)
    assert got.columns == [*frame.columns, "hit"] and {r.seq: r.hit for r in got.collect()} == want
    assert all(r.extra == 2 * r.seq for r in got.collect()) and keyed.live_until_evicted(frame.limit(0), 12.0, 4).collect() == []


def test_scan_has_all_parts(spark):
    rows = responses(load(spark, SMALL, "pages"))
    got = security.scan(rows).select("page_id", "score", "grade", "csp_grade", "counts").collect()
    assert len(got) == 50 and all(r.counts.total == sum(r.counts[:5]) for r in got)


def test_bad_responses(spark):
    html = "<!-- TODO: password=1 --><form method=post action='http://x/y'><input type=hidden name=id></form><a href='javascript:x()' onclick=\"y\">10.1.2.3</a>\n//# sourceMappingURL=a.map"
    row = spark.createDataFrame([(1, "https://h.x/?token=1", html, 200, {"server": "nginx/1.2"}, ["sid=1; Domain=.x"])], "page_id long, url string, html string, status int, headers map<string,string>, set_cookies array<string>")
    checks = {f.check for f in security.scan(row).select(F.explode("findings").alias("f")).select("f.*").collect()}
    assert checks >= {"private_ip", "suspicious_comment", "sensitive_url_param", "insecure_form_action", "form_no_csrf_token", "exposed_source_map", "xss_javascript_url", "xss_event_handlers", "server", "secure", "httponly", "domain"}


def test_read_pages(spark):
    rows = spark.createDataFrame([(1, "https://e.x/p", ARTICLE), (2, "https://e.x/q", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.read_pages(rows, "llm", max_bytes=200).collect()}
    assert got[1].length <= 203 and got[1].content.startswith("> URL: https://e.x/p") and got[1].title == "T" and got[2].title == ""


def test_steps_that_are_skipped_change_nothing():
    """Triggers and quick ways out against the steps themselves."""
    import random

    draw = random.Random(3)
    words = ["a", "b", "S", "t", "close", "Search", "←", "x.PNG", "an image of ", "*i*", "**b**", "_u_", "prose", "the", "İx", "ΑΣ", "your browser does not support", "```", "# H", "\n", "\n", ","]
    for _ in range(1500):
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(30)))
        for name in cleanup.TRIGGERS:
            if not cleanup.TRIGGERS[name](text):
                assert cleanup.STEPS[name](text) == text, (name, text)
    assert {"collapse_spaced", "strip_bare_image_refs", "strip_ui_controls", "strip_ui_controls_again", "strip_long_alt"} <= cleanup.TRIGGERS.keys()
    phrase = " ".join(f"w{i}" for i in range(7))
    assert cleanup._phrases(f"one {phrase} {phrase} two") == f"one {phrase} two"
    plain = " ".join(f"v{i % 50}{'x' * (i // 50)}" for i in range(400))
    assert cleanup._phrases(plain) == plain

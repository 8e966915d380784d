"""Queries on written cases: each row of pages gives every case its number, so inputs differ from row to row, and the SQL says what must come out.

``{id}`` stands for the page_id in a case's input and in what is wanted.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cleanup, dom, pages, security, technology
from ..sources.tables import load, repr_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def inputs(spark, sf_dir: str, cases: list[tuple[str, str]]) -> DataFrame:
    """page_id, case_no, html: every case for every page."""
    table = F.array(*(F.struct(F.lit(i).alias("case_no"), F.lit(x).alias("html")) for i, (x, _) in enumerate(cases)))
    flat = load(spark, sf_dir, "pages").select("page_id", F.explode(table).alias("c"))
    return flat.select("page_id", "c.case_no", F.replace("c.html", F.lit("{id}"), F.col("page_id").cast("string")).alias("html"))


def register(name: str, cases: list[tuple[str, str]], run: Callable[[DataFrame], DataFrame]) -> None:
    """``run`` takes page_id, case_no, html and returns page_id, case_no, got."""
    QUERIES[name] = lambda spark, sf_dir: run(inputs(spark, sf_dir, cases)).select("page_id", "case_no", "got")
    wants = ", ".join(f"({i}, {repr_sql(w)})" for i, (_, w) in enumerate(cases))
    SQL[name] = f"SELECT p.page_id, c.case_no, replace(c.want, '{{id}}', p.page_id::VARCHAR) AS got FROM pages p, (VALUES {wants}) AS c(case_no, want)"


def by_kernel(make: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    def run(rows: DataFrame) -> DataFrame:
        return pages._beside(rows, ["html"], ["html"], [("got", "string", pa.string())], lambda r: (make(r["html"]),))

    return run


def by_column(make: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.select("page_id", "case_no", make(F.col("html")).alias("got"))


def _noise(html: str) -> str:
    """Whether the element with the id x is boilerplate, and whether it or one above it is."""
    n = next(n for n in dom.parse(html).walk() if n.get("data-x"))
    return f"{str(dom.is_noise(n)).lower()} {str(dom.noisy(n, {})).lower()}"


STORY = "Plain words of story {id} go on here. " * 8
register(
    "e06_e07_noise_cases",
    [
        ("<nav data-x=1>a {id}</nav>", "true true"), ("<div data-x=1 class='ad-top'>a {id}</div>", "true true"), ("<div data-x=1 class='UnderlineNav'>a</div>", "false false"), ("<div data-x=1 id='onetrust-{id}'>a</div>", "true true"),
        ("<div data-x=1 hidden>a</div>", "false false"), ("<p data-x=1 style='display: none'>a</p>", "true true"), ("<div data-x=1 class='sidebar'>" + "w " * 3000 + "</div>", "false false"), ("<form data-x=1>a {id}</form>", "true true"),
        ("<form data-x=1>" + "w " * 300 + "</form>", "false false"), ("<form data-x=1 class='newsletter'>" + "w " * 300 + "</form>", "true true"), ("<div data-x=1 id='header-root'>a</div>", "false false"), ("<div data-x=1 role='banner'>a</div>", "true true"),
        ("<footer><p data-x=1>a {id}</p></footer>", "false true"), ("<div data-x=1 class='btn-load-more md:header-lg'>a</div>", "false false"), ("<span data-x=1 aria-hidden='true'>a</span>", "true true"),
    ],
    by_kernel(_noise),
)


def _score(html: str) -> str:
    n = next(n for n in dom.parse(html).walk() if n.get("data-x"))
    return f"{dom.node_score(n):.6f}"


register(
    "e09_score_cases",
    [
        ("<div data-x=1>short</div>", "0.000000"), ("<div data-x=1>" + "a" * 100 + "</div>", "4.605170"), ("<article data-x=1>" + "a" * 100 + "</article>", "54.605170"), ("<div data-x=1 class='post-body'>" + "a" * 100 + "</div>", "29.605170"),
        ("<div data-x=1 id='main-content'><p>" + "a" * 100 + "</p></div>", "32.605170"), ("<div data-x=1><a>" + "a" * 60 + "</a>" + "a" * 40 + "</div>", "0.460517"), ("<div data-x=1><a>" + "a" * 40 + "</a>" + "a" * 60 + "</div>", "2.302585"),
        ("<article data-x=1><a>" + "a" * 60 + "</a>" + "a" * 40 + "</article>", "27.302585"), ("<div data-x=1 role='main'><a>" + "a" * 80 + "</a>" + "a" * 20 + "</div>", "16.381551"),
    ],
    by_kernel(_score),
)


def _page(body: str, head: str = "<title>Page {id}</title>") -> str:
    return f"<!DOCTYPE html><html lang=\"en\"><head>{head}</head><body>{body}</body></html>"


def _extract(fmt: str) -> Callable[[str], str]:
    return lambda html: dom.extract(html, "https://site.example/a/b", fmt)["content"]


register(
    "e10_e12_e25_text_cases",
    [
        (_page(f"<nav>menu</nav><article><p>{STORY}</p></article><footer>foot</footer>"), STORY.strip()),
        (_page(f"<div class='x'>only {{id}}</div><main>{STORY}</main><aside>{STORY}{STORY}</aside>"), STORY.strip()),
        (_page("<p>no candidate holds enough {id}</p>"), "no candidate holds enough {id}"),
        ("", ""),
        (_page(f"<div class='wrap'><article class='first'>{STORY}</article><section>{'beside words {id} of it ' * 12}</section><div>too few words</div></div>"), (STORY + "beside words {id} of it " * 12).strip()),
        (_page(f"<div id='a' class='content'>{STORY}</div><div id='b' class='content'>{STORY.replace('story', 'other')}</div>"), STORY.strip()),
        (_page(f"<p>{'outside words {id} ' * 200}</p><article class='content'><p>{'tiny text inside here ' * 4}</p></article>"), ("outside words {id} " * 200 + "tiny text inside here " * 4).strip()),
    ],
    by_kernel(_extract("text")),
)
register(
    "e21_note_cases",
    [
        (_page(f"<p>{'outside words {id} ' * 200}</p><article class='content'><p>{'tiny text inside here ' * 4}</p></article>"), "extraction_rejected_low_text_ratio"),
        (_page(f"<nav>menu</nav><article><p>{STORY}</p></article>"), ""), (_page("<article>a short page {id}</article>"), ""),
    ],
    by_kernel(lambda html: dom.extract(html)["note"] or ""),
)
register(
    "e08_e12_html_cases",
    [
        (_page(f"<article><h1>A &amp; B</h1><p>{STORY}<br><p>next<ul><li>one<li>two</ul></article>"), f"<article><h1>A &amp; B</h1><p>{STORY}<br></p><p>next</p><ul><li>one</li><li>two</li></ul></article>"),
        (_page(f"<article><img src='/i.png' alt='\"{{id}}\"'>{STORY}</article>"), f'<article><img src="/i.png" alt="&quot;{{id}}&quot;">{STORY}</article>'),
    ],
    by_kernel(_extract("html")),
)
register(
    "e13_e24_markdown_cases",
    [
        (_page(f"<article><h1>Head {{id}}</h1><p>{STORY}</p><ul><li>one<li>two</ul><p><b>bold</b> <a href='/x'>link</a></p></article>"), f"# Head {{id}}\n\n{STORY.strip()}\n\n* one\n* two\n\n**bold** [link](https://site.example/x)"),
        (_page(f"<h1>Outside {{id}} →</h1><p>{'A lead for the page, long enough to count.'}</p><article><p>{STORY}</p></article>"), f"# Outside {{id}}\n\nA lead for the page, long enough to count.\n\n{STORY.strip()}"),
        (_page(f"<article><div class='share'>tweet this</div><p>{STORY}</p><pre>x = {{id}}\ny</pre><blockquote><p>said</p></blockquote></article>"), f"{STORY.strip()}\n\n```\nx = {{id}}\ny\n```\n\n> said"),
        (_page(f"<article><table><tr><th>a<th>b</tr><tr><td>{{id}}<td>2</tr></table><hr><p>{STORY}</p><ol><li>x</li></ol></article>"), f"| a | b |\n| --- | --- |\n| {{id}} | 2 |\n\n---\n\n{STORY.strip()}\n\n1. x"),
        (_page(f"<div role='region' aria-label='Announcement bar'>Sale {{id}}</div><article><p>{STORY}</p></article>"), f"> **Sale {{id}}**\n\n{STORY.strip()}"),
        (_page(f"<article><p>{STORY}</p></article><footer><h2>Get started {{id}}</h2><a href='https://docs.site.example/'>Docs</a><a href='/about'>About</a></footer>"), f"{STORY.strip()}\n\n## Get started {{id}}\n\n* [Docs](https://docs.site.example/)"),
        (_page(f"<article><p>{STORY}</p></article><footer>" + "".join(f"<div><h4>G{i}</h4><ul><li><a href='/p'>Page {i}</a><li><a href='/q'>Quote {i}</a><li><a href='/m'>more</a></ul></div>" for i in range(3)) + "</footer>"), f"{STORY.strip()}\n\n**G0**: Page 0, Quote 0\n**G1**: Page 1, Quote 1\n**G2**: Page 2, Quote 2"),
        (_page(f"<article><section><p>New in {{id}}</p><h2>Faster parts</h2><p>{STORY}</p></section></article>").replace("<p>New in {id}</p>", "<p class='ad'>New in {id}</p>"), f"*New in {{id}}*\n\n## Faster parts\n\n{STORY.strip()}"),
    ],
    by_kernel(_extract("markdown")),
)
register(
    "e24_whole_markdown_cases",
    [("<nav><a href='/n'>Nav {id}</a></nav><h2>Two</h2>text<br>more<p><em>so</em> <code>c</code></p>", "[Nav {id}](https://site.example/n)\n\n## Two\n\ntext\nmore\n\n*so* `c`"), ("<img src='p.png' alt='A {id}'>", "![A {id}](https://site.example/a/p.png)")],
    by_kernel(lambda html: dom.to_markdown(html, "https://site.example/a/b")),
)
register(
    "e20_join_cases",
    [("/x{id}", "https://site.example/x{id}"), ("c?d={id}", "https://site.example/a/c?d={id}"), ("//cdn.example/{id}", "https://cdn.example/{id}"), ("../{id}", "https://site.example/{id}"), ("https://other.example/{id}", "https://other.example/{id}"), ("#f{id}", "https://site.example/a/b#f{id}")],
    by_kernel(lambda href: dom.join_url("https://site.example/a/b", href)),
)
_ISLAND = "<article>short {id} text of a page that shows hardly any words at all to its readers</article>"
_SHOWN = "short {id} text of a page that shows hardly any words at all to its readers"
register(
    "e26_e33_js_state_cases",
    [
        (_page(_ISLAND + '<script type="application/json">{"hero": {"heading": "Big {id} news", "body": "A body of some readable words for {id}."}}</script>'), _SHOWN + "\n\n## Big {id} news\n\nA body of some readable words for {id}."),
        (_page(_ISLAND + '<script type="application/json">{"a": {"nodeType": "document", "content": [{"nodeType": "heading-2", "content": [{"value": "Rich {id}"}]}, {"nodeType": "paragraph", "content": [{"value": "Rich words"}]}]}}</script>'), _SHOWN + "\n\n## Rich {id}\n\nRich words"),
        (_page(_ISLAND + '<script type="application/json">{"q": {"quote": "It works well for us, they said {id}.", "author": "Ann Bell"}, "pad": "................"}</script>'), _SHOWN + "\n\n> It works well for us, they said {id}.\n> — Ann Bell"),
        (_page(_ISLAND + '<script>window.__STATE = {"a": ["Some readable words of state {id}", "https://no.example/x", "' + "z" * 80 + '"]};</script>'), _SHOWN + "\n\n## Additional Content\n\nSome readable words of state {id}"),
        (_page(_ISLAND + """<script>self.__next_f.push([1,"1:[\\"$\\",\\"p\\",null,{\\"children\\":\\"Streamed readable words {id} here\\"}]\\n"])</script>"""), _SHOWN + "\n\n## Additional Content\n\nStreamed readable words {id} here"),
        (_page(_ISLAND + '<script type="application/json">{"a": {"headline": "A headline of some words {id}"}, "b": {"eyebrow": "An eyebrow of some words {id}"}}</script>'), _SHOWN + "\n\n## A headline of some words {id}\n\nAn eyebrow of some words {id}"),
        (_page("<article>" + STORY * 8 + "</article>" + '<script type="application/json">{"hero": {"heading": "Big {id} news", "body": "A body of some readable words for {id}."}}</script>'), (STORY * 8).strip()),
    ],
    by_kernel(_extract("text")),
)
register(
    "js04_readable_cases",
    [("Readable words number {id} here", "true"), ("https://x.example/{id} and more text", "false"), ("short {id}", "false"), ("{{{{{{{{ }}}}}}} ;;;; {id} ((()))", "false"), ("file name of a thing {id}.css", "false")],
    by_kernel(lambda t: str(dom.readable(t) is not None).lower()),
)


LINE_STEPS: dict[str, list[tuple[str, str]]] = {
    "decode_entities": [("a &amp; b &#65;&#x42; &nbsp;{id} &bogus; &mdash;", "a & b AB  {id} &bogus; —")],
    "strip_invisible": [("a​b͏c⁢{id}⁡", "abc{id}⁡")],
    "strip_leaked_js": [("text {id} self.__next_f.push(1)\nself.__x\nkept", "text {id}\nkept"), ("```\nself.__x {id}\n```", "```\nself.__x {id}\n```")],
    "strip_a11y_chrome": [("Docs {id} (opens in a new tab)", "Docs {id}")],
    "collapse_spaced": [("S t a r t N o w page{id}", "Start Now page{id}"), ("I a m page{id}", "I a m page{id}")],
    "linked_images": [("[![alt {id}](/i.png)](/t)", "[alt {id}](/t)\n")],
    "collapse_logos": [("![A{id}](/a.png)\n\n![B](/b.png)\ntext", "A{id}, B\ntext"), ("![short](/a.png)\ntext {id}", "text {id}")],
    "strip_images": [("see ![pic {id}](/p.png) here", "see pic {id} here"), ("x ![a](/1) ![b {id}](/2)", "x\na, b {id}")],
    "strip_bare_image_refs": [("photo{id}.webp\nkept photo.png here", "kept photo.png here")],
    "strip_emphasis": [("**bold {id}** and *it* and __u__ _v_ 2*3*4", "bold {id} and it and u v 2*3*4")],
    "strip_alt_noise": [("Image of a cat {id} on a mat\nkept", "kept"), ("# Image of a cat {id} here", "# Image of a cat {id} here")],
    "strip_ui_controls": [("navigate_before 1 navigate_next\nkept {id}", "kept {id}"), ("Your browser does not support the video tag {id}.\nkept", "kept")],
    "strip_long_alt": [("An illustration of many things that are shown together in one large picture for page {id}.\nkept", "kept")],
    "strip_css_artifacts": [("{color:red}\na {id} @keyframes x { from { } }\nkept", "a {id} \nkept")],
    "collapse_word_lists": [("This is the text of it: " + " ".join(f"Name{i}Of{{id}}" for i in range(30)), "This is the text of it:")],
    "dedup_learn_more": [("Our new product line {id} is out\nLearn more Our new product line {id}\nkept", "Our new product line {id} is out\nkept")],
    "extract_links": [("see [Docs {id}](https://d.example/{id}) and ![i](/i.png)", "see Docs {id} and ![i](/i.png)")],
    "strip_bare_numbers": [("a {id}\n\n42\n\nb\n7\nc", "a {id}\n\n\nb\n7\nc")],
    "dedup_phrases": [
        ("Read more Read more Read more about {id}", "Read more about {id}"), ("join us " + " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(60)) + " {id}", "join us " + " ".join(f"w{i}" for i in range(60)) + " {id}"),
        ("lead {id} x " + (" ".join(f"v{i}" for i in range(40)) + " ") * 3, "lead {id} x " + " ".join(f"v{i}" for i in range(40))),
    ],
    "dedup_heading_para": [("## Big news {id}\n\nBig news {id}\nmore", "## Big news {id}\n\nmore")],
    "dedup_vs_headings": [("## Pricing {id}\nfoo\npricing {id}\nbar", "## Pricing {id}\nfoo\nbar")],
    "dedup_dup_headings": [("## A {id}\none\n## B\n## A {id}\none\ntwo", "## A {id}\none\n## B\ntwo")],
    "strip_empty_headings": [("# ---\n## Footer\n## Real {id}", "## Real {id}")],
    "strip_asset_labels": [
        ("garden | winter {id} | banner left\n14 hives | 3 lakes, 40% ice | 9+ owls\nkept", "14 hives | 3 lakes, 40% ice | 9+ owls\nkept"), ("birds > poster of {id}\nowls-of-the-north-{id}\n| x | y | z |", "| x | y | z |"), ("winter owls 1x1 left\n# Notes on owls {id}\nkept", "# Notes on owls {id}\nkept"),
    ],
    "strip_css_classes": [("flex px-4 mt-2 text-{id}\nPlain words {id} flex px-4", "Plain words {id}")],
    "collapse_ws": [("a {id}  \n\n\n\nb\t\n", "a {id}\n\nb")],
    "dedup_blocks": [("A block of more than ten words that stands here twice for {id} one\n\nmid\n\nA block of more than ten words that stands here twice for {id} two", "A block of more than ten words that stands here twice for {id} one\n\nmid")],
    "dedup_lines": [("A line of more than ten words that stands here twice for {id} one\nmid\nA line of more than ten words that stands here twice for {id} two\nend", "A line of more than ten words that stands here twice for {id} one\nmid\nend")],
    "dedup_commas": [("a, b, c{id}, a, b, c{id}", "a, b, c{id}"), ("a, a, b, c, d, e{id}", "a, b, c, d, e{id}")],
    "strip_trailing_headings": [("# A\ntext {id}\n## B\n## C", "# A\ntext {id}")],
    "strip_empty_code": [("a {id}\n```py\n\n```\nb", "a {id}\nb")],
    "merge_stats": [("99.9% up\n\nof all {id} hosts", "99.9% up of all {id} hosts")],
}
_flat = [(step, text, want) for step, rows in LINE_STEPS.items() for text, want in rows]
register("l01_l31_step_cases", [(f"{step}\x1f{text}", want) for step, text, want in _flat], by_kernel(lambda t: cleanup.apply(t.partition("\x1f")[0], t.partition("\x1f")[2])))
register(
    "l33_label_cases",
    [("**Docs {id}**", "Docs {id}"), ("Go {id} Go {id}", "Go {id}"), ("a " * 50 + "{id}", ("a " * 40).strip() + "..."), ("Open (opens in new tab)", "Open")],
    by_kernel(cleanup.link_label),
)
_HEAD = '<title>T {id}</title><meta name="description" content="About {id}"><meta name="author" content="Ann"><meta property="article:published_time" content="2024-01-02"><meta property="og:site_name" content="Site"><script type="application/ld+json">{"@type":"Article","articleBody":"long","name":"N {id}"}</script><script type="application/ld+json">{"@type":"WebSite","name":"W"}</script>'


#: A phrase that follows itself stands once.
ONCE = "Plain words of story {id} go on here."


def _llm(rows: DataFrame) -> DataFrame:
    read = pages.read_pages(rows.withColumn("url", F.concat(F.lit("https://site.example/"), "page_id")), "llm", info=())
    return read.withColumnRenamed("content", "got")


register(
    "l32_l35_model_text_cases",
    [
        (_page(f"<article><p>{STORY}<a href='/d{{id}}'>Docs {{id}}</a></p></article>", _HEAD), "> URL: https://site.example/{id}\n> Title: T {id}\n> Description: About {id}\n> Author: Ann\n> Published: 2024-01-02\n> Site: Site\n> Language: en\n\n" + f"{ONCE} Docs {{id}}\n\n## Links\n\n- [Docs {{id}}](https://site.example/d{{id}})\n\n## Structured Data\n\n```json\n[{{\"@type\": \"Article\", \"name\": \"N {{id}}\"}}]\n```"),
        (_page(f"<article><p>{STORY}</p></article>"), f"> URL: https://site.example/{{id}}\n> Title: Page {{id}}\n> Language: en\n\n{ONCE}"),
    ],
    _llm,
)


def _report(make) -> Callable[[str], str]:
    import json

    return lambda html: json.dumps(make(dom.parse(html), html), sort_keys=True, ensure_ascii=False)


register(
    "i01_seo_cases",
    [
        (
            '<meta property="og:title" content="O {id}"><meta name="twitter:card" content="summary"><link rel="canonical" href="/c{id}"><link rel="alternate" hreflang="de" href="/de"><link rel="shortcut icon" href="/f.ico"><script type="application/ld+json">{"@graph":[{"@type":"NewsArticle"}]}</script>',
            '{"canonical": "/c{id}", "description": "", "favicon": "/f.ico", "hreflang": [["de", "/de"]], "json_ld": [{"raw": "{\\"@graph\\":[{\\"@type\\":\\"NewsArticle\\"}]}", "type": "NewsArticle"}], "keywords": "", "og": {"description": "", "image": "", "site_name": "", "title": "O {id}", "type": "", "url": ""}, "robots": "", "twitter": {"card": "summary", "description": "", "image": "", "site": "", "title": ""}}',
        ),
        (
            '<meta name="robots" content="noindex"><meta name="description" content="D {id}"><meta name="keywords" content="k"><link rel="icon" href="/i.png"><link rel="shortcut icon" href="/f.ico">',
            '{"canonical": null, "description": "D {id}", "favicon": "/i.png", "hreflang": [], "json_ld": [], "keywords": "k", "og": {"description": "", "image": "", "site_name": "", "title": "", "type": "", "url": ""}, "robots": "noindex", "twitter": {"card": "", "description": "", "image": "", "site": "", "title": ""}}',
        ),
    ],
    by_kernel(_report(lambda d, html: dom.seo(d))),
)
register(
    "i08_media_cases",
    [
        (
            '<img src="/a{id}.JPG?x=1"><img src="https://res.cloudinary.com/b.webp" srcset="c 2x"><img><picture><source src="https://x.imgix.net/p.png"></picture><video src="https://youtu.be/{id}"></video><video><source src="/v.mp4"></video><audio src="https://w.soundcloud.com/{id}"></audio>',
            '{"audio": ["SoundCloud"], "formats": {"jpg": 1, "webp": 1}, "images": 3, "networks": ["Cloudinary", "imgix"], "pictures": 1, "srcset": 1, "videos": ["YouTube", "Other"]}',
        ),
        ("<p>none {id}</p>", '{"audio": [], "formats": {}, "images": 0, "networks": [], "pictures": 0, "srcset": 0, "videos": []}'),
    ],
    by_kernel(_report(lambda d, html: dom.media_report(d))),
)
register(
    "i09_i10_i13_cases",
    [
        ('<link href="https://fonts.googleapis.com/css?family=Open+Sans:400|Lato" rel="stylesheet"><style>@font-face { font-family: "F{id}"; }</style><link rel="manifest" href="/m"><script>navigator.serviceWorker.register("/s")</script>', '[{"adobe": false, "faces": ["F{id}"], "google": ["Open Sans", "Lato"]}, {"installable": true, "manifest": true, "service_worker": true}, {"declared": [], "registered": false}]'),
        ('<form toolname="buy{id}" tooldescription="Buy it"><input name="sku"></form><script>navigator.modelContext.x()</script>', '[{"adobe": false, "faces": [], "google": []}, {"installable": false, "manifest": false, "service_worker": false}, {"declared": [{"description": "Buy it", "fields": ["sku"], "name": "buy{id}"}], "registered": true}]'),
    ],
    by_kernel(_report(lambda d, html: [dom.fonts(d), dom.progressive(d), dom.tools(d)])),
)
register(
    "i11_i12_interface_cases",
    [
        (
            """<script>fetch('/api/{id}'); axios.post("/api/p", x); fetch("/api/{id}"); new WebSocket('wss://s.example/{id}'); q = "/graphql"</script><form action="/go"></form><form action="#"></form>""",
            '{"endpoints": [["GET", "/api/{id}"], ["POST", "/api/p"]], "forms": ["/go"], "graphql": true, "next": false, "nuxt": false, "public": {"hints": [], "links": [], "openapi": null, "well_known": []}, "sockets": ["wss://s.example/{id}"]}',
        ),
        (
            '<script id="__NEXT_DATA__" type="application/json">{}</script><a href="/docs/swagger{id}.json">d</a><link rel="service-desc" href="/sd{id}"><p>/.well-known/mcp.json</p>',
            '{"endpoints": [], "forms": [], "graphql": false, "next": true, "nuxt": false, "public": {"hints": [], "links": ["/docs/swagger{id}.json", "/sd{id}"], "openapi": "/docs/swagger{id}.json", "well_known": ["/.well-known/mcp.json"]}, "sockets": []}',
        ),
        ('<script>window.__NUXT__={}</script><div id="graphiql"></div><script src="/swagger-ui.js"></script>', '{"endpoints": [], "forms": [], "graphql": false, "next": false, "nuxt": true, "public": {"hints": ["graphql_playground", "openapi_config_detected"], "links": [], "openapi": null, "well_known": []}, "sockets": []}'),
    ],
    by_kernel(_report(dom.interfaces)),
)
register(
    "e39_form_cases",
    [
        ('<form action="/f{id}" method="post"><input name="q" value="a b"><input name="off" disabled value="z"><select name="s"><option value="x">X</option><option value="y" selected>Y</option></select><textarea name="t">hi</textarea></form>', "POST /f{id} q=a+b&s=y&t=hi"),
        ('<form><input name="n{id}"></form>', "GET  n{id}="),
    ],
    by_kernel(lambda html: " | ".join(f"{f['method']} {f['action']} {dom.form_data(f)}" for f in dom.forms(dom.parse(html)))),
)
register(
    "m01_m02_media_cases",
    [
        ('<img src="/p{id}.jpg" alt="A" width="640" height="480"><img src="/logo.png"><img src="/t.jpg" width="10" height="10"><img srcset="/s.jpg 1x, /l{id}.jpg 2x">', "image https://site.example/p{id}.jpg, image https://site.example/l{id}.jpg"),
        ('<meta property="og:image" content="/o{id}.png"><picture><source srcset="/w.webp 1x"></picture><div style="background:url(/bg{id}.jpg)"></div>', "image https://site.example/o{id}.png, image https://site.example/w.webp, image https://site.example/bg{id}.jpg"),
        ('<video src="/v{id}.mp4"></video><script type="application/ld+json">{"@graph":[{"@type":"VideoObject","contentUrl":"/c{id}.mp4"}]}</script><meta property="og:video" content="/og{id}.mp4">', "video https://site.example/v{id}.mp4, video https://site.example/og{id}.mp4, video https://site.example/c{id}.mp4"),
    ],
    by_kernel(lambda html: ", ".join(f"{m['kind']} {m['url']}" for m in dom.media(dom.parse(html), "https://site.example/a"))),
)


def _found(rules) -> Callable[[DataFrame], DataFrame]:
    """Checks and severities that hold of a page at https://site.example/."""

    def run(rows: DataFrame) -> DataFrame:
        frame = pages.with_markup_risks(rows).withColumns({"url": F.lit("https://site.example/p?sid=1"), "r": security.resources()})
        found = security.report(rules())
        return frame.select("page_id", "case_no", F.array_join(F.transform(found, lambda f: F.concat(f["check"], F.lit(" "), f["severity"])), ", ").alias("got"))

    return run


register(
    "s08_s09_s16_resource_cases",
    [
        ('<script src="https://cdn.polyfill.io/{id}.js"></script>', "none critical, risky_cdn high, third_party info"),
        ('<script src="https://mycdn.polyfill.io.example/{id}.js" integrity="sha384-x"></script>', "third_party info"),
        ('<script src="https://c.example/jquery-1.12.4.min.js" integrity="sha384-x"></script><script src="/js/angularjs-1.2.{id}.js"></script>', "third_party info, jQuery medium, AngularJS high"),
        ('<script src="/js/bootstrap.min.js?v=3.3.7"></script><script src="/js/lodash@4.17.21.js"></script>', "Bootstrap medium"),
        ('<link rel="stylesheet" href="https://c.example/{id}.css"><script src="https://c.example/a.js" integrity="sha384-x"></script>', "some medium, third_party info"),
        ("<p>none {id}</p>", ""),
    ],
    _found(lambda: [*security.sri(F.col("r"))[0], *security.supply_chain(F.col("r")), *security.library_rules(F.col("r"))]),
)
register(
    "s10_mixed_cases",
    [('<img src="http://i.example/{id}.png">', "img medium"), ('<script src="http://i.example/{id}.js"></script><iframe src="http://f.example/"></iframe>', "script high, iframe high"), ('<link rel="stylesheet" href="http://c.example/{id}.css"><form action="http://f.example/">', "form high, stylesheet high"), ('<img src="https://i.example/{id}.png">', "")],
    _found(security.mixed_rules),
)
register(
    "s12_s15_body_cases",
    [
        ("<p>host 10.0.0.{id}1 </p><p>at 192.168.1.7</p>", "private_ip medium"), ("Traceback (most recent call last) {id}", "stack_trace high"), ("<!-- TODO {id} -->", "suspicious_comment medium"), ('<meta name="generator" content="Maker 4.{id}">', "generator_version medium"),
        ("<title>Index of /{id}</title>", "directory_listing medium"), ('<form action="http://f.example/{id}">', "insecure_form_action high"), ("<a onclick=\"go({id})\" href='javascript:x()'>x</a>", "xss_event_handlers medium, xss_javascript_url high"),
        ("//# sourceMappingURL=app{id}.js.map", "exposed_source_map medium"), ('<form method="post"><input name="a{id}"></form>', "form_no_csrf_token medium"), ('<form method="post"><input type="hidden" name="csrf_token" value="{id}"></form>', ""), ("<p>fine {id}</p>", ""),
    ],
    _found(security.body_rules),
)
register(
    "s17_call_cases",
    [("<script>eval(a{id}); document.write(b)</script>", "eval high, document.write medium"), ("<script>setTimeout('x{id}()', 1); e.innerHTML = y</script>", "setTimeout-string medium, innerHTML medium"), ('<script src="/eval{id}.js"></script><p>eval(1)</p>', "")],
    _found(lambda: security.dangerous_rules(F.col("script_calls"))),
)


def _technologies(rows: DataFrame) -> DataFrame:
    headers = F.when(F.col("case_no") % 2 == 0, F.create_map(F.lit("server"), F.lit("nginx/1.2"))).otherwise(F.create_map(F.lit("x-powered-by"), F.lit("PHP/8.1"), F.lit("server"), F.lit("Cloudflare")))
    found = technology.technologies(F.col("html"), headers)
    return rows.select("page_id", "case_no", F.array_join(F.transform(found, lambda t: F.concat(t["name"], F.lit(" ["), t["category"], F.lit("] "), t["confidence"].cast("string"))), ", ").alias("got"))


register(
    "i15_technology_cases",
    [
        ('<link href="/wp-content/{id}.css"><meta name="generator" content="WordPress 6"><script src="/wp-includes/js/a.js"></script>', "WordPress [CMS] 100, nginx [Web Server] 50"),
        ('<div data-reactroot>{id}</div><script src="/react-dom.js"></script>', "React [JS Framework] 50, Cloudflare [CDN] 50, PHP [Programming Language] 50"),
        ('<script src="/zone.js?{id}"></script>', "nginx [Web Server] 50, Angular [JS Framework] 25"),
        ('<script src="https://www.googletagmanager.com/gtm.js?id={id}"></script>', "Google Tag Manager [Analytics] 75, Cloudflare [CDN] 50, PHP [Programming Language] 50, Google Analytics [Analytics] 25"),
    ],
    _technologies,
)

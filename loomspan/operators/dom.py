"""A small document tree on the standard parser, and what is read from it.

Void elements, implied end tags (p, li, td, tr, dt, dd, option) and raw text
of scripts and styles follow the HTML standard; formatting elements that are
left open are closed with their parent and not opened again.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urlencode, urljoin, urlsplit

from . import script

#: Elements within one another that are kept so; what lies deeper becomes a sibling, as readers go down recursively.
DEEPEST = 150
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
}
STOPS = frozenset("table ul ol dl section article div body html td th select".split())
#: Elements, roles, class tokens and ids of boilerplate, and prefixes of consent overlays.
NOISE_TAGS = frozenset("script style noscript iframe svg nav aside footer header video audio canvas".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo".split())
NOISE_CLASSES = frozenset(
    "header top navbar footer bottom sidebar modal popup overlay ad ads advert lang-selector language social social-media social-links menu navigation breadcrumbs breadcrumb share widget cookie newsletter subscribe "
    "skip-link sr-only visually-hidden notification alert toast pagination pager signup login-form search-form related-posts recommended".split()
)
NOISE_IDS = frozenset("header footer nav sidebar menu modal popup cookie breadcrumbs widget ad social share newsletter subscribe comments related".split())
CONSENT = ("onetrust", "optanon", "ot-sdk", "cookiebot", "CybotCookiebot", "cc-", "cookie-law", "gdpr", "consent-", "cmp-", "sp_message", "qc-cmp", "trustarc", "evidon")
FORM_CLASSES = frozenset("login-form search-form subscribe signup newsletter contact".split())
STRUCTURE = ("portal", "root", "container", "wrapper", "mount", "app")
LONG_TEXT, FORM_TEXT = 5000, 500
GOOD_NAMES = re.compile(r"article|content|post|entry|main|body|story", re.I)
CANDIDATES = frozenset("article main div section td".split())
GATE_SOURCE, GATE_SHARE = 500, 0.10


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "_text", "_tags")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self._text, self._tags = tag, attrs, parent, [], None, None

    def index(self) -> Node:
        """Files the elements below by tag, for ``find``; the tree must not change after that."""
        self._tags = {}
        for i, n in enumerate(self.walk()):
            self._tags.setdefault(n.tag, []).append((i, n))
        return self

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = "".join(c if isinstance(c, str) else c.text for c in self.children)
        return self._text

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        todo = [c for c in reversed(self.children) if not isinstance(c, str)]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if not isinstance(c, str))

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def find(self, *tags: str) -> list[Node]:
        if self._tags is None:
            return [n for n in self.walk() if n.tag in tags]
        lists = [self._tags.get(t, ()) for t in tags]
        return [n for _, n in (lists[0] if len(lists) == 1 else sorted(x for y in lists for x in y))]

    def visible(self) -> str:
        """Text without that of scripts and styles."""
        return "".join(c if isinstance(c, str) else "" if c.tag in ("script", "style", "noscript") else c.visible() for c in self.children)

    def html(self) -> str:
        inner = "".join((c if self.tag in ("script", "style") else escape(c, quote=False)) if isinstance(c, str) else c.html() for c in self.children)
        if not self.tag:
            return inner
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{inner}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in CLOSES.get(tag, ()):
                del self.open[i:]
                break
            if self.open[i].tag in STOPS and self.open[i].tag not in CLOSES.get(tag, ()):
                break
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known kind
            return self.parse_bogus_comment(i)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root.index()


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def squeeze(text: str) -> str:
    return " ".join(text.split())


def is_noise(n: Node) -> bool:
    """Whether an element is boilerplate: by tag, role, class, id, consent overlay, or hidden by style."""
    if n.tag in ("", "body", "html"):
        return False
    if n.tag in NOISE_TAGS:
        return True
    if not n.attrs and n.tag != "form":
        return False
    tokens = n.get("class").lower().split()
    if n.tag == "form":
        return size(n.text) < FORM_TEXT or any(t in FORM_CLASSES for t in tokens)
    if n.get("role").lower() in NOISE_ROLES:
        return True
    short = size(n.text) <= LONG_TEXT
    advert = any(t == "ad" or t.startswith(("ad-", "ad_")) or t.endswith(("-ad", "_ad")) for t in tokens)
    if advert or any(t in NOISE_CLASSES or t.startswith(("footer", "header-", "nav-")) for t in tokens):
        return short
    name = n.get("id").lower()
    if name in NOISE_IDS and not any(s in name for s in STRUCTURE):
        return short
    if name.startswith(CONSENT) or any(p in n.get("class").lower() for p in CONSENT):
        return short
    style = n.get("style").lower().replace(" ", "")
    return "display:none" in style or "visibility:hidden" in style or n.get("aria-hidden") == "true"


def noisy(n: Node, noise: dict[int, bool]) -> bool:
    """Whether an element or one above it is boilerplate."""
    for x in (n, *n.up()):
        if id(x) not in noise:
            noise[id(x)] = is_noise(x)
        if noise[id(x)]:
            return True
    return False


def node_score(n: Node) -> float:
    """The logarithm of the text's bytes, points for meaning and paragraphs, less for links."""
    length = size(n.text)
    if length < 50:
        return 0.0
    semantic = n.tag in ("article", "main") or n.get("role") == "main"
    score = math.log(length) + 50 * semantic + 25 * bool(GOOD_NAMES.search(n.get("class"))) + 25 * bool(GOOD_NAMES.search(n.get("id"))) + 3 * len(n.find("p"))
    share = sum(size(a.text) for a in n.find("a")) / length
    if semantic:
        return score * (0.3 if share > 0.7 else 0.5 if share > 0.5 else 1)
    return score * (0.1 if share > 0.5 else 0.5 if share > 0.3 else 1)


def best_node(doc: Node, noise: dict[int, bool]) -> Node | None:
    """The first of the highest-scored candidates."""
    best, top = None, 0.0
    for n in doc.walk():
        if (n.tag in CANDIDATES or n.get("role") == "main") and not noisy(n, noise) and (s := node_score(n)) > top:
            best, top = n, s
    return best


def beside(best: Node, noise: dict[int, bool]) -> list[Node]:
    """Sections of 50 words and divisions of 100 next to the chosen node or up to two above it; streamed parts always."""
    out, at = [], best
    for _ in range(3):
        parent = at.parent
        if parent is None or parent.tag in ("html", ""):
            break
        for c in parent.children:
            if isinstance(c, str) or c is at or c.tag not in ("section", "div") or noisy(c, noise) or c in best.up():
                continue
            streamed = c.tag == "div" and "hidden" in c.attrs and c.get("id").startswith("S:")
            if streamed or len(c.text.split()) >= (50 if c.tag == "section" else 100):
                out.append(c)
        at = parent
    return out


def without_noise(n: Node) -> Node:
    """A copy without boilerplate elements."""
    out = Node(n.tag, n.attrs, None)
    for c in n.children:
        if isinstance(c, str):
            out.children.append(c)
        elif not is_noise(c):
            child = without_noise(c)
            child.parent = out
            out.children.append(child)
    return out


def first_h1(doc: Node, noise: dict[int, bool]) -> str:
    for h in doc.find("h1"):
        if not noisy(h, noise) and not any(a.tag == "dialog" or a.get("role") == "dialog" for a in h.up()):
            text = squeeze(h.text)
            return re.sub(r"[^\w)\]!?.]+$", "", text)
    return ""


BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure figcaption footer form header html li main nav ol p pre section table ul h1 h2 h3 h4 h5 h6 hr tr td th".split())


def markdown(n: Node, base: str = "") -> str:
    """ATX headings, ``*`` lists, fenced code, links, images, tables as rows; blank lines between blocks."""
    out: list[str] = []

    def inline(x: Node) -> str:
        parts = []
        for c in x.children:
            if isinstance(c, str):
                parts.append(re.sub(r"\s+", " ", c))
            elif c.tag in ("script", "style", "noscript", "template"):
                continue
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag == "img":
                parts.append(f"![{squeeze(c.get('alt'))}]({join_url(base, c.get('src'))})" if c.get("src") else "")
            elif c.tag == "a" and c.get("href"):
                label = inline(c).strip()
                parts.append(f"[{label}]({join_url(base, c.get('href'))})" if label else "")
            elif c.tag in ("b", "strong", "i", "em", "code"):
                t, mark = inline(c), {"b": "**", "strong": "**", "code": "`"}.get(c.tag, "*")
                core = t.strip()
                parts.append(f"{t[: len(t) - len(t.lstrip())]}{mark}{core}{mark}{t[len(t.rstrip()) :]}" if core and "\n" not in core else t)
            else:
                parts.append(inline(c))
        return "".join(parts)

    def block(x: Node, prefix: str) -> None:
        buffer: list = []

        def flush() -> None:
            if buffer:
                holder = Node("", {}, None)
                holder.children = list(buffer)
                text = "\n".join(" ".join(y.split()) for y in inline(holder).split("\n")).strip()
                buffer.clear()
                if text:
                    out.append("\n".join(prefix + y for y in text.split("\n")))

        for c in x.children:
            if isinstance(c, str) or (c.tag not in BLOCKS and not any(d.tag in BLOCKS for d in c.walk())):
                buffer.append(c)
                continue
            flush()
            if c.tag in ("script", "style", "noscript"):
                continue
            if re.fullmatch("h[1-6]", c.tag):
                text = squeeze(inline(c))
                if text:
                    out.append(f"{prefix}{'#' * int(c.tag[1])} {text}")
            elif c.tag in ("ul", "ol"):
                rows = []
                for i, item in enumerate(d for d in c.children if not isinstance(d, str) and d.tag == "li"):
                    body = markdown(item, base).strip()
                    rows.append(f"{prefix}{f'{i + 1}.' if c.tag == 'ol' else '*'} " + body.replace("\n\n", "\n").replace("\n", f"\n{prefix}  "))
                if rows:
                    out.append("\n".join(rows))
            elif c.tag == "pre":
                out.append(f"```\n{c.text.strip(chr(10))}\n```")
            elif c.tag == "blockquote":
                block(c, prefix + "> ")
            elif c.tag == "hr":
                out.append("---")
            elif c.tag == "table":
                rows = [[squeeze(inline(d)) for d in r.children if not isinstance(d, str) and d.tag in ("td", "th")] for r in c.find("tr")]
                rows = [r for r in rows if any(r)]
                if rows:
                    lines = [f"| {' | '.join(r)} |" for r in rows]
                    out.append("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]))
            else:
                block(c, prefix)
        flush()

    block(n, "")
    return "\n\n".join(out)


def to_markdown(html: str, base: str = "") -> str:
    """The whole of a piece of markup as Markdown, boilerplate included."""
    return markdown(parse(html), base)


def join_url(base: str, href: str) -> str:
    """``href`` against ``base``; as it is where they don't join."""
    try:
        return urljoin(base, href) if base else href
    except ValueError:
        return href


def host_of(url: str) -> str:
    """The host in lower case; empty where there is none or the URL is malformed."""
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def taglines(heading: Node) -> list[str]:
    """Short paragraphs that stand before a heading, in the same element."""
    before = heading.parent.children[: heading.parent.children.index(heading)]
    texts = [squeeze(c.text) for c in before if not isinstance(c, str) and c.tag == "p"]
    return [t for t in texts if t and size(t) <= 80 and not t.startswith("/")]


def labels_beside(heading: Node) -> list[str]:
    """Labels of the links in the nearest of two elements around a heading that holds two or more; empty words and very long ones are left out."""
    around = next((n for n in list(heading.up())[:2] if len(n.find("a")) >= 2), None)
    texts = [squeeze(a.text) for a in (around.find("a") if around else []) if a.get("href")]
    return [t for t in texts if 1 < size(t) < 60 and t.lower() not in ("here", "link", "click", "more")]


def recover(doc: Node, md: str, h1: str, noise: dict[int, bool]) -> str:
    """Puts back what the choice of a node loses: the title, a lead, announcements, the footer's links and map."""
    heads = [h for h in doc.find("h1") if squeeze(h.text).startswith(h1)] if h1 else []
    if h1 and h1.lower() not in md.lower():
        md = f"# {h1}\n\n{md}"
    if heads:
        texts: dict[int, str] = {}  # of paragraphs, as each is below several of these

        def said(p: Node) -> str:
            if id(p) not in texts:
                texts[id(p)] = squeeze(p.text)
            return texts[id(p)]

        for a in list(heads[0].up())[:4]:
            lead = next((t for p in a.find("p") if 40 <= size(t := said(p)) <= 300 and t not in md and not noisy(p, noise)), None)
            if lead:
                first, _, rest = md.partition("\n")
                md = f"{first}\n\n{lead}\n{rest}"
                break
    for n in doc.walk():
        if n.attrs and n.get("role") == "region" and "announcement" in n.get("aria-label").lower():
            text = squeeze(n.text)
            if text and text not in md:
                md = f"> **{text}**\n\n{md}"
    for h in doc.find("h2"):
        text = squeeze(h.text)
        if text and text.lower() not in md.lower() and not noisy(h, noise) and h.parent is not None:
            after = h.parent.children[h.parent.children.index(h) + 1 :]
            anchor = next((t for s in after if not isinstance(s, str) and size(t := squeeze(s.text)[:60]) >= 20 and t in md), None)
            if anchor:
                at = md.rfind("\n\n", 0, md.index(anchor))
                at = 0 if at < 0 else at + 2
                md = f"{md[:at]}## {text}\n\n{md[at:]}"
    for h in doc.find("h2"):
        text = squeeze(h.text)
        if text and text in md and h.parent is not None:
            for lead in taglines(h):
                if lead not in md.replace("*", ""):
                    at = md.rfind("\n", 0, md.index(text)) + 1
                    md = f"{md[:at]}*{lead}*\n\n{md[at:]}"
    for f in doc.find("footer"):
        for h in f.find("h2"):
            links = [a for a in f.find("a") if any(k in a.get("href") for k in ("docs.", "/docs", "app.", "/app", "api."))]
            text = squeeze(h.text)
            if links and text and text not in md:
                md += f"\n\n## {text}\n\n" + "\n".join(f"* [{squeeze(a.text)}]({a.get('href')})" for a in links)
        groups = []
        for h in f.find("h2", "h3", "h4", "h5"):
            labels = labels_beside(h)
            if 2 <= len(labels) <= 20:
                groups.append(f"**{squeeze(h.text)}**: {', '.join(labels)}")
        if len(groups) >= 3:
            md += "\n\n" + "\n".join(groups)
    return md


def content_words(text: str) -> bool:
    t = text.strip()
    return size(t) >= 15 and not re.match(r"https?://|/|\{|\[", t) and " " in t and sum(c.isalnum() for c in t) / size(t) >= 0.6


def island_chunks(value, depth: int = 15, most: int = 1000) -> list[str]:
    """Readable parts of a JSON value: entries with heading and body, rich text, quotes, and other long strings."""
    out: list[str] = []

    def walk(v, left: int) -> None:
        if left == 0 or len(out) >= most:
            return
        if isinstance(v, list):
            for x in v:
                walk(x, left - 1)
        elif isinstance(v, dict):
            if v.get("nodeType") and isinstance(v.get("content"), list):
                text = squeeze(_rich(v))
                kind = str(v["nodeType"])
                if kind == "document":
                    for x in v["content"]:
                        walk(x, left - 1)
                elif text:
                    out.append(f"{'#' * int(kind[-1])} {text}" if re.fullmatch(r"heading-[1-6]", kind) else f"> {text}" if kind == "blockquote" else text)
                return
            pick = lambda *names: next((v[k].strip() for k in names if isinstance(v.get(k), str) and v[k].strip()), "")
            head, body = pick("heading", "title", "headline", "name"), pick("body", "description", "text", "content", "subtitle", "subheading", "eyebrow", "children")
            quote, who = pick("quote", "testimonial"), pick("author", "attribution", "name")
            if quote and content_words(quote):
                out.append(f"> {quote}\n> — {who}" if who else f"> {quote}")
            elif body and content_words(body):
                out.append(f"## {head}\n\n{body}" if head and not re.fullmatch(r"[A-Za-z0-9_.-]*", head.replace(" ", "_", 0)) else body)
            elif head and not body and content_words(head):
                out.append(f"## {head}")
            for x in v.values():
                if isinstance(x, dict | list):
                    walk(x, left - 1)

    walk(value, depth)
    return list(dict.fromkeys(out))


def _rich(v) -> str:
    if isinstance(v, dict):
        return v["value"] if isinstance(v.get("value"), str) else "".join(_rich(x) for x in v.get("content", []))
    return ""


def data_island(doc: Node, existing: str, most_words: int = 500) -> str:
    """Text of JSON scripts that the page doesn't show, where it shows few words."""
    if len(existing.split()) >= most_words:
        return ""
    chunks: list[str] = []
    for s in doc.find("script"):
        if s.get("type").lower() == "application/json" and size(s.text) >= 50:
            try:
                chunks += island_chunks(json.loads(s.text))
            except (ValueError, RecursionError):
                continue
    return "\n\n".join(c for c in dict.fromkeys(chunks) if squeeze(c) not in squeeze(existing))


def state_scripts(doc: Node) -> list[str]:
    """Inline scripts that can set state: no modules, no data."""
    return [x.text for x in doc.find("script") if "src" not in x.attrs and x.get("type").lower() != "module" and "json" not in x.get("type").lower()]


def script_state(doc: Node) -> list[tuple[str, str]]:
    """Name and JSON of what inline scripts leave under global names with two underscores first, evaluated without running them."""
    return script.state(state_scripts(doc))


#: Beginnings, parts and ends of texts that are no prose.
NO_PROSE_STARTS = ("http://", "https://", "//", "/", "./", "../")
NO_PROSE_PARTS = ("1fr", "grid-", "max-content", "divider-v-", "divider-h-", '"')
NO_PROSE_ENDS = (".js", ".css", ".png", ".jpg", ".svg", ".woff2")
MEASURES = ("px", "em", "rem", "%")
LEAST_PROSE, LONG_WORD = 16, 50
_TAG = re.compile(r"<[^>]*>")
_LAYOUT_WORD = re.compile(r"\.|[a-z0-9-]{0,20}")


def readable(text: str) -> str | None:
    """A text of scripts as prose, without tags; None for addresses, paths, rules and names of styles, measures, code and data."""
    t = text.strip()
    words = t.split()
    if size(t) < LEAST_PROSE or " " not in t or t.startswith(NO_PROSE_STARTS) or t.endswith(NO_PROSE_ENDS) or any(p in t for p in NO_PROSE_PARTS):
        return None
    if "{" in t and "}" in t and (":" in t or ";" in t):
        return None
    if sum("-" in w and any("0" <= c <= "9" for c in w) for w in words) >= 2:
        return None
    if not any(c.isupper() for c in t) and all(_LAYOUT_WORD.fullmatch(w) for w in words):
        return None
    if all(w == "0" or w.endswith(MEASURES) for w in words):
        return None
    clean = _TAG.sub("", t).strip()
    if size(clean) < LEAST_PROSE or sum(c.isalpha() or c.isspace() for c in t) < 0.6 * size(t):
        return None
    return clean


def readable_strings(value, depth: int = 20) -> list[str]:
    """Readable strings of a JSON value, each once."""
    if isinstance(value, str):
        found = readable(value)
        return [found] if found else []
    if depth == 0 or not isinstance(value, list | dict):
        return []
    return list(dict.fromkeys(t for x in (value.values() if isinstance(value, dict) else value) for t in readable_strings(x, depth - 1)))


def state_text(found: list[tuple[str, str]]) -> list[str]:
    """Readable strings of the state that scripts leave, but for streamed components."""
    return list(dict.fromkeys(t for name, state in found if name != "__next_f" for t in readable_strings(json.loads(state))))


def flight_text(doc: Node, found: list[tuple[str, str]]) -> list[str]:
    """Readable strings of streamed component payloads: parts are joined, each line parsed after its first bar."""
    parts = [x[1] for name, state in found if name == "__next_f" for x in json.loads(state) if isinstance(x, list) and len(x) > 1 and x[0] == 1]
    for s in doc.find("script") if not parts else []:
        for m in re.finditer(r"self\.__next_f\.push\((\[1,.*?\])\)", s.text, re.S):
            try:
                parts.append(json.loads(m[1])[1])
            except (ValueError, IndexError, RecursionError):
                continue
    out: list[str] = []
    for line in "".join(p for p in parts if isinstance(p, str)).split("\n"):
        payload = re.split(r"[|:]", line, maxsplit=1)
        try:
            out += readable_strings(json.loads(payload[1])) if len(payload) > 1 else []
        except (ValueError, RecursionError):
            continue
    return list(dict.fromkeys(out))


def extract(html: str, url: str = "", fmt: str = "text") -> dict:
    """The page's main content in a format (text, markdown, html, llm), its title line, and the gate's note."""
    if not html.strip():
        return {"title": "", "content": "", "h1": "", "note": None}
    doc = parse(html)
    noise: dict[int, bool] = {}
    h1 = first_h1(doc, noise)
    best = best_node(doc, noise)
    body = next(iter(doc.find("body")), doc)
    chosen = Node("", {}, None)
    chosen.children = [best, *beside(best, noise)] if best is not None else [body]
    note, dense = None, lambda n: sum(map(len, n.visible().split()))
    if (source := dense(doc)) >= GATE_SOURCE and dense(chosen) < GATE_SHARE * source:
        note, h1 = "extraction_rejected_low_text_ratio", ""
        chosen.children = [body]
    title = squeeze(next((t.text for t in doc.find("title")), ""))
    if fmt == "html":
        content = chosen.html()
    elif fmt in ("markdown", "llm"):
        content = recover(doc, markdown(without_noise(chosen), url), h1, noise)
    else:
        content = squeeze(chosen.visible()) or squeeze(body.visible())
    if fmt != "html":
        extra = data_island(doc, content)
        found = script_state(doc)
        flight = [t for t in dict.fromkeys([*state_text(found), *flight_text(doc, found)]) if t not in content]
        if flight:
            extra = "\n\n".join(x for x in (extra, "## Additional Content\n\n" + "\n\n".join(flight)) if x)
        content = "\n\n".join(x for x in (content, extra) if x)
    return {"title": title, "content": content, "h1": h1, "note": note}


def forms(doc: Node) -> list[dict]:
    """Forms with their fields: inputs, selects, text areas."""
    out = []
    for f in doc.find("form"):
        fields = []
        for kind in ("input", "select", "textarea"):
            for x in f.find(kind):
                value = x.get("value")
                if kind == "select":
                    options = x.find("option")
                    chosen = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
                    value = (chosen.get("value") or squeeze(chosen.text)) if chosen else ""
                elif kind == "textarea":
                    value = x.text
                fields.append({"name": x.get("name"), "value": value, "type": x.get("type") or ("text" if kind == "input" else kind), "disabled": "disabled" in x.attrs})
        out.append({"action": f.get("action"), "method": (f.get("method") or "GET").upper(), "fields": fields})
    return out


def form_data(form: dict) -> str:
    return urlencode([(x["name"], x["value"]) for x in form["fields"] if x["name"] and not x["disabled"]])


#: Ends and parts of addresses of images that are no content.
SKIP_ENDS = (".svg", ".ico", ".gif", ".bmp", ".cur")
SKIP_PARTS = ("logo", "icon", "sprite", "avatar", "badge", "button", "pixel", "tracking", "spacer", "blank", "placeholder", "loading", "spinner", "favicon", "emoji", "1x1", "beacon", "analytics", "advert", "captcha")


def _number(text: str) -> int:
    m = re.match(r"\s*(\d+)", text)
    return int(m[1]) if m else 0


def media(doc: Node, base: str) -> list[dict]:
    """Images and videos of a page, each URL once, in the order they are looked for."""
    found: list[dict] = []

    def add(url: str, kind: str, source: str, title: str = "", width: int = 0, height: int = 0) -> None:
        full = join_url(base, url.strip())
        low = full.lower().split("?")[0]
        if not url.strip() or url.startswith("data:") or any(f["url"] == full for f in found):
            return
        if kind == "image" and (low.endswith(SKIP_ENDS) or any(p in low.rsplit("/", 1)[-1] for p in SKIP_PARTS)):
            return
        found.append({"url": full, "kind": kind, "source": source, "title": squeeze(title), "width": width, "height": height})

    metas = {(m.get("property") or m.get("name")): m.get("content") for m in reversed(doc.find("meta"))}
    add(metas.get("og:image", ""), "image", "og")
    for i in doc.find("img"):
        w, h = _number(i.get("width")), _number(i.get("height"))
        if w and h and w < 200 and h < 200:
            continue
        sets = [(_number(d or "0"), u) for u, d in re.findall(r"(\S+)(?:\s+(\d+)[wx])?\s*(?:,|$)", i.get("srcset"))]
        add(max(sets, key=lambda x: x[0])[1] if sets else i.get("src") or i.get("data-src"), "image", "img", i.get("alt"), w, h)
    for p in doc.find("picture"):
        for s in p.find("source"):
            add(s.get("srcset").split(",")[0].split(" ")[0], "image", "picture")
    for n in doc.walk():
        for u in re.findall(r"""url\(\s*["']?([^"')]+)""", n.text if n.tag == "style" else n.get("style")):
            add(u, "image", "css")
    for v in doc.find("video"):
        for x in (v, *v.find("source")):
            add(x.get("src"), "video", "video", v.get("title"), _number(v.get("width")), _number(v.get("height")))
    for key in ("og:video", "og:video:url", "og:video:secure_url", "twitter:player"):
        add(metas.get(key, ""), "video", key)
    for s in doc.find("script"):
        if s.get("type").lower() == "application/ld+json":
            try:
                todo = [json.loads(s.text)]
            except (ValueError, RecursionError):
                continue
            while todo:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo[:0] = x
                elif isinstance(x, dict):
                    if x.get("@type") == "VideoObject":
                        add(str(x.get("contentUrl") or x.get("embedUrl") or ""), "video", "json-ld", str(x.get("name") or ""))
                    todo[:0] = [y for y in x.values() if isinstance(y, dict | list)]
        elif not s.get("src"):
            for u in re.findall(r"""["'](https?://[^"'\s]+\.(?:mp4|m3u8|webm)[^"'\s]*)["']""", s.text):
                add(u, "video", "script")
    return found


def accessibility(doc: Node) -> dict:
    """Counts for accessibility, and their score."""
    html = next(iter(doc.find("html")), doc)
    images = doc.find("img")
    levels = sorted(int(h.tag[1]) for h in doc.walk() if re.fullmatch("h[1-6]", h.tag))[:50]
    distinct = sorted(set(levels))
    labels = {x.get("for") for x in doc.find("label")}
    inputs = [x for x in doc.find("input", "select", "textarea") if x.get("type") not in ("hidden", "submit", "button", "image", "reset") and x.get("aria-hidden") != "true"]
    named = [x for x in inputs if (x.get("id") and x.get("id") in labels) or any(x.get(a) for a in ("aria-label", "aria-labelledby", "title")) or any(a.tag == "label" for a in list(x.up())[:10])]
    marks = [n for n in doc.walk() if n.tag in ("main", "nav", "header", "footer", "aside") or n.get("role") in ("main", "navigation", "banner", "contentinfo", "complementary", "search")]
    report = {
        "lang": html.get("lang"), "images": len(images), "no_alt": sum("alt" not in i.attrs for i in images), "h1": levels.count(1), "heading_skip": any(b - a > 1 for a, b in zip(distinct, distinct[1:])),
        "landmarks": len(marks), "inputs": len(inputs), "labelled": len(named), "skip_link": any(a.get("href").startswith("#") and "skip" in a.text.lower() for a in doc.find("a")),
        "reduced_motion": any("prefers-reduced-motion" in s.text for s in doc.find("style")),
    }
    points = (
        (bool(report["lang"]), 20), (not report["no_alt"], 20), (report["h1"] == 1, 15), (bool(levels) and not report["heading_skip"], 10), (report["landmarks"] > 0, 10), (len(named) == len(inputs), 10),
        (report["skip_link"], 5), (report["reduced_motion"], 5), (any(n.tag == "main" for n in marks), 5),
    )
    return report | {"score": sum(p for ok, p in points if ok)}


def performance(doc: Node, headers: dict[str, str]) -> dict:
    """What a page does for speed, and its score (93 at most)."""
    rels = [(x.get("rel").lower(), x.get("as")) for x in doc.find("link")]
    images, styles = doc.find("img"), doc.find("style")
    lazy = sum(i.get("loading").lower() == "lazy" for i in images)
    sources = [i.get("src").lower() for i in images if i.get("src")]
    modern = sum(s.endswith((".webp", ".avif")) or "/webp" in s or "/avif" in s for s in sources) + sum(any(k in s.get("type").lower() for k in ("webp", "avif")) for p in doc.find("picture") for s in p.find("source"))
    legacy = sum(s.endswith((".jpg", ".jpeg", ".png", ".gif")) for s in sources)
    packed = headers.get("content-encoding") or ("gzip" if "accept-encoding" in headers.get("vary", "").lower() else "")
    inline = sum(size(s.text) for s in styles)
    has = lambda rel: any(r == rel for r, _ in rels)
    h3, rules, fonts = "h3" in headers.get("alt-svc", ""), any(s.get("type") == "speculationrules" for s in doc.find("script")), sum(r == "preload" and a == "font" for r, a in rels)
    points = (
        (bool(packed), 15), (bool(headers.get("cache-control")), 12), (bool(headers.get("etag") or headers.get("expires")), 10), (has("preload"), 8), (has("preconnect"), 5), ((lazy * 100 // len(images) if images else 100) >= 50, 8),
        (inline < 10_000, 5), (h3, 5), (has("prefetch"), 2), (not styles, 3), (rules, 5), (fonts > 0, 8), (not legacy, 7),
    )
    return {
        "compression": packed, "images": len(images), "lazy": lazy, "inline_css": inline, "http3": h3, "modern": modern, "legacy": legacy, "preload": has("preload"), "preconnect": has("preconnect"), "prefetch": has("prefetch"),
        "speculation": rules, "fonts": fonts, "score": sum(p for ok, p in points if ok),
    }


def fonts(doc: Node) -> dict:
    """Font families of hosted style sheets and of font faces; repeats next to each other are dropped."""
    google: list[str] = []
    for x in doc.find("link"):
        if "fonts.googleapis.com" in x.get("href"):
            for part in re.findall(r"family=([^&]+)", x.get("href")):
                google += [f.split(":")[0].replace("+", " ") for f in re.split(r"\||%7C", part)]
    google = [f for i, f in enumerate(google) if not i or f != google[i - 1]]
    faces = re.findall(r"""@font-face\s*\{[^}]*font-family\s*:\s*["']?([^;"'}]+)""", "\n".join(s.text for s in doc.find("style")))
    return {"google": google, "adobe": any("use.typekit.net" in (x.get("href") or x.get("src")) for x in doc.find("link", "script")), "faces": [f.strip() for f in faces]}


def progressive(doc: Node) -> dict:
    manifest = any(x.get("rel").lower() == "manifest" for x in doc.find("link"))
    worker = any("serviceWorker.register" in s.text for s in doc.find("script"))
    return {"manifest": manifest, "service_worker": worker, "installable": manifest and worker}


#: Relations of links to descriptions of interfaces, parts of such addresses, and well-known places.
API_RELS = ("api", "service", "service-desc", "describedby")
API_PARTS = re.compile(r"swagger|openapi|api-doc|redoc|rapidoc", re.I)
WELL_KNOWN = re.compile(r"/\.well-known/(?:openid-configuration|oauth-authorization-server|ai-plugin\.json|mcp\.json|host-meta)")
_CALL = re.compile(r"""(?:(fetch)|axios\.(\w+))\s*\(\s*['"]([^'"]+)['"]""")
_SOCKET = re.compile(r"""new\s+WebSocket\s*\(\s*['"]([^'"]+)['"]""")


def inline_scripts(doc: Node) -> list[str]:
    return [s.text for s in doc.find("script") if "src" not in s.attrs]


def interfaces(doc: Node, html: str) -> dict:
    """Calls in inline scripts (each URL once), sockets, forms' targets, frameworks' data, tools for agents, and public descriptions."""
    scripts = inline_scripts(doc)
    calls: dict[str, str] = {}
    for script in scripts:
        fetched = [(m[3], "GET") for m in _CALL.finditer(script) if m[1]]
        for url, verb in [*fetched, *((m[3], m[2].upper()) for m in _CALL.finditer(script) if not m[1])]:
            calls.setdefault(url, verb if verb in ("POST", "PUT", "DELETE", "PATCH") else "GET")
    sockets = [u for script in scripts for u in _SOCKET.findall(script)]
    described = [x.get("href") for x in doc.find("link") if "href" in x.attrs and x.get("rel").lower() in API_RELS]
    documents = [a.get("href") for a in doc.find("a") if API_PARTS.search(a.get("href"))]
    files = [d for d in documents if d.endswith((".json", ".yaml", ".yml"))]
    hints = {"openapi_config_detected": re.search(r"swaggerui|swagger-ui|openapi", html, re.I), "graphql_playground": re.search(r"graphql-playground|graphiql|GraphiQL", html)}
    return {
        "endpoints": [(verb, url) for url, verb in calls.items()], "graphql": any("/graphql" in x or "__schema" in x for x in scripts), "sockets": [u for i, u in enumerate(sockets) if not i or u != sockets[i - 1]],
        "next": any(x.get("id") == "__NEXT_DATA__" for x in doc.find("script")), "nuxt": "__NUXT__" in html, "forms": [f.get("action") for f in doc.find("form") if f.get("action") not in ("", "#")],
        "public": {"links": sorted({*described, *documents}), "openapi": files[-1] if files else None, "well_known": sorted(set(WELL_KNOWN.findall(html))), "hints": sorted(k for k, v in hints.items() if v)},
    }


def tools(doc: Node) -> dict:
    """Tools that forms declare for agents, and whether scripts register any."""
    declared = [{"name": f.get("toolname"), "description": f.get("tooldescription"), "fields": [x.get("name") for x in f.find("input", "select", "textarea") if x.get("name")]} for f in doc.find("form") if f.get("toolname")]
    return {"declared": declared, "registered": any("navigator.modelContext" in x or "modelContext.registerTool" in x for x in inline_scripts(doc))}


def links(doc: Node, base: str) -> dict:
    """Links within and away from a page's site, and where they lead away to."""
    own = host_of(base)
    inside, away, hosts = 0, 0, set()
    for a in doc.find("a"):
        if not a.get("href"):
            continue
        name = host_of(join_url(base, a.get("href")))
        if name and own and name != own and not name.endswith("." + own):
            away += 1
            hosts.add(name)
        else:
            inside += 1
    return {"internal": inside, "external": away, "domains": sorted(hosts), "words": len(next(iter(doc.find("body")), doc).visible().split())}


OG = ("title", "description", "image", "type", "url", "site_name")
TWITTER = ("card", "title", "description", "image", "site")
LONG_DATA = 2048


def _ld_type(value) -> str:
    """The type of linked data, or of the first item of its graph."""
    if not isinstance(value, dict):
        return ""
    graph = value.get("@graph")
    own, first = value.get("@type"), graph[0] if isinstance(graph, list) and graph else None
    inner = first.get("@type") if isinstance(first, dict) else None
    return own if isinstance(own, str) else inner if isinstance(inner, str) else ""


def seo(doc: Node) -> dict:
    """What a page tells search engines and networks: the first meta or link of a name counts; long linked data is cut."""
    metas: dict[tuple[str, str], str] = {}
    rels: dict[str, str] = {}
    languages, data = [], []
    for n in doc.find("meta", "link", "script"):
        if n.tag == "meta":
            for kind in ("property", "name"):
                if n.get(kind):
                    metas.setdefault((kind, n.get(kind)), n.get("content"))
        elif n.tag == "link":
            if "href" in n.attrs:
                rels.setdefault(n.get("rel"), n.get("href"))
                if n.get("rel") == "alternate" and "hreflang" in n.attrs:
                    languages.append((n.get("hreflang"), n.get("href")))
        elif n.get("type") == "application/ld+json":
            try:
                kind = _ld_type(json.loads(n.text))
            except (ValueError, RecursionError):
                kind = ""
            raw = n.text
            if size(raw) > LONG_DATA:
                end = len(raw.encode("utf-8", "surrogatepass")[: LONG_DATA + 1].decode(errors="ignore"))
                raw = f"{raw[:end]}... ({size(raw[end:])} bytes truncated)"
            data.append({"type": kind, "raw": raw})
    return {
        "og": {k: metas.get(("property", f"og:{k}"), "") for k in OG}, "twitter": {k: metas.get(("name", f"twitter:{k}"), "") for k in TWITTER}, "canonical": rels.get("canonical"), "hreflang": languages,
        "robots": metas.get(("name", "robots"), ""), "description": metas.get(("name", "description"), ""), "keywords": metas.get(("name", "keywords"), ""), "favicon": rels.get("icon", rels.get("shortcut icon")), "json_ld": data,
    }


#: Formats of images that are told apart, and parts of addresses that tell networks and platforms.
IMAGE_FORMATS = ("jpg", "jpeg", "png", "webp", "avif", "svg", "gif")
IMAGE_NETWORKS = {"res.cloudinary.com": "Cloudinary", ".cloudinary.com": "Cloudinary", ".imgix.net": "imgix", "imagedelivery.net": "Cloudflare Images", "images.cloudflare.com": "Cloudflare Images", ".akamaized.net": "Akamai", ".akamai.net": "Akamai"}
VIDEO_PLATFORMS = {"youtube.com": "YouTube", "youtu.be": "YouTube", "vimeo.com": "Vimeo"}
AUDIO_PLATFORMS = {"spotify.com": "Spotify", "soundcloud.com": "SoundCloud"}


def _named(table: dict[str, str], address: str, other: str | None) -> str | None:
    return next((name for part, name in table.items() if part in address.lower()), other)


def media_report(doc: Node) -> dict:
    """Counts of a page's images by format, the networks that serve them, and the platforms of videos and audio."""
    images = doc.find("img")
    formats: dict[str, int] = {}
    for i in images:
        if "src" in i.attrs:
            end = i.get("src").split("?")[0].rsplit(".", 1)[-1].lower()
            kind = end if end in IMAGE_FORMATS else "other"
            formats[kind] = formats.get(kind, 0) + 1
    served = {_named(IMAGE_NETWORKS, n.get("src"), None) for n in doc.find("img", "source") if "src" in n.attrs}

    def platforms(tag: str, table: dict[str, str]) -> list[str]:
        own = [next((x.get("src") for x in (n, *n.find("source")) if "src" in x.attrs), None) for n in doc.find(tag)]
        return [_named(table, u, "Other") for u in own if u is not None]

    return {
        "images": len(images), "formats": dict(sorted(formats.items())), "srcset": sum("srcset" in i.attrs for i in images), "pictures": len(doc.find("picture")), "networks": sorted(x for x in served if x),
        "videos": platforms("video", VIDEO_PLATFORMS), "audio": platforms("audio", AUDIO_PLATFORMS),
    }

"""Matches of a reverse image search from the engine's answer pages, in three ways.

Answers come in three shapes: with a map of image keys, whose elements lead to
links; with callbacks that hold nested lists of texts; and as plain links. The
ways are tried in this order, row by row, and the first that finds something
gives the row's matches. Links are found with selectors, the map's keys by one
pass over the elements that name one; callbacks are read by a scanner of
balanced brackets that knows texts, so a bracket in a text ends nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import css, dom
from .pages import _bulk

_KEYED = css.compiled("[data-iid]")
_LINKS = css.compiled("a[href]")
_OWN = re.compile(r"(?:^|\.)(?:google|gstatic|googleusercontent|googleapis)\.[a-z.]+$")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
#: Shortest address after its scheme, and lengths of titles.
LEAST_URL, LEAST_TITLE, LONGEST_TITLE = 10, 2, 200


def balanced(text: str, start: int) -> int:
    """After the bracket that opens at ``start`` is closed; -1 if it isn't. Brackets in quoted texts don't count."""
    pairs, left, i = {"{": "}", "[": "]", "(": ")"}, [], start
    while i < len(text):
        c = text[i]
        if c in "\"'":
            i += 1
            while i < len(text) and text[i] != c:
                i += 2 if text[i] == "\\" else 1
        elif c in pairs:
            left.append(pairs[c])
        elif left and c == left[-1]:
            left.pop()
            if not left:
                return i + 1
        elif c in ")]}":
            return -1
        i += 1
    return -1


def _foreign(url: str) -> bool:
    return url.startswith("http") and not _OWN.search(dom.host_of(url))


def _titled(links: Iterator[dom.Node]) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for a in links:
        if _foreign(a.get("href")):
            found.setdefault(a.get("href"), a.text.strip())
    return list(found.items())


def by_keys(html: str, page: css.Page) -> list[tuple[str, str]]:
    """Links at, around or within elements of the map's image keys, in the order of keys."""
    m = re.search(r"google\.ldi\s*=\s*(?=\{)", html)
    end = balanced(html, m.end()) if m else -1
    if end < 0:
        return []
    try:
        keys = [k for k in json.loads(html[m.end() : end].replace("\\u003d", "=").replace("\\u0026", "&")) if k.startswith("dimg_")]
    except (ValueError, RecursionError):
        return []
    named: dict[str, list[dom.Node]] = {}
    for n in page.select(_KEYED):
        named.setdefault(n.get("data-iid"), []).append(n)

    def links() -> Iterator[dom.Node]:
        for k in sorted(keys):
            at = named.get(k, [])
            yield from (n for n in at if n.tag == "a" and "href" in n.attrs)
            yield from (u for n in at for u in n.up() if u.tag == "a" and "href" in u.attrs)
            yield from (a for n in at for a in n.find("a") if "href" in a.attrs)

    return _titled(links())


def by_callbacks(html: str) -> list[tuple[str, str]]:
    """Addresses in callbacks' data with the texts that may be their titles, in order."""
    found: dict[str, str] = {}
    for m in re.finditer(r"AF_initDataCallback\s*(?=\()", html):
        end = balanced(html, m.end())
        data = re.search(r"\bdata\s*:\s*(?=\[)", html[m.end() : end]) if end > 0 else None
        if not data:
            continue
        start = m.end() + data.end()
        texts = [t for t in _QUOTED.findall(html[start : balanced(html, start)])]
        urls = [t for t in texts if re.match(rf"https?://.{{{LEAST_URL},}}$", t, re.S) and _foreign(t)]
        titles = [t for t in texts if LEAST_TITLE <= len(t) <= LONGEST_TITLE and not t.startswith("http") and "\\" not in t and "{" not in t and any(c.isalpha() for c in t)]
        for i, u in enumerate(urls):
            found.setdefault(u, titles[i] if i < len(titles) else "")
    return list(found.items())


def matches(html: str) -> tuple[str, list[tuple[str, str]]]:
    """The way that found something, and its (url, title) matches."""
    page = css.Page(dom.parse(html))
    for way, found in (("keys", lambda: by_keys(html, page)), ("callbacks", lambda: by_callbacks(html)), ("links", lambda: _titled(page.select(_LINKS)))):
        if rows := found():
            return way, rows
    return "none", []


def lens_matches(answers: DataFrame) -> DataFrame:
    """id, pos, page_url, title, domain and way of all matches in answers (id, body)."""

    def make(row: dict):
        way, found = matches(row["body"] or "")
        for i, (url, title) in enumerate(found):
            yield row["id"], i, url, title, dom.host_of(url).removeprefix("www."), way

    fields = [("id", pa.int64()), ("pos", pa.int32()), ("page_url", pa.string()), ("title", pa.string()), ("domain", pa.string()), ("way", pa.string())]
    return _bulk(answers, ["id", "body"], "id bigint, pos int, page_url string, title string, domain string, way string", fields, make)

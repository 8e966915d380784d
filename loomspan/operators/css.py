"""CSS selectors on the document tree.

A selector is compiled once. Elements of a page are filed by tag, class and id
in document order; a selector starts from the shortest list that its last
compound names and is matched from right to left, so most elements are never
looked at. Types, ids, classes, attributes with all operators and flags, the
four combinators, lists, and the pseudo-classes of ``PLAIN`` and ``WITH`` are
known. Names of elements and attributes are compared in lower case.

A selector that cannot be read raises ValueError when it is compiled, on the
driver; matching never fails.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .dom import Node

_NAME = re.compile(r"(?:[-\w]|[^\x00-\x7F]|\\.)+")
_NTH = re.compile(r"\s*(?:(?P<a>[+-]?\d*)n\s*(?P<b>[+-]\s*\d+)?|(?P<c>[+-]?\d+))\s*$", re.I)
PLAIN = frozenset("first-child last-child only-child first-of-type last-of-type only-of-type empty root".split())
WITH = frozenset("not is where has contains nth-child nth-last-child nth-of-type nth-last-of-type".split())


@dataclass
class Compound:
    tag: str = ""
    id: str = ""
    classes: tuple[str, ...] = ()
    tests: list[Callable[[Node, Page], bool]] = field(default_factory=list)


@dataclass
class Complex:
    """Compounds from left to right; ``links[i]`` is the combinator before ``parts[i]``."""

    parts: list[Compound]
    links: list[str]


@dataclass
class Selector:
    choices: list[Complex]


class Page:
    """A tree with its elements by tag, class and id, and each element's place among its siblings."""

    def __init__(self, root: Node):
        self.root = root
        self.order: dict[int, int] = {}
        self.by_tag: dict[str, list[Node]] = {}
        self.by_class: dict[str, list[Node]] = {}
        self.by_id: dict[str, list[Node]] = {}
        self.all: list[Node] = []
        self._places: dict[int, dict[int, int]] = {}
        for n in root.walk():
            self.order[id(n)] = len(self.all)
            self.all.append(n)
            self.by_tag.setdefault(n.tag, []).append(n)
            for c in n.get("class").split():
                self.by_class.setdefault(c, []).append(n)
            if n.get("id"):
                self.by_id.setdefault(n.get("id"), []).append(n)

    def siblings(self, n: Node) -> list[Node]:
        return [c for c in n.parent.children if not isinstance(c, str)] if n.parent is not None else [n]

    def place(self, n: Node, same: bool, last: bool) -> int:
        """From 1: among all siblings, or those of the same tag; from the end if ``last``."""
        key = (id(n.parent), same, last)
        if key not in self._places:
            counts: dict[str, int] = {}
            places = {}
            for s in reversed(self.siblings(n)) if last else self.siblings(n):
                kind = s.tag if same else ""
                counts[kind] = places[id(s)] = counts.get(kind, 0) + 1
            self._places[key] = places
        return self._places[key].get(id(n), 1)

    def candidates(self, c: Compound) -> list[Node]:
        lists = [self.by_class.get(x, []) for x in c.classes]
        if c.id:
            lists.append(self.by_id.get(c.id, []))
        if c.tag:
            lists.append(self.by_tag.get(c.tag, []))
        return min(lists, key=len) if lists else self.all

    def select(self, selector: Selector) -> list[Node]:
        """Matching elements, each once, in document order."""
        found = {id(n): n for x in selector.choices for n in self.candidates(x.parts[-1]) if self.matches(n, x)}
        return sorted(found.values(), key=lambda n: self.order[id(n)])

    def fits(self, n: Node, c: Compound) -> bool:
        if (c.tag and n.tag != c.tag) or (c.id and n.get("id") != c.id) or (c.classes and not {*c.classes} <= {*n.get("class").split()}):
            return False
        return all(t(n, self) for t in c.tests)

    def matches(self, n: Node, x: Complex, scope: Node | None = None) -> bool:
        """Whether the element fits the last compound and what stands before it; with ``scope``, the first link leads to it."""
        if not self.fits(n, x.parts[-1]):
            return False
        # Compound i fits these elements; each element is tried once for each compound.
        front = [n]
        for i in range(len(x.parts) - 1, -1, -1):
            link = x.links[i]
            if i == 0:
                return scope is None or any(s is scope for m in front for s in self._behind(m, link))
            seen: dict[int, Node] = {}
            for m in front:
                for b in self._behind(m, link):
                    if id(b) not in seen and self.fits(b, x.parts[i - 1]):
                        seen[id(b)] = b
            front = list(seen.values())
            if not front:
                return False
        return True

    def _behind(self, n: Node, link: str) -> Iterator[Node]:
        if link == ">":
            if n.parent is not None:
                yield n.parent
        elif link == " ":
            yield from n.up()
        else:
            around = self.siblings(n)
            at = next((i for i, s in enumerate(around) if s is n), 0)
            yield from around[max(0, at - 1) : at] if link == "+" else around[:at]

    def has(self, n: Node, x: Complex) -> bool:
        within = n.walk() if x.links[0] in " >" else (m for s in (n.parent.children if n.parent is not None else []) if not isinstance(s, str) for m in (s, *s.walk()))
        return any(self.matches(m, x, n) for m in within)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self) -> ValueError:
        return ValueError(f"selector {self.text!r} cannot be read at {self.at}")

    def space(self) -> bool:
        m = re.compile(r"\s*").match(self.text, self.at)
        self.at = m.end()
        return bool(m[0])

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def name(self) -> str:
        m = _NAME.match(self.text, self.at)
        if not m:
            raise self.fail()
        self.at = m.end()
        return re.sub(r"\\(.)", r"\1", m[0])

    def inside(self) -> str:
        """What the parentheses that open here hold."""
        start, depth, quote = self.at + 1, 0, ""
        while self.at < len(self.text):
            c = self.text[self.at]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
            self.at += 1
            if not depth:
                return self.text[start : self.at - 1]
        raise self.fail()

    def choices(self, relative: bool = False) -> list[Complex]:
        out = [self.complex(relative)]
        while self.peek() == ",":
            self.at += 1
            out.append(self.complex(relative))
        if self.at < len(self.text):
            raise self.fail()
        return out

    def complex(self, relative: bool) -> Complex:
        self.space()
        link = " "
        if relative and self.peek() in (">", "+", "~"):
            link = self.peek()
            self.at += 1
            self.space()
        parts, links = [self.compound()], [link]
        while True:
            link = " " if self.space() else ""
            if self.peek() in (">", "+", "~"):
                link = self.peek()
                self.at += 1
                self.space()
            if self.peek() in ("", ","):
                if link not in ("", " "):
                    raise self.fail()
                return Complex(parts, links)
            if not link:
                raise self.fail()
            links.append(link)
            parts.append(self.compound())

    def compound(self) -> Compound:
        c, start = Compound(), self.at
        if self.peek() == "*":
            self.at += 1
        elif _NAME.match(self.text, self.at):
            c.tag = self.name().lower()
        while self.peek() and self.peek() in "#.[:":
            kind = self.peek()
            self.at += 1
            if kind == "#":
                c.id = self.name()
            elif kind == ".":
                c.classes += (self.name(),)
            elif kind == "[":
                c.tests.append(self.attribute())
            else:
                c.tests.append(self.pseudo())
        if self.at == start:
            raise self.fail()
        return c

    def attribute(self) -> Callable[[Node, Page], bool]:
        self.space()
        name = self.name().lower()
        self.space()
        m = re.compile(r"([~|^$*!]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*([iIsS])?\s*").match(self.text, self.at)
        if m:
            self.at = m.end()
        if self.peek() != "]":
            raise self.fail()
        self.at += 1
        if not m:
            return lambda n, _: name in n.attrs
        want = next(g for g in m.groups()[1:4] if g is not None)
        fold = str.lower if (m[5] or "").lower() == "i" else str
        want = fold(want)
        tests: dict[str, Callable[[str], bool]] = {
            "=": lambda v: v == want, "!=": lambda v: v != want, "~=": lambda v: bool(want) and want in v.split(), "|=": lambda v: v == want or v.startswith(f"{want}-"),
            "^=": lambda v: bool(want) and v.startswith(want), "$=": lambda v: bool(want) and v.endswith(want), "*=": lambda v: bool(want) and want in v,
        }
        test = tests[m[1]]
        if m[1] == "!=":
            return lambda n, _: name not in n.attrs or test(fold(n.get(name)))
        return lambda n, _: name in n.attrs and test(fold(n.get(name)))

    def pseudo(self) -> Callable[[Node, Page], bool]:
        name = self.name().lower()
        if name in PLAIN:
            return _plain(name)
        if name not in WITH or self.peek() != "(":
            raise self.fail()
        inner = self.inside()
        if name in ("is", "where", "not"):
            choices = _Reader(inner.strip()).choices()
            return lambda n, p: any(p.matches(n, x) for x in choices) != (name == "not")
        if name == "has":
            choices = _Reader(inner.strip()).choices(relative=True)
            return lambda n, p: any(p.has(n, x) for x in choices)
        if name == "contains":
            text = inner.strip().strip("\"'")
            return lambda n, _: text in n.text
        nth = _NTH.match({"odd": "2n+1", "even": "2n"}.get(inner.strip().lower(), inner))
        if not nth:
            raise self.fail()
        a = 0 if nth["c"] else int(f"{nth['a']}1" if nth["a"] in ("", "+", "-") else nth["a"])
        b = int(nth["c"] or (nth["b"] or "0").replace(" ", ""))
        same, last = "of-type" in name, "last" in name

        def fits(n: Node, p: Page) -> bool:
            k = p.place(n, same, last) - b
            return k == 0 if a == 0 else k % a == 0 and k // a >= 0

        return fits


def _plain(name: str) -> Callable[[Node, Page], bool]:
    same = name.endswith("of-type")
    first = lambda n, p: p.place(n, same, False) == 1
    last = lambda n, p: p.place(n, same, True) == 1
    if name == "empty":
        return lambda n, _: not any(not isinstance(c, str) or c for c in n.children)
    if name == "root":
        return lambda n, p: n.parent is p.root
    return first if name.startswith("first") else last if name.startswith("last") else lambda n, p: first(n, p) and last(n, p)


def compiled(selector: str) -> Selector:
    return Selector(_Reader(selector.strip()).choices())

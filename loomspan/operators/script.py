"""What inline scripts say, without running them.

``tokens`` splits a script into names, strings, templates, numbers, regular
expressions and marks; comments are dropped, and a slash begins a regular
expression only where a value may begin. ``calls`` follows statements of the
outermost level (blocks and branches, not bodies of functions) and finds calls
and assignments that can run or inject code. ``state`` evaluates what
statements assign to global names: literals in all their forms, joined texts,
``JSON.parse``, ``Object.assign``, ``push``, members, and names known before.
Nothing of a page is executed; what is not understood has no value.

A script whose brackets or strings do not close has no calls, like one that
does not compile; its state is what was read before that place.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

_SPACE = re.compile(r"(?:[\s\ufeff]|//[^\n\r]*|/\*.*?\*/|<!--[^\n\r]*)+", re.S)
_NAME = re.compile(r"(?:[\w$]|[^\x00-\x7F])(?:[\w$]|[^\x00-\x7F])*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = {q: re.compile(rf"{q}((?:[^{q}\\\n\r]|\\.)*){q}", re.S) for q in "\"'"}
_REGEX = re.compile(r"/((?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+)/\w*")
_MARK = re.compile(r">>>=|\.\.\.|===|!==|>>>|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
#: Words after which a value begins, so that a slash begins a regular expression.
_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r": ""}
#: Parts of nested values and of expressions that are followed, and characters of a script that are read.
DEEPEST, LONGEST = 200, 2_000_000


class Token(NamedTuple):
    kind: str  # name, text, template, number, regex, mark
    text: str
    line: bool  # a line ends before it


class Malformed(ValueError):
    pass


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        s = m[1]
        if s[0] in "xu" and len(s) > 1:
            code = int(s[1:].strip("{}"), 16)
            return chr(code) if code <= 0x10FFFF else ""
        return _ESCAPES.get(s, s)

    out = re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, text, flags=re.S)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", out) else out


def _template_end(script: str, at: int) -> int:
    """After the template that begins at ``at``, with all that its holes hold."""
    holes = [0]  # open braces of each hole; the first is the template itself
    inside = True
    i = at + 1
    while i < len(script):
        c = script[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == "`":
                holes.pop()
                if not holes:
                    return i + 1
                inside = False
            elif c == "$" and script[i + 1 : i + 2] == "{":
                holes[-1] = 1
                inside = False
                i += 1
        elif c in "\"'":
            m = _STRING[c].match(script, i)
            if not m:
                raise Malformed(f"a text does not end at {i}")
            i = m.end() - 1
        elif c == "`":
            holes.append(0)
            inside = True
        elif c in "{}":
            holes[-1] += 1 if c == "{" else -1
            inside = holes[-1] == 0
        i += 1
    raise Malformed(f"a template does not end at {at}")


def tokens(script: str) -> list[Token]:
    """Raises Malformed where a text, template or comment does not end."""
    out: list[Token] = []
    at, line, n = 0, False, len(script)
    while at < n:
        m = _SPACE.match(script, at)
        if m:
            line |= "\n" in m[0] or "\r" in m[0]
            at = m.end()
            continue
        c = script[at]
        before = out[-1] if out else None
        value = before is None or (before.kind == "mark" and before.text not in (")", "]", "}", "++", "--")) or (before.kind == "name" and before.text in _BEFORE_VALUE)
        if c in "\"'":
            m, kind = _STRING[c].match(script, at), "text"
        elif c == "`":
            end = _template_end(script, at)
            out.append(Token("template", script[at + 1 : end - 1], line))
            at, line = end, False
            continue
        elif c.isdigit() or (c == "." and script[at + 1 : at + 2].isdigit()):
            m, kind = _NUMBER.match(script, at), "number"
        elif c == "/" and script[at + 1 : at + 2] != "*" and value:
            m, kind = _REGEX.match(script, at), "regex"
        elif c.isalnum() or c in "_$" or ord(c) > 127:
            m, kind = _NAME.match(script, at), "name"
        else:
            m, kind = _MARK.match(script, at), "mark"
        if not m:
            raise Malformed(f"nothing begins with {c!r} at {at}")
        out.append(Token(kind, _unescape(m[1]) if kind == "text" else m[0], line))
        at, line = m.end(), False
    return out


def partners(toks: list[Token]) -> dict[int, int]:
    """For each opening bracket its closing one; raises Malformed if any lacks it."""
    out, left = {}, []
    for i, t in enumerate(toks):
        if t.kind == "mark" and t.text in _OPEN:
            left.append(i)
        elif t.kind == "mark" and t.text in _CLOSE:
            if not left or _OPEN[toks[left[-1]].text] != t.text:
                raise Malformed(f"{t.text} closes nothing")
            out[left.pop()] = i
    if left:
        raise Malformed("a bracket does not close")
    return out


class _Script:
    """Statements and expressions as ranges of tokens."""

    def __init__(self, script: str):
        self.toks = tokens(script[:LONGEST])
        self.partner = partners(self.toks)

    def mark(self, i: int, *texts: str) -> bool:
        return i < len(self.toks) and self.toks[i].kind == "mark" and self.toks[i].text in texts

    def word(self, i: int, *texts: str) -> bool:
        return i < len(self.toks) and self.toks[i].kind == "name" and self.toks[i].text in texts

    def past(self, i: int) -> int:
        """After the token, or after all that a bracket holds."""
        return self.partner.get(i, i) + 1

    def ends_value(self, i: int) -> bool:
        t = self.toks[i]
        return t.kind != "mark" and not (t.kind == "name" and t.text in _BEFORE_VALUE) or t.text in (")", "]", "}", "++", "--")

    def expression_end(self, i: int, end: int) -> int:
        """Where the expression of a statement ends: at a semicolon, a closing bracket, or a line that begins anew."""
        start = i
        while i < end:
            if self.mark(i, ";") or self.mark(i, ")", "]", "}"):
                return i
            t = self.toks[i]
            if t.line and i > start and self.ends_value(i - 1) and (t.kind in ("name", "text", "number", "regex") and t.text not in ("in", "instanceof", "of") or t.text in ("++", "--", "!", "~", "{", "@", "#")):
                return i
            i = self.past(i)
        return end

    def split(self, start: int, end: int, *marks: str) -> list[tuple[int, int]]:
        """Parts between marks of this level."""
        out, i, at = [], start, start
        while i < end:
            if self.mark(i, *marks):
                out.append((at, i))
                at = i + 1
            i = self.past(i)
        return [*out, (at, end)]

    def find(self, start: int, end: int, *marks: str) -> int:
        i = start
        while i < end:
            if self.mark(i, *marks):
                return i
            i = self.past(i)
        return -1

    def chain(self, start: int, end: int) -> list[tuple[str, object]] | None:
        """A value with its members and calls: (name, x), (member, x), (computed, range), (call, range), (group, range), (text, x); None for anything else."""
        if start >= end:
            return None
        t = self.toks[start]
        if self.mark(start, "("):
            out: list[tuple[str, object]] = [("group", (start + 1, self.partner[start]))]
        elif t.kind == "name":
            out = [("name", t.text)]
        elif t.kind == "text":
            out = [("text", t.text)]
        else:
            return None
        i = self.past(start)
        while i < end:
            if self.mark(i, ".") and i + 1 < end and self.toks[i + 1].kind == "name":
                out.append(("member", self.toks[i + 1].text))
                i += 2
            elif self.mark(i, "["):
                out.append(("computed", (i + 1, self.partner[i])))
                i = self.past(i)
            elif self.mark(i, "("):
                out.append(("call", (i + 1, self.partner[i])))
                i = self.past(i)
            else:
                return None
        return out

    def key(self, part: tuple[str, object]) -> str | None:
        """The name that a member or a computed text names."""
        if part[0] == "member":
            return str(part[1])
        if part[0] == "computed":
            a, b = part[1]
            if b == a + 1 and self.toks[a].kind == "text":
                return self.toks[a].text
        return None

    def statements(self, start: int, end: int, into: frozenset[str]):
        """Ranges of expressions and declared values, in order: (name or "", start, end). ``into``: further kinds that are entered (try, function)."""
        i = start
        while i < end:
            if self.mark(i, ";", ","):
                i += 1
            elif self.mark(i, "{"):
                yield from self.statements(i + 1, self.partner[i], into)
                i = self.past(i)
            elif self.word(i, "if") and self.mark(i + 1, "("):
                yield "", i + 2, self.partner[i + 1]
                i = self.past(i + 1)
            elif self.word(i, "else"):
                i += 1
            elif self.word(i, "var", "let", "const") and i + 1 < end:
                stop = self.expression_end(i + 1, end)
                for a, b in self.split(i + 1, stop, ","):
                    eq = self.find(a, b, "=")
                    if eq > 0:
                        yield self.toks[a].text if eq == a + 1 else "", eq + 1, b
                i = stop
            elif self.word(i, "try", "finally") and self.mark(i + 1, "{"):
                if "try" in into:
                    yield from self.statements(i + 2, self.partner[i + 1], into)
                i = self.past(i + 1)
            elif self.word(i, "catch"):
                i = self.past(i + 1) if self.mark(i + 1, "(") else i + 1
                i = self.past(i)
            elif self.word(i, "function", "class", "async") and not (self.word(i, "async") and not self.word(i + 1, "function")):
                body = next((j for j in self.level(i, end) if self.mark(j, "{")), end - 1)
                i = self.past(body)
            elif self.word(i, "for", "while", "switch", "with"):
                i = self.past(i + 1) if self.mark(i + 1, "(") else self.past(i + 2)
                i = self.past(i) if self.mark(i, "{") else self.expression_end(i, end)
            elif self.word(i, "do"):
                i = self.past(i + 1)
                i = self.past(i + 1) if self.word(i, "while") and self.mark(i + 1, "(") else i
            elif self.word(i, "return", "throw", "break", "continue", "import", "export"):
                i = max(i + 1, self.expression_end(i + 1, end))
            elif i + 1 < end and self.toks[i].kind == "name" and self.mark(i + 1, ":"):
                i += 2
            else:
                stop = self.expression_end(i, end)
                yield "", i, stop
                i = max(stop, i + 1) if not self.mark(stop, ")", "]", "}") else stop + 1

    def level(self, start: int, end: int):
        i = start
        while i < end:
            yield i
            i = self.past(i)


#: Names of findings, and severities.
CALLS = {"eval": "high", "Function": "high", "document.write": "medium", "setTimeout-string": "medium", "innerHTML": "medium", "outerHTML": "medium"}

#: Markup without any of these has no such calls.
HINT = "eval|Function|document|setTimeout|setInterval|innerHTML|outerHTML"


def calls(script: str) -> list[str]:
    """Names of ``CALLS`` that statements of the outermost level make, in order."""
    try:
        s = _Script(script)
    except Malformed:
        return []
    out: list[str] = []

    def named(callee: list, name: str) -> bool:
        return callee == [("name", name)] or (len(callee) == 2 and callee[0] == ("name", "window") and s.key(callee[1]) == name)

    def walk(a: int, b: int, depth: int = 0) -> None:
        parts = s.split(a, b, ",")
        if depth > DEEPEST or a >= b:
            return
        if len(parts) > 1:
            for x, y in parts:
                walk(x, y, depth + 1)
            return
        arrow, eq = s.find(a, b, "=>"), s.find(a, b, *_ASSIGN)
        if arrow >= 0 and (eq < 0 or arrow < eq):
            return
        if eq >= 0:
            target = s.chain(a, eq)
            if target and len(target) > 1 and s.key(target[-1]) in ("innerHTML", "outerHTML"):
                out.append(s.key(target[-1]))
            walk(eq + 1, b, depth + 1)
            return
        new = s.word(a, "new")
        chain = s.chain(a + new, b)
        if not chain or s.word(a, "function", "class", "async"):
            return
        if new:
            callee = chain[: next((i for i, p in enumerate(chain) if p[0] == "call"), len(chain))]
            if len(callee) >= len(chain) - 1:
                if named(callee, "Function"):
                    out.append("Function")
                return
        if chain[-1][0] != "call":
            return
        callee, (x, y) = chain[:-1], chain[-1][1]
        args = s.split(x, y, ",") if x < y else []
        if not new and named(callee, "eval"):
            out.append("eval")
        elif not new and named(callee, "Function"):
            out.append("Function")
        elif len(callee) == 2 and callee[0] == ("name", "document") and s.key(callee[1]) in ("write", "writeln"):
            out.append("document.write")
        elif (named(callee, "setTimeout") or named(callee, "setInterval")) and args and args[0][1] == args[0][0] + 1 and s.toks[args[0][0]].kind == "text":
            out.append("setTimeout-string")
        for x, y in args:
            walk(x, y, depth + 1)

    for _, a, b in s.statements(0, len(s.toks), frozenset()):
        walk(a, b)
    return out


class _Unknown(Exception):
    pass


#: A value that JSON leaves out: undefined or a function.
NOTHING = type("Nothing", (), {"__bool__": lambda self: False, "__repr__": lambda self: "NOTHING"})()
_GLOBALS = ("window", "self", "globalThis")
_LITERALS = {"true": True, "false": False, "null": None, "undefined": NOTHING, "NaN": None, "Infinity": None}


class _Evaluator:
    def __init__(self, s: _Script, names: dict[str, object]):
        self.s, self.names = s, names

    def value(self, a: int, b: int, depth: int = 0) -> object:
        s = self.s
        if a >= b or depth > DEEPEST:
            raise _Unknown
        eq = s.find(a, b, "=")
        if eq > 0 and s.find(a, b, "=>") < 0:
            found = self.value(eq + 1, b, depth + 1)
            self.assign(a, eq, found)
            return found
        parts = s.split(a, b, ",")
        if len(parts) > 1:
            return [self.value(x, y, depth + 1) for x, y in parts][-1]
        if s.find(a, b, "=>") >= 0 or s.word(a, "function", "class", "async"):
            return NOTHING
        for op in ("??", "||", "&&"):
            parts = s.split(a, b, op)
            if len(parts) > 1:
                return self.either(op, parts, depth)
        if s.find(a, b, "?", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "*", "/", "%", "&", "|", "^", "**", "<<", ">>", ">>>", "?.") >= 0:
            raise _Unknown
        signs = [x for x in self.sums(a, b)]
        if len(signs) > 1:
            return self.joined([self.value(x, y, depth + 1) for x, y in signs])
        return self.single(a, b, depth)

    def either(self, op: str, parts: list[tuple[int, int]], depth: int) -> object:
        found: object = NOTHING
        for x, y in parts:
            try:
                found = self.value(x, y, depth + 1)
            except _Unknown:
                if op == "&&" or (x, y) == parts[-1]:
                    raise
                continue  # a name that is not known yet is taken as undefined: x = x || {}
            true = found is not None and found is not NOTHING if op == "??" else isinstance(found, list | dict) or bool(found)
            if true != (op == "&&"):
                return found
        return found

    def sums(self, a: int, b: int):
        """Parts between plus signs that add."""
        at = a
        for i in self.s.level(a, b):
            if self.s.mark(i, "+") and i > at and self.s.ends_value(i - 1):
                yield at, i
                at = i + 1
            elif self.s.mark(i, "-") and i > at and self.s.ends_value(i - 1):
                raise _Unknown
        yield at, b

    def joined(self, values: list[object]) -> object:
        number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
        out = values[0]
        for v in values[1:]:
            if number(out) and number(v):
                out += v
            elif isinstance(out, str) and (isinstance(v, str) or number(v)) or isinstance(v, str) and number(out):
                out = f"{out}{v}"
            else:
                raise _Unknown
        return out

    def single(self, a: int, b: int, depth: int) -> object:
        s, t = self.s, self.s.toks[a]
        if s.mark(a, "!", "-", "+") or s.word(a, "void", "typeof", "await"):
            found = self.value(a + 1, b, depth + 1)
            if t.text == "!":
                return not (isinstance(found, list | dict) or bool(found))
            if t.text == "void":
                return NOTHING
            if t.text in "+-" and isinstance(found, int | float):
                return -found if t.text == "-" else found
            raise _Unknown
        if b == a + 1:
            if t.kind == "text":
                return t.text
            if t.kind == "template" and "${" not in t.text:
                return _unescape(t.text)
            if t.kind == "number":
                return _number(t.text)
            if t.kind == "name":
                if t.text in _LITERALS:
                    return _LITERALS[t.text]
                return self.known(t.text)
            raise _Unknown
        if s.mark(a, "[") and s.past(a) == b:
            return self.items(a + 1, b - 1, depth)
        if s.mark(a, "{") and s.past(a) == b:
            return self.members(a + 1, b - 1, depth)
        if s.mark(a, "(") and s.past(a) == b:
            return self.value(a + 1, b - 1, depth + 1)
        return self.reached(a, b, depth)

    def known(self, name: str) -> object:
        if name in _GLOBALS:
            return self.names
        if name not in self.names:
            raise _Unknown
        return self.names[name]

    def items(self, a: int, b: int, depth: int) -> list:
        out = []
        parts = self.s.split(a, b, ",") if a < b else []
        for i, (x, y) in enumerate(parts):
            if x == y:
                if i < len(parts) - 1:
                    out.append(None)  # a hole
            elif self.s.mark(x, "..."):
                more = self.value(x + 1, y, depth + 1)
                if not isinstance(more, list):
                    raise _Unknown
                out += more
            else:
                out.append(self.lenient(x, y, depth))
        return out

    def lenient(self, a: int, b: int, depth: int) -> object:
        """A part that is not understood is left out, as a function would be; the rest of the value stays."""
        try:
            return self.value(a, b, depth + 1)
        except _Unknown:
            return NOTHING

    def members(self, a: int, b: int, depth: int) -> dict:
        s, out = self.s, {}
        for x, y in s.split(a, b, ",") if a < b else []:
            if x == y:
                continue
            if s.mark(x, "..."):
                more = self.value(x + 1, y, depth + 1)
                if isinstance(more, dict):
                    out |= more
                continue
            colon = s.find(x, y, ":")
            if s.mark(x, "["):
                key = s.key(("computed", (x + 1, s.partner[x])))
            else:
                t = s.toks[x]
                key = str(_number(t.text)) if t.kind == "number" else t.text
            if colon < 0:  # a short name or a method
                if y == x + 1 and key in self.names:
                    out[key] = self.names[key]
                continue
            if key is not None:
                out[key] = self.lenient(colon + 1, y, depth)
        return out

    def reached(self, a: int, b: int, depth: int) -> object:
        """A value behind members and calls."""
        s = self.s
        chain = s.chain(a, b)
        if not chain or s.word(a, "new"):
            raise _Unknown
        if chain[-1][0] == "call":
            args = lambda: self.items(*chain[-1][1], depth + 1)
            path = [chain[0][1], *(s.key(p) for p in chain[1:-1])] if chain[0][0] == "name" else []
            if path == ["JSON", "parse"]:
                (text, *_) = args() or [None]
                try:
                    return json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    raise _Unknown from None
            if path in (["Object", "assign"], ["Object", "freeze"]):
                parts = args()
                if not parts or not all(isinstance(p, dict) or p is NOTHING or p is None for p in parts) or not isinstance(parts[0], dict):
                    raise _Unknown
                for p in parts[1:]:
                    parts[0].update(p or {})
                return parts[0]
            if len(chain) > 2 and s.key(chain[-2]) == "push":
                held = self.behind(chain[:-2], depth)
                if not isinstance(held, list):
                    raise _Unknown
                held += args()
                return len(held)
            if chain[0][0] == "group" and len(chain) == 2 and s.word(chain[0][1][0], "function"):
                return self.run(*chain[0][1])
            if chain[0][0] == "group" and len(chain) == 2 and s.find(*chain[0][1], "=>") >= 0:
                return self.run(*chain[0][1])
            raise _Unknown
        return self.behind(chain, depth)

    def run(self, a: int, b: int) -> object:
        """Statements of a function that is called where it stands."""
        body = next((j for j in self.s.level(a, b) if self.s.mark(j, "{")), None)
        if body is not None:
            self.statements(body + 1, self.s.partner[body])
        return NOTHING

    def behind(self, chain: list, depth: int) -> object:
        kind, first = chain[0]
        found = self.known(first) if kind == "name" else first if kind == "text" else self.value(*first, depth + 1)
        for part in chain[1:]:
            key = self.s.key(part)
            if part[0] == "computed" and key is None:
                key = self.value(*part[1], depth + 1)
            if isinstance(found, dict) and isinstance(key, str) and key in found:
                found = found[key]
            elif isinstance(found, list) and isinstance(key, int) and 0 <= key < len(found):
                found = found[key]
            else:
                raise _Unknown
        return found

    def assign(self, a: int, b: int, found: object) -> None:
        chain = self.s.chain(a, b)
        if not chain or chain[0][0] != "name":
            raise _Unknown
        if len(chain) == 1:
            self.names[chain[0][1]] = found
            return
        held, key = self.behind(chain[:-1], 0), self.s.key(chain[-1])
        if not isinstance(held, dict) or key is None:
            raise _Unknown
        held[key] = found

    def statements(self, a: int, b: int) -> None:
        for name, x, y in self.s.statements(a, b, frozenset({"try"})):
            try:
                found = self.value(x, y)
            except (_Unknown, RecursionError):
                continue
            if name:
                self.names[name] = found


def _number(text: str) -> int | float:
    text = text.replace("_", "").rstrip("n") or "0"
    try:
        return int(text, 0) if re.match(r"0[xXbBoO]", text) else int(text) if text.isdigit() else float(text)
    except ValueError:
        return 0


def _plain(value: object, depth: int = 0) -> object:
    """The value as JSON has it: what has no value is left out of objects and null in lists."""
    if depth > DEEPEST:
        raise _Unknown
    if isinstance(value, dict):
        return {k: _plain(v, depth + 1) for k, v in value.items() if v is not NOTHING}
    if isinstance(value, list):
        return [_plain(v, depth + 1) for v in value]
    if isinstance(value, float):
        return int(value) if value.is_integer() and abs(value) < 1e15 else value if abs(value) < 1e308 else None
    return None if value is NOTHING else value


#: State of fewer characters is left out.
LEAST_STATE = 100


def state(scripts: list[str]) -> list[tuple[str, str]]:
    """Name and JSON of the global objects and lists that scripts leave behind under names with two underscores first."""
    names: dict[str, object] = {"__next_f": []}
    for script in scripts:
        if "__" not in script:
            continue
        try:
            s = _Script(script)
        except Malformed:
            continue
        _Evaluator(s, names).statements(0, len(s.toks))
    out = []
    for name, value in names.items():
        if name.startswith("__") and isinstance(value, list | dict):
            try:
                text = json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"))
            except (_Unknown, RecursionError, ValueError):
                continue
            if len(text) > LEAST_STATE:
                out.append((name, text))
    return out

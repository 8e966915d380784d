"""Products that protect pages, found by marks in cookies, headers, markup and addresses.

Rules are a table given by the caller; ``RULES`` are our own, of publicly known
marks. They are compiled once: exact cookies and headers are looked up by name,
prefixes by their lengths, and every expression is filed under texts of which a
match must hold one. One automaton over these texts reads each text of a page
once, and only the expressions that it names are run. So the cost of a page is
that of its texts and of its hits, not of the number of rules.

A product has eight classes of marks: cookies by name, by prefix and by
expression; headers by name (and part of the value) and by an expression on
the name; expressions for scripts, for markup, and for the address. Each class
that has a mark adds the boost of its kind once; confidence stops at 100.

Defined results: null texts, headers and cookies have no marks; names of
cookies and headers are compared in lower case, expressions on cookies read
them as they are; of several marks of a class the first in the rule is named;
repeated pages are judged again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:  # the parser of expressions has had two names
    from re import _constants as sre_constants
    from re import _parser as sre_parse
except ImportError:
    import sre_constants
    import sre_parse

CLASSES = ("cookies", "cookies_prefix", "cookies_regex", "headers", "headers_regex", "scripts", "html_patterns", "url_patterns")
#: The kind whose boost a class adds.
KIND = {"cookies": "cookies", "cookies_prefix": "cookies", "cookies_regex": "cookies", "headers": "headers", "headers_regex": "headers", "scripts": "scripts", "html_patterns": "html_patterns", "url_patterns": "url_patterns"}
#: Categories that the summary has a flag for.
FLAGS = {"has_waf": "waf", "has_bot_detection": "bot_detection", "has_captcha": "captcha", "has_fingerprinting": "fingerprinting", "has_auth_security": "auth_security"}


@dataclass(frozen=True)
class Rule:
    """``signals``: class to marks, in order (headers: name to part of the value); ``boost``: kind to points."""

    name: str
    category: str
    boost: dict[str, int]
    signals: dict[str, tuple] = field(default_factory=dict)


#: Our own rules, of marks that are public knowledge.
RULES = (
    Rule("Cloudflare", "waf", {"headers": 60, "cookies": 40, "html_patterns": 40, "url_patterns": 30}, {"cookies": ("cf_clearance", "__cf_bm"), "headers": (("server", "cloudflare"), ("cf-ray", "")), "html_patterns": ("challenge-platform|_cf_chl_opt",), "url_patterns": (r"/cdn-cgi/(?:challenge|l/chk)",)}),
    Rule("Akamai", "waf", {"headers": 60}, {"headers": (("server", "akamai"),), "headers_regex": (r"^x-akamai-",)}),
    Rule("Akamai Bot Manager", "bot_detection", {"cookies": 60}, {"cookies": ("_abck", "bm_sz"), "cookies_prefix": ("ak_bmsc",)}),
    Rule("DataDome", "bot_detection", {"cookies": 70, "headers": 50, "scripts": 50}, {"cookies": ("datadome",), "headers": (("x-datadome", ""),), "scripts": (r"js\.datadome\.co",)}),
    Rule("PerimeterX", "bot_detection", {"cookies": 60, "scripts": 50}, {"cookies_prefix": ("_px",), "scripts": (r"client\.perimeterx\.net", r"px-cdn\.net")}),
    Rule("Imperva", "waf", {"cookies": 70, "headers": 40}, {"cookies_prefix": ("incap_ses_", "visid_incap_"), "headers": (("x-iinfo", ""),)}),
    Rule("AWS WAF", "waf", {"cookies": 70, "headers": 40}, {"cookies": ("aws-waf-token",), "headers_regex": (r"^x-amzn-waf-",)}),
    Rule("F5 BIG-IP", "waf", {"cookies": 60}, {"cookies_prefix": ("BIGipServer",), "cookies_regex": (r"^TS[0-9a-f]{6,}$",)}),
    Rule("reCAPTCHA", "captcha", {"scripts": 60, "html_patterns": 40}, {"scripts": (r"google\.com/recaptcha", r"recaptcha\.net/recaptcha"), "html_patterns": (r"class=[\"'][^\"']*g-recaptcha",)}),
    Rule("hCaptcha", "captcha", {"scripts": 60, "html_patterns": 40}, {"scripts": (r"hcaptcha\.com/1/api\.js",), "html_patterns": (r"class=[\"'][^\"']*h-captcha",)}),
    Rule("Turnstile", "captcha", {"scripts": 60, "html_patterns": 40}, {"scripts": (r"challenges\.cloudflare\.com/turnstile",), "html_patterns": (r"class=[\"'][^\"']*cf-turnstile",)}),
    Rule("Fingerprint", "fingerprinting", {"scripts": 70}, {"scripts": (r"(?:fpjs|fpcdn|fpnpmcdn)\.(?:io|net)", r"FingerprintJS\.load")}),
    Rule("Auth0", "auth_security", {"cookies": 50, "url_patterns": 50, "scripts": 40}, {"cookies_prefix": ("auth0",), "scripts": (r"cdn\.auth0\.com",), "url_patterns": (r"^https?://[^/]+\.auth0\.com/",)}),
    Rule("Okta", "auth_security", {"url_patterns": 60, "scripts": 50}, {"scripts": (r"okta-sign-in(?:\.min)?\.js",), "url_patterns": (r"^https?://[^/]+\.okta(?:preview)?\.com/",)}),
    Rule("nginx", "server", {"headers": 30}, {"headers": (("server", "nginx"),)}),
)
LEAST_LITERAL = 3


def needed_texts(pattern: str) -> set[str] | None:
    """Lower-case texts of which a match of the expression must hold one; None if there are none of ``LEAST_LITERAL`` characters."""

    def best(options: list[set[str] | None]) -> set[str] | None:
        options = [o for o in options if o]
        return max(options, key=lambda o: (min(map(len, o)), -len(o))) if options else None

    def of(items) -> set[str] | None:
        options: list[set[str] | None] = []
        run = ""
        for kind, arg in items:
            if kind is sre_constants.LITERAL:
                run += chr(arg).lower()
                continue
            if run:
                options.append({run})
                run = ""
            if kind is sre_constants.SUBPATTERN:
                options.append(of(arg[3]))
            elif kind is sre_constants.BRANCH:
                parts = [of(x) for x in arg[1]]
                options.append(set().union(*parts) if all(parts) else None)
            elif kind in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[0] > 0:
                options.append(of(arg[2]))
        if run:
            options.append({run})
        return best(options)

    found = of(sre_parse.parse(pattern))
    return found if found and min(map(len, found)) >= LEAST_LITERAL else None


class _Filed:
    """Expressions of one kind of text, filed under the texts that they need."""

    def __init__(self, patterns: list[tuple[tuple[int, str, int], str]]):
        self.compiled = {at: re.compile(p) for at, p in patterns}
        self.always = []
        by_text: dict[str, list] = {}
        for at, p in patterns:
            texts = needed_texts(p)
            if texts is None:
                self.always.append(at)
            for t in texts or ():
                by_text.setdefault(t, []).append(at)
        self.automaton = ahocorasick.Automaton()
        for t, places in by_text.items():
            self.automaton.add_word(t, places)
        if by_text:
            self.automaton.make_automaton()

    def matching(self, text: str, parts: list[str] | None = None) -> set[tuple[int, str, int]]:
        """Places of the expressions that match the text (or any of ``parts``, whose lines it is)."""
        named = set(self.always)
        if len(self.automaton):
            for _, places in self.automaton.iter(text.lower()):
                named.update(places)
        return {at for at in named if any(self.compiled[at].search(p) for p in (parts if parts is not None else (text,)))}


class Matcher:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.cookies: dict[str, list] = {}
        self.prefixes: dict[str, list] = {}
        self.headers: dict[str, list] = {}
        patterns: dict[str, list] = {c: [] for c in ("cookies_regex", "headers_regex", "html", "url_patterns")}
        for i, rule in enumerate(rules):
            for kind, marks in rule.signals.items():
                if KIND[kind] not in rule.boost:
                    continue
                for j, mark in enumerate(marks):
                    at = (i, kind, j)
                    if kind == "cookies":
                        self.cookies.setdefault(mark.lower(), []).append(at)
                    elif kind == "cookies_prefix":
                        self.prefixes.setdefault(mark.lower(), []).append(at)
                    elif kind == "headers":
                        self.headers.setdefault(mark[0].lower(), []).append((at, mark[1].lower()))
                    else:
                        patterns["html" if kind in ("scripts", "html_patterns") else kind].append((at, mark))
        self.lengths = sorted({len(p) for p in self.prefixes})
        self.filed = {k: _Filed(v) for k, v in patterns.items()}

    def match(self, headers: dict[str, str], cookies: list[str], html: str, url: str) -> list[tuple[str, str, int, list[str]]]:
        """name, category, confidence and marks of each product, the surest first, then in the order of rules."""
        hits: set[tuple[int, str, int]] = set()
        for name in {c.lower() for c in cookies}:
            hits.update(self.cookies.get(name, ()))
            for n in self.lengths:
                hits.update(self.prefixes.get(name[:n], ()) if len(name) >= n else ())
        names = [k.lower() for k in headers]
        for name, value in headers.items():
            hits.update(at for at, part in self.headers.get(name.lower(), ()) if part in (value or "").lower())
        hits |= self.filed["cookies_regex"].matching("\n".join(cookies), cookies)
        hits |= self.filed["headers_regex"].matching("\n".join(names), names)
        hits |= self.filed["html"].matching(html)
        hits |= self.filed["url_patterns"].matching(url)
        first: dict[tuple[int, str], int] = {}
        for i, kind, j in hits:
            first[i, kind] = min(j, first.get((i, kind), j))
        found = []
        for i in sorted({i for i, _ in first}):
            rule = self.rules[i]
            kinds = [k for k in CLASSES if (i, k) in first]
            marks = [f"{k}:{m[0] if k == 'headers' else m}" for k in kinds for m in (rule.signals[k][first[i, k]],)]
            confidence = min(100, sum(rule.boost[KIND[k]] for k in kinds))
            if confidence:
                found.append((rule.name, rule.category, confidence, marks))
        return sorted(found, key=lambda x: -x[2])


DETECTION = "array<struct<name: string, category: string, confidence: int, marks: array<string>>>"
_ARROW = pa.list_(pa.struct([("name", pa.string()), ("category", pa.string()), ("confidence", pa.int32()), ("marks", pa.list_(pa.string()))]))


def with_protection(responses: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``responses`` (url, html, headers, set_cookies, others) with ``detections`` and the flags of ``FLAGS``."""
    from .pages import _beside

    held: list[Matcher] = []

    def make(row: dict) -> tuple:
        if not held:  # once in a task
            held.append(Matcher(rules))
        names = [c.split("=", 1)[0].strip() for c in row["set_cookies"] or [] if c]
        found = held[0].match(dict(row["headers"] or {}), names, row["html"] or "", row["url"] or "")
        return ([{"name": n, "category": c, "confidence": k, "marks": m} for n, c, k, m in found],)

    rows = _beside(responses, ["url", "html", "headers", "set_cookies"], [], [("detections", DETECTION, _ARROW)], make)
    return rows.withColumns({flag: _has(category) for flag, category in FLAGS.items()})


def _has(category: str) -> Column:
    return F.exists("detections", lambda d: d["category"] == category)


#: What a login page without a kind of protection is told, and how severe that is.
LOGIN_FINDINGS = {"no_captcha": ("medium", "guesses of passwords meet no puzzle"), "no_bot_detection": ("high", "nothing tells programs from people"), "no_fingerprinting": ("low", "devices are not told apart")}


def login_findings() -> Column:
    """check, severity and detail of what a login page (a row of ``with_protection``) lacks; a test for programs is as good as a puzzle, a wall as a test."""
    lacks = {"no_captcha": ~F.col("has_captcha") & ~F.col("has_bot_detection"), "no_bot_detection": ~F.col("has_bot_detection") & ~F.col("has_waf"), "no_fingerprinting": ~F.col("has_fingerprinting")}
    found = F.array(*(F.when(lacks[c], F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.lit(d).alias("detail"))) for c, (s, d) in LOGIN_FINDINGS.items()))
    return F.filter(found, lambda f: f.isNotNull())


def detections(protected: DataFrame) -> DataFrame:
    """A row for each product of each page: page_id, name, category, confidence, marks."""
    return protected.select("page_id", F.explode("detections").alias("d")).select("page_id", "d.name", "d.category", "d.confidence", "d.marks")

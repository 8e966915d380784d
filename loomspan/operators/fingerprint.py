r"""Technologies with versions from a caller's rule table, and what they imply.

A rule names a technology and a pattern for one kind of text: ``html``,
``script`` (addresses of scripts), ``url``, or ``header``, ``meta`` and
``cookie`` with the name of one. A pattern may end in tags:
``\;version:\1`` (what the first group held is the version; ``\1?a:b``
gives a where the group matched, else b) and ``\;confidence:50`` (100
without). Patterns of markup and addresses are filed under texts that their
matches need, and one automaton reads each text once (see ``protection``);
others are looked up by name. So a page costs its texts and its hits.

What a technology implies is a table of its own. Its closure is found once by
repeated joins, keeping the surest way between two technologies, and joined
with the detections; cycles end, as confidences don't grow.

Defined results: a technology's confidence is the sum of its rules', 100 at
most; its version is the longest found that is no address and has fewer than
32 characters; patterns without text only need the name to be there; patterns
that cannot be read match nothing; null texts have no marks; the rule table is
sent to every task, so it must fit there (the public ones have some 10 MB).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .pages import _beside
from .protection import _Filed
from .storage import Store

LONGEST_VERSION = 32
#: Implications that are broadcast, at most; more are joined by a shuffle.
BROADCAST_CHAINS = 100_000
TEXTS, NAMED = ("html", "script", "url"), ("header", "meta", "cookie")
RULES = "name string, category string, kind string, field string, pattern string"
IMPLIES = "name string, implied string, confidence int"


def parse_pattern(pattern: str | None) -> tuple[str, str, int]:
    """The expression, the version's template and the confidence of a pattern."""
    expression, *tags = (pattern or "").split(r"\;")
    told = dict(t.split(":", 1) for t in tags if ":" in t)
    points = told.get("confidence", "100")
    return expression, told.get("version", ""), int(points) if points.isdigit() else 100


def version_of(template: str, m: re.Match) -> str:
    def group(n: str) -> str:
        return (m[int(n)] or "") if int(n) <= (m.re.groups or 0) else ""

    out = re.sub(r"\\(\d)\?([^:]*):(.*)$", lambda t: t[2] if group(t[1]) else t[3], template)
    return re.sub(r"\\(\d)", lambda t: group(t[1]), out).strip()


def real_version(version: str) -> bool:
    return bool(version) and "/" not in version and len(version) < LONGEST_VERSION


class Rules:
    def __init__(self, rows: list[tuple[str, str, str, str | None, str | None]]):
        self.rows = [(name, category, *parse_pattern(pattern)) for name, category, _, _, pattern in rows]
        self.named: dict[tuple[str, str], list[int]] = {}
        patterns: dict[str, list] = {k: [] for k in TEXTS}
        self.compiled: dict[int, re.Pattern] = {}
        for i, (_, _, kind, name, _) in enumerate(rows):
            try:
                self.compiled[i] = re.compile(self.rows[i][2], re.I)
            except re.error:
                continue
            if kind in patterns:
                patterns[kind].append((i, f"(?i:{self.rows[i][2]})"))
            elif kind in NAMED:
                self.named.setdefault((kind, (name or "").lower()), []).append(i)
        self.filed = {k: _Filed(v) for k, v in patterns.items()}

    def detect(self, url: str, html: str, headers: dict[str, str], cookies: dict[str, str]) -> list[tuple[str, str, int, str | None]]:
        """name, category, confidence, version, in the order of rules."""
        doc = dom.parse(html)
        scripts = [s.get("src") for s in doc.find("script") if s.get("src")]
        told = [("header", k, v) for k, v in headers.items()] + [("cookie", k, v) for k, v in cookies.items()]
        told += [("meta", m.get("name") or m.get("property"), m.get("content")) for m in doc.find("meta")]
        hits: dict[int, re.Match] = {}
        for kind, text, parts in (("html", html, None), ("url", url, None), ("script", "\n".join(scripts), scripts)):
            for i in self.filed[kind].matching(text, parts):
                hits[i] = next(m for p in (parts if parts is not None else (text,)) if (m := self.compiled[i].search(p)))
        for kind, name, value in told:
            for i in self.named.get((kind, name.lower()), ()):
                if i not in hits and (m := self.compiled[i].search(value or "")):
                    hits[i] = m
        found: dict[str, tuple[str, int, str]] = {}
        for i in sorted(hits):
            name, category, _, template, points = self.rows[i]
            _, before, version = found.get(name, (category, 0, ""))
            new = version_of(template, hits[i]) if template else ""
            found[name] = (found[name][0] if name in found else category, min(100, before + points), new if real_version(new) and len(new) > len(version) else version)
        return [(n, c, k, v or None) for n, (c, k, v) in found.items()]


_FOUND = pa.list_(pa.struct([("name", pa.string()), ("category", pa.string()), ("confidence", pa.int32()), ("version", pa.string())]))


def with_technologies(responses: DataFrame, rules: DataFrame) -> DataFrame:
    """``responses`` (url, html, headers, set_cookies, others) with ``technologies``, by ``rules`` (see ``RULES``)."""
    rows = [tuple(r) for r in rules.select("name", "category", "kind", "field", "pattern").collect()]  # a table of patterns, not of data
    held: list[Rules] = []

    def make(row: dict) -> tuple:
        if not held:  # once in a task
            held.append(Rules(rows))
        cookies = dict((c.split(";")[0].split("=", 1) + [""])[:2] for c in row["set_cookies"] or [] if c)
        found = held[0].detect(row["url"] or "", row["html"] or "", dict(row["headers"] or {}), cookies)
        return ([{"name": n, "category": c, "confidence": k, "version": v} for n, c, k, v in found],)

    return _beside(responses, ["url", "html", "headers", "set_cookies"], [], [("technologies", "array<struct<name: string, category: string, confidence: int, version: string>>", _FOUND)], make)


def implied_closure(implies: DataFrame) -> DataFrame:
    """name, implied, confidence of every chain of ``implies`` (see ``IMPLIES``): the least confidence on its surest way."""
    files = Store(implies.sparkSession, "implies")
    step = files.keep(implies.where("name <> implied").groupBy("name", "implied").agg(F.max("confidence").alias("confidence")), "step")
    known, size, i = step, None, 0
    while True:
        longer = known.join(step.select(F.col("name").alias("implied"), F.col("implied").alias("then"), F.col("confidence").alias("c")), "implied").select("name", F.col("then").alias("implied"), F.least("confidence", "c").alias("confidence"))
        i += 1
        known = files.keep(known.unionByName(longer.where("name <> implied")).groupBy("name", "implied").agg(F.max("confidence").alias("confidence")), f"step{i}")
        now = known.agg(F.count("*"), F.sum("confidence")).head()
        if now == size:
            return known
        size = now


def detect(responses: DataFrame, rules: DataFrame, implies: DataFrame) -> DataFrame:
    """page_id, name, confidence, version and implied (not found by a rule) of every technology of every page."""
    found = with_technologies(responses, rules).select("page_id", F.inline("technologies"))
    own = found.select("page_id", "name", "confidence", "version", F.lit(True).alias("seen"))
    chains = implied_closure(implies)
    chains = F.broadcast(chains) if chains.count() <= BROADCAST_CHAINS else chains
    after = own.join(chains.withColumnRenamed("confidence", "c"), "name").select("page_id", F.col("implied").alias("name"), F.least("confidence", "c").alias("confidence"), F.lit(None).cast("string").alias("version"), F.lit(False).alias("seen"))
    all_rows = own.unionByName(after).groupBy("page_id", "name").agg(F.max("confidence").alias("confidence"), F.max("version").alias("version"), F.bool_or("seen").alias("seen"))
    return all_rows.select("page_id", "name", F.col("confidence").cast("int").alias("confidence"), "version", (~F.col("seen")).alias("implied"))

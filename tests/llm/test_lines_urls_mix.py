"""Line deduplication, URL filters and mixing on small tables."""

import hashlib
import io
import random
import re
import time
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import linededup, mixing, urlfilter
from loomspan.llm.q_urlfilter import RULES
from loomspan.llm.scratch import Scratch


def line_key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows):
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line_key(line)
            if len(k) >= 10 and d is not None:
                held.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held.get(line_key(x), ())) < 2 or d == min(held[line_key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(5)
    pool = ["a repeated line", "A Repeated LINE ", "\tÄ repeated line", "ä repeated line", "short", "", "x" * 3000, "İstanbul is a line", "a line of its own", "10 chars!!", "9 chars!!"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    return rows + [(90, None), (91, ""), (92, "\n\n"), (None, "a repeated line"), (5, "a repeated line\nonly here it stands"), (5, "a repeated line\nonly here it stands"), ((1 << 53) + 1, "a far line here\nshort"), ((1 << 53) + 2, "a far line here"), ((1 << 63) - 1, "a far line here"), (-(1 << 63), "ä repeated line\nx")]


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_line_dedup_is_brute_force(spark, batches):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, h1 string, n_chars long")
    assert sorted((tuple(r) for r in linededup.dedup_report(docs, batches=batches).collect()), key=str) == brute_lines(rows)
    out = linededup.deduplicate_lines(docs, batches=batches)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, len((r.text or "").split("\n")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()), key=str)
    assert [g[2] for g in got] == [w[3] for w in sorted(((d, n - k if n > k else 1, 0, h) for d, n, k, h in brute_lines(rows)), key=lambda x: str((x[0], x[1], x[3])))]


def plan_of(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def test_line_index_takes_batches_in_any_number(spark):
    docs = spark.createDataFrame([(i, f"line number {i % 7} here\nline number {i} alone") for i in range(100)], "doc_id long, text string")
    scratch, dropped = Scratch(spark, "test"), 0
    index = linededup.LineIndex(scratch)
    for k in range(10):
        dropped += index.add(linededup.line_hashes(docs.where(f"doc_id div 10 = {k}")), f"b{k}").count()
    # ten runs of level 0 were compacted three times, and their results once
    assert [len(x) for x in index.levels] == [1, 0, 1]
    with linededup.sorted_buckets(spark):
        plan = plan_of(index.holders(linededup.line_hashes(docs)))
        # the batch is shuffled and sorted; runs are merged as they lie
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and plan.count("Bucketed: true") == 2
        assert "Exchange" not in plan_of(index.compacted(index.runs()))
    assert all(spark.sql(f"describe formatted {t}").where("col_name = 'Location'").head().data_type.removeprefix("file:").startswith(scratch.base.removeprefix("file:")) for t in index.runs())
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]
    assert dropped == sum(r[2] for r in brute_lines([(i, f"line number {i % 7} here\nline number {i} alone") for i in range(100)]))


def test_failed_batches_leave_no_tables(spark, monkeypatch):
    monkeypatch.setattr(linededup.LineIndex, "_push", lambda *a: 1 / 0)
    docs = spark.createDataFrame([(i, f"line number {i % 7} here") for i in range(30)], "doc_id long, text string")
    with pytest.raises(ZeroDivisionError):
        linededup.dropped_lines(docs, Scratch(spark, "test"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_hot_lines(spark):
    rows = [(i, "the hot line of all\n" + (f"pair {i // 2} of lines" if i % 5 else "the hot line of all")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in linededup.dedup_report(docs).collect()), key=str) == brute_lines(rows)


def test_batches_grow_with_the_input():
    assert linededup.batches_for(0) == linededup.BATCHES > linededup.FANOUT and linededup.batches_for(10**12) > linededup.batches_for(10**9) > linededup.BATCHES


def test_no_lines(spark):
    assert linededup.dedup_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_url(url):
    m = re.match(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("broadcast_rules", [urlfilter.BROADCAST_RULES, 0])
def test_url_rules_are_brute_force(spark, monkeypatch, broadcast_rules):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", broadcast_rules)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.www.example.com", "notexample.com", "example.net", "x.net", "com", "net", "example.com:80", "u@example.com", "é.com", "", "a b.com", "www.exa mple.example.com", "a\tb.net", "a\nb.example.com", "x .com ", "a b"]
    tails = ["", "/", "/en", "/en/", "/en/x?y=/es/", "/es/#a", "/fr/a", "?q=/en/", "#/en/", "/en/\nx"]
    urls = [f"{s}://{h}{t}" for s in ("http", "x") for h in hosts for t in tails] + [None, "", "no scheme", "://", "a://b://c/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rule_table(spark, RULES)).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls + urls[:5])}


def test_url_rules_with_patterns(spark):
    rules = urlfilter.rule_table(spark, [("block", "a.b", "/x", r"\?id=\d+$"), ("allow", "a.b", "/"), ("block", "c+d.e", "/")])
    pages = spark.createDataFrame([("http://a.b/x?id=1",), ("http://a.b/x?id=z",), ("http://c+d.e/",), ("http://ccd.e/",)], "url string")
    assert {r.url: r.verdict for r in urlfilter.judge(pages, rules, default="none").collect()} == {"http://a.b/x?id=1": "block", "http://a.b/x?id=z": "allow", "http://c+d.e/": "block", "http://ccd.e/": "none"}
    assert urlfilter.judge(pages.limit(0), rules).collect() == []


def brute_targets(sizes, weights, repeats=3):
    capped, total = {}, sum(sizes.values())
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        goal = {s: left * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = {s: repeats * sizes[s] for s in goal if goal[s] > repeats * sizes[s]}
        if not over:
            return goal | capped
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 3000]) for i in range(9)} | {None: 7}
    order = sorted((s for s in sizes if s), key=str) + [None]
    want = brute_targets({s: n for s, n in sizes.items()}, {s: i % 3 + 1.0 for i, s in enumerate(order)})
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(mixing.cycle_schedules(rows), Scratch(spark, "test")).collect()}
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 20)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None, "a", "a"]), "w " * rng.randrange(40), 1) for i in range(400)] + [(500, "b", None, 1), (501, "b", "", 1), (7, "a", "same words", 2), (7, "a", "same words", 2), (600, "b", "very long text " * 20000, 1)]
    rows += [(None, "c", f"no id {i}", 1) for i in range(60)] + [(8, "c", f"one id {i}", 1) for i in range(60)] + [(9, "a", "x y z", 3)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size and (r.position is None or 0 <= r.position <= 1) for r in got)
    assert all((r.position is not None) >= (r.taken > 0) for r in got)
    assert [r.position for r in got if r.position is not None] == sorted(r.position for r in got if r.position is not None)
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == round(mine[0].target)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan(docs.repartition(7)).collect()), key=str)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = {s: sum(len((r.text or "").split()) for r in mixed.where(F.col("source").eqNullSafe(s)).collect()) for s in ("a", "b", "c", None)}
    target = {r.source: r.target for r in got}
    assert all(abs(words[s] - target[s]) <= (60_000 if s == "b" else 40) for s in words)
    assert mixing.plan(docs.limit(0)).collect() == [] and mixing.mix_documents(docs.limit(0)).collect() == []


def test_mix_of_a_row_that_repeats_often(spark):
    """Each of 30,000 like rows is taken as often as its own place in the source says; extra columns stay with their rows."""
    docs = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("two words").alias("text"), F.col("id").alias("extra"))
    docs = docs.unionByName(spark.createDataFrame([(1, "b", "w " * 20_000, -1)], docs.schema))
    got = mixing.mix_documents(docs).groupBy("source", "extra").count().collect()
    goal = {r.source: r.target for r in mixing.plan(docs).select("source", "target").distinct().collect()}
    mine = [r["count"] for r in got if r.source == "a"]
    assert sum(mine) * 2 == 2 * round(goal["a"] / 2) and max(mine) - min([*mine, *([0] * (30_000 - len(mine)))]) <= 1
    assert len({r.extra for r in got if r.source == "a"}) == len(mine)


def test_positions_follow_the_schedules(spark):
    """Words up to time t are the source's demand until then: rising sources come late, falling ones early."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (1 + i % 3)) for i in range(3000)], "doc_id long, source string, text string")
    got = mixing.plan(docs).collect()
    for s, lean in (("a", 0.5), ("b", -0.5)):
        mine = [r for r in got if r.source == s and r.position is not None]
        for t in (0.25, 0.5, 0.75):
            before = sum(r.size for r in mine if r.position < t)
            assert abs(before - min(mine[0].source_size, mine[0].target * ((1 - lean) * t + lean * t * t))) < 10


def test_schedule_inverts_its_integral(spark):
    knots = [(0.0, 1.0), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0)]
    area = lambda t: np.trapezoid(np.interp(np.linspace(0, t, 20001), *zip(*knots)), np.linspace(0, t, 20001))
    whole = area(1.0)
    rows = spark.createDataFrame([(float(100.0 * area(t) / whole), t) for t in (0.0, 0.1, 0.2, 0.6, 0.9, 1.0)], "x double, t double")
    schedule = F.array(*(F.struct(F.lit(a).alias("t"), F.lit(b).alias("w")) for a, b in knots))
    got = rows.select("t", mixing.position(F.col("x"), F.lit(100.0), F.lit(float(0.125 + 0.75)), schedule).alias("p")).collect()
    assert all(abs(r.p - r.t) < 2e-3 for r in got)


def test_line_dedup_of_many_lines_in_a_document(spark):
    """Two documents of 200,000 lines, of which the second loses all but some; time grows with the lines only."""
    n = 200_000
    lines = [f"a long line number {i}" for i in range(n)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(x if i % 1000 else f"own {x}" for i, x in enumerate(lines)))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.dedup_report(docs, batches=2).collect()}
    kept = hashlib.sha256("\n".join(f"own {x}" for x in lines[::1000]).encode()).hexdigest()
    assert got[2] == (n, n - n // 1000, kept) and got[1][:2] == (n, 0) and time.time() - began < 90

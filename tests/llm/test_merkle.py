"""The Merkle manifest and the places of rows, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm import merkle
from loomspan.llm.places import placed
from loomspan.llm.scratch import Scratch

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree string, digest int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """The root of a list of leaves, and a list of (before, after) for each leaf."""
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p - p % 3
            steps[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
        level, at = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], [p // 3 for p in at]
    return level[0], steps


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h(*map(field, r[:5])), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subtrees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, above = tree([subtrees[s][0] for s in sources])
    out = []
    for s, upper in zip(sources, above):
        for x, steps in zip(sorted(by[s], key=lambda x: x[:3]), subtrees[s][1]):
            out.append((x[3][0], s, x[2], subtrees[s][0], root, tuple(steps + upper)))
    return sorted(out, key=str)


def found(spark, rows, levels, schema=SCHEMA):
    got = merkle.manifest(spark.createDataFrame(rows, schema).repartition(3), levels=levels)
    assert got.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof"]
    checked = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root for r in checked)
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((x.before, x.after) for x in r.proof)) for r in checked), key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_is_plain_trees(spark, levels):
    """One source with most rows, sources of every size around the bucket's, nulls, ties, repeated rows, clashing columns."""
    draw = random.Random(levels)
    rows = [(i, "big", draw.choice(["en", None, "çà"]), i % 7 or None, draw.choice(["", None, "a\nb", "é" * 50, "x" * 3000]), "t", i) for i in range(60)]
    rows += [(i, f"s{n:02d}", "en", n, f"text {i}", None, None) for n in (1, 2, 3, 4, 8, 9, 10) for i in range(n)]
    rows += [(None, "big", None, None, None, "t", 1), (None, None, "en", 1, "\n", "t", 1), (5, None, "en", 2, "other", "", 2), (5, None, "en", 2, "one", "", 2), (7, "é", "en", 1, "twice", "", 1), (7, "é", "en", 1, "twice", "", 1), (-3, "big", "en", 1, "x", "", 1)]
    assert found(spark, rows, levels) == brute(rows)


def test_manifest_of_one_row_one_source_and_none(spark):
    one = [(1, "a", "en", 1, "x", None, None)]
    (r,) = found(spark, one, 2)
    assert r[2] == r[3] == r[4] and r[5] == ()
    several = [(i, "a", "en", 1, "x", None, None) for i in range(28)]
    got = found(spark, several, 2)
    assert got == brute(several) and len({(r[3], r[4]) for r in got}) == 1 and got[0][3] == got[0][4]
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], None, 3, f"line\n{i}" if i % 3 else f"line {i}", None, None) for i in range(40)], SCHEMA)
    given = merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.replace("text", F.lit("\n"), F.lit(""))])
    got = merkle.manifest(docs, carry={"given": given}, levels=1).withColumn("ok", merkle.fold(F.col("given"), F.col("proof")) == F.col("root")).collect()
    assert {r.doc_id for r in got if r.ok} == {i for i in range(40) if i % 3 == 0}


def test_places_of_a_hot_group_and_alike_rows(spark):
    """Groups of 4,000 rows and of one; 2,000 rows alike; nulls first; over many partitions."""
    draw = random.Random(1)
    rows = [("hot", draw.randrange(500)) for _ in range(2000)] + [("hot", 7)] * 2000 + [(f"g{i}", None) for i in range(50)] + [(None, 3), (None, None), (None, 1)]
    frame = spark.createDataFrame(rows, "g string, v int").repartition(5)
    scratch = Scratch(spark, "places")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = placed(scratch.keep(frame, "rows"), ["g"], ["v"], scratch, "placed").collect()
        single = placed(scratch.keep(frame, "rows2"), [], ["g", "v"], scratch, "single").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.place, r.v))
    for g, places in by.items():
        assert [p for p, _ in sorted(places, key=lambda x: x[0])] == list(range(len(places)))
        values = [(v is not None, v or 0) for _, v in sorted(places, key=lambda x: x[0])]
        assert values == sorted(values)
    assert len(got) == len(rows) and sorted(r.place for r in single) == list(range(len(rows)))
    assert placed(scratch.keep(frame.limit(0), "none"), ["g"], ["v"], scratch, "none-placed").collect() == []

"""Nearest neighbours: index and probes against brute force."""

import io
import math
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from loomspan.llm import ann


def found(table, k=20):
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, k=k).collect():
        got.setdefault(r.query_id, {}).setdefault(r["rank"], []).append((r.vec_id, r.score))
    return got


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (920, [0.0] * 24), (940, [float("nan")] * 24), (960, [1.0] * 5), (980, [None] * 24), (None, [1.0] * 24)]
    table = spark.createDataFrame([(*r, 3) for r in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = found(table)
    assert set(got) == set(range(0, 700, 20))
    wide, hits = x.astype(np.float64), 0
    for q, lists in got.items():
        assert sorted(lists) == list(range(1, 21)) and all(len(e) == 1 for e in lists.values())
        mine = [lists[i][0] for i in range(1, 21)]
        scores = wide @ wide[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(700), -np.round(scores, 12)))[:20].tolist()
        assert all(s == math.sumprod(wide[i].tolist(), wide[q].tolist()) for i, s in mine)
        assert mine == sorted(mine, key=lambda e: (-e[1], e[0]))
        hits += len({i for i, _ in mine} & set(want))
    assert hits >= 0.9 * 20 * len(got)
    assert [i for n in range(1, 21) for i, _ in got[120][n]] == [i for i in range(100, 121) if i != 120]
    few = ann.nearest(table.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4 and ann.nearest(table.limit(0), F.col("vec_id") == 0).collect() == []


def test_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(40, x[40].tolist()), (7, x[7].tolist()), (7, x[8].tolist()), (60, x[61].tolist())]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10)
    # the repeated query row has two lists, each of ten different neighbours
    assert sorted(got[40]) == list(range(1, 11)) and all(len(set(e)) == 1 and len(e) == 2 for e in got[40].values())
    assert len({e[0][0] for e in got[40].values()}) == 10 and 40 not in {e[0][0] for e in got[40].values()}
    all_ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = total = 0
    for q, vector in ((i, x[i]) for i in range(0, 300, 20) if i != 60):
        scores = np.where(all_ids == q, -np.inf, v @ vector)
        want = sorted(all_ids[np.argsort(-scores)[:10]].tolist())
        have = sorted(e[0][0] for e in got[q].values())
        hits += sum(min(want.count(i), have.count(i)) for i in set(want))
        total += 10
    assert hits >= 0.9 * total


def test_where_ids_follow_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "FIT_ROWS", 1500)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    for a in range(0, 1200, 300):  # the lowest ids are near copies
        x[a : a + 300] = x[a] + rng.normal(scale=1e-4, size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = found(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    hits = 0
    for q in range(1200, 6000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({e[0][0] for e in got[q].values()} & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 240 and all(len(e) == 20 for e in got.values())


def test_probes_find_every_code_within_the_radius_once():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, (6, ann.BITS // 64), dtype=np.uint64)
    codes = np.repeat(base, 40, 0)
    for row in codes:
        for bit in rng.integers(0, 64, rng.integers(0, 24)):
            row[0] ^= np.uint64(1 << int(bit))
    for width, radius in ((8, 3), (8, 13), (8, 30), (16, 5), (16, 20), (8, 64)):
        reach, radii = ann.thresholds(radius, 64 // width), (radius, *ann.LEVELS[1:])
        pairs = []
        for part in range(64 // width):
            own = codes[:, 0] >> np.uint64(part * width) & np.uint64((1 << width) - 1)
            flips = set(ann._flips(width, reach[part]).tolist()) if reach[part] >= 0 else set()
            for bucket in np.unique(own):
                theirs = np.flatnonzero(own == bucket)
                mine = np.array([i for i in range(0, 240, 7) if int(own[i] ^ bucket) in flips], int)
                if len(mine):
                    i, j = ann.met_in_bucket(part, width, reach, radii, codes[mine], codes[theirs])
                    pairs += zip(mine[i].tolist(), theirs[j].tolist())
        want = {(i, j) for i in range(0, 240, 7) for j in range(240) if np.bitwise_count(codes[i, 0] ^ codes[j, 0]) <= radius}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_widths_follow_rows_and_radius():
    assert ann.best_width(50_000, 30) == 8 and ann.best_width(10**10, 20) == 16
    for parts in (4, 8):
        for radius in range(64):
            assert sum(ann.thresholds(radius, parts)) == radius - parts + 1


def test_plan_has_no_product(spark):
    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 8)))], "vec_id long, embedding array<float>")
    out = io.StringIO()
    with redirect_stdout(out):
        ann.nearest(table, F.col("vec_id") % 20 == 0).explain()
    assert "Cartesian" not in out.getvalue() and "NestedLoop" not in out.getvalue()

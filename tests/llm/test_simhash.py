import hashlib
import math

import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import simhash


def brute_bits(text):
    words = [w for w in text.replace("\t", " ").split()]
    sums = [0] * 64
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        for i in range(64):
            sums[i] += len(w) if h >> i & 1 else -len(w)
    return sum(1 << i for i in range(64) if sums[i] > 0)


def brute(rows, radius=3):
    out = []
    hashes = lambda t: tuple((x ^ 1 << 63) for x in (xxhash.xxh64_intdigest((t or "").encode(), 42), xxhash.xxh64_intdigest((t or "").encode(), 0)))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes(r[1])[0]))
    prints = [brute_bits(t or "") for _, t in rows]
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        a, b, c = brute_bits(text), brute_bits(edit), brute_bits(after)
        like = lambda x, y: (64 - (x ^ y).bit_count()) / 64
        near = sum((a ^ x).bit_count() <= radius for x in prints) - 1 if doc is not None and doc % 100 == 0 else None
        out.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", like(a, b), like(a, c), near))
    return sorted(out, key=str)


TEXTS = ["one two three", "", None, "Öl für alle, überall überall", "a " * 3000, "  leading and trailing  ", "same text here", "same text here", "x", "tab\tand\nline"]


@pytest.mark.parametrize("n", [1, 2, 10, 60])
def test_report_is_brute_force(spark, n):
    rows = [(3 * i, TEXTS[i % len(TEXTS)] if i < 10 else f"{TEXTS[i % 7]} number {i} of words {i * i}") for i in range(n)]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, part string, pos int")
    assert report(docs) == brute(rows)


def report(docs):
    return sorted((tuple(r) for r in simhash.fingerprint_report(docs, F.col("doc_id") % 100 == 0).collect()), key=str)


def test_ids_of_any_kind(spark, monkeypatch):
    """Hashed ids of 63 bits, the ends of the range, nulls, one id for many rows, repeated rows; ranges of few rows."""
    import random

    monkeypatch.setattr(simhash, "RANGE_ROWS", 20)
    rng = random.Random(3)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), f"text {i} of {rng.random()}") for i in range(150)]
    rows += [(-(1 << 63), "the least id"), ((1 << 63) - 1, "the largest id"), (None, "no id"), (None, None)]
    rows += [(700, f"one id, text {i}") for i in range(120)] + [(300, "the same row")] * 3 + [(0, "zero")]
    rows = rng.sample(rows, len(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert report(docs) == brute(rows)
    keys = simhash._keyed(docs).select(*simhash.KEY).distinct()
    from loomspan.llm.scratch import Scratch

    scratch = Scratch(spark, "test")
    simhash.with_previous(keys, scratch)
    assert spark.read.parquet(f"{scratch.base}/ranges").select("part").distinct().count() > 5


def test_keys_grow_with_the_table():
    for n in (10, 10**5, 10**7, 10**9):
        masks = simhash.block_masks(n, 3)
        assert min((m & (1 << 64) - 1).bit_count() for m in masks) >= min(38, math.log2(n) + 3)
    assert len(simhash.block_masks(10**9, 3)) <= 56

def test_empty_table(spark):
    assert simhash.fingerprint_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d")], "doc_id long, text string")
    got = simhash.fingerprint_report(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1


def test_block_tables_find_all_within_radius(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(4)] + [base[0]] * 5
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(i, signed(b)) for i, b in enumerate(prints)], "id long, bits long")
    queries = table.where("id % 3 = 0")
    got = {tuple(r) for r in simhash.near_fingerprints(queries, table, radius=3).collect()}
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(prints) if i % 3 == 0 for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3}
    assert got == want

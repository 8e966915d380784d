import random

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import components, ngramjoin, shingles, tokencounts
from loomspan.llm.scratch import Scratch


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
                if a != b:
                    links.add((i, j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), links, sets


def by_row(rows):
    """The component of each row, in the order of ``rows``."""
    sets, least = [shingle_set(t) for _, t in rows], [d for d, _ in rows]
    near = [[j for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= 80 * len(a | b)] for a in sets]
    while (lower := [min([least[i], *(least[j] for j in js)]) for i, js in enumerate(near)]) != least:
        least = lower
    return least


def corpus(seed, n_base=12, copies=14):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("xyzw")
    common = [word() for _ in range(30)]
    texts = [None, "", " \t", "one", "One", "a b c d", "a b c d e", "A b c d E"]
    for _ in range(n_base):
        base = [word() for _ in range(rng.choice([6, 12, 40, 120]))] + (common if rng.random() < 0.6 else [])
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(2)] = [word()]
            texts.append(" ".join(t))
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed,frequent", [(1, 32), (2, 3)])
def test_components_are_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    monkeypatch.setattr(ngramjoin, "FEW", frequent)
    monkeypatch.setattr(ngramjoin, "PACK", 8)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, doc int")
    got = sorted(tuple(r) for r in ngramjoin.link_components(docs).collect())
    assert got == brute(rows)[0]


def test_all_links_between_classes(spark):
    rows = corpus(4)
    links, named = ngramjoin.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    _, want, sets = brute(rows)
    first = {}
    for (d, _), s in zip(rows, sets):
        first[s] = min(first.get(s, d), d)
    pairs = {tuple(sorted((first[sets[i]], first[sets[j]]))) for i, j in want}
    assert {tuple(r) for r in links.collect()} == pairs
    degree = {d: sum(d in p for p in pairs) for d in first.values()}
    for r in named.collect():
        s = sets[[d for d, _ in rows].index(r.doc_id)]
        assert r.class_id == (first[s] if s else r.doc_id) and r.n_links == (degree[first[s]] if s else 0)


def test_signatures_meet_for_every_similar_pair(monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 3)
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(2, 260))
        universe = np.unique(rng.integers(1, 1 << 63, 4 * n, dtype=np.uint64))
        freq = dict(zip(universe.tolist(), rng.choice([2, 3], len(universe), p=[0.3, 0.7]).tolist()))
        a = rng.choice(universe, n, replace=False)
        drop = int(rng.integers(0, n - ngramjoin.needed(n) + 1))
        b = np.unique(np.concatenate([a[drop:], rng.choice(universe, int(rng.integers(0, drop + 1)))]))
        a = np.unique(a)
        x = len(np.intersect1d(a, b))
        if x * 100 < 80 * (len(a) + len(b) - x):
            continue
        sig = []
        for s in (a, b):
            c = np.array([freq[t] for t in s.tolist()], np.uint8)
            o = np.lexsort((s, c))
            sig.append(ngramjoin.signatures_of(len(s), 0, s[o], c[o])[0])
        assert len(np.intersect1d(*sig))


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (7, None), (8, ""), (9, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = ngramjoin.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "7", "8", "9", "None"]


def overlapping(seed):
    """Rows of two sources whose ids overlap, and a long text without partner under the id of a short one near another document."""
    rng = random.Random(seed)
    rows = [(d % 40, t) for d, t in corpus(seed)]
    long, short = " ".join(f"long{i}" for i in range(104)), [f"w{i}" for i in range(14)]
    rows += [(1005, long), (1005, " ".join(short)), (1003, " ".join(short[:-1]))]
    return rng.sample(rows, len(rows))


def test_rows_that_repeat_an_id_are_judged_one_by_one(spark):
    rows = overlapping(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, links, sets = brute(rows)
    assert (1005, 10, 1003) in want and (1005, 100, 1005) in want
    assert sorted(tuple(r) for r in ngramjoin.link_components(docs).collect()) == want
    found, _ = ngramjoin.similar_classes(docs)
    first = {}
    for (d, _), s in zip(rows, sets):
        first[s] = min(first.get(s, d), d)
    classes = {frozenset((sets[i], sets[j])) for i, j in links}
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(sorted(first[s] for s in pair)) for pair in classes)
    component = {(d, s): c for d, s, c in ((rows[i][0], sets[i], c) for i, c in enumerate(by_row(rows)))}
    kept = {(d, t) for (d, t), s in zip(rows, sets) if not s or component[d, s] == d}
    assert sorted(((r.doc_id, r.text) for r in ngramjoin.keep_one(docs).collect()), key=str) == sorted(kept, key=str)


def test_empty_table(spark):
    assert ngramjoin.link_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_word_hashes_follow_words():
    texts = ["a b  c", "", None, "B\ta\n", "ab", "a", " éa é", "tail", "tail"]
    found = [shingles.word_hashes(raw, offsets, fold=True) for _, _, raw, offsets in shingles.blocks(pa.array(texts))]
    words = np.concatenate([w for w, _ in found]).tolist()
    flat = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(words) == len(flat) and len(set(zip(words, flat))) == len(set(words)) == len(set(flat))
    assert np.concatenate([c for _, c in found]).tolist() == [len((t or "").split()) for t in texts]


def test_shared_tokens_with_hot_tokens(spark):
    rng = random.Random(6)
    rows = [(i, sorted({1} | {rng.randrange(2, 400) for _ in range(rng.randrange(30))})) for i in range(300)]
    df = spark.createDataFrame([(i, bytearray(np.array(t, "<u8").tobytes())) for i, t in rows], "doc long, tokens binary")
    held = {}
    for _, t in rows:
        for x in t:
            held[x] = held.get(x, 0) + 1
    counts = {r.doc: r.n_shared for r in tokencounts.shared_counts(df, 5000).collect()}
    assert counts == {i: sum(held[x] > 1 for x in t) for i, t in rows}
    told = {}
    for r in tokencounts.shared_tokens(df, 5000, 9).collect():
        told[r.doc] = dict(zip(np.frombuffer(r.tokens, "<u8").tolist(), r.counts))
    assert told == {i: {x: min(9, held[x]) for x in t if held[x] > 1} for i, t in rows}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (7, 3), (3, 9), (7, 9), (-4, 130)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "c")
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, **{i: -4 for i in [-4, *range(100, 140)]}, 3: 3, 7: 3, 9: 3}


def template_pages(n, share, seed=3):
    """Pages of one template of 100 words with words of their own, none of them similar to another."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(100)]
    own = round(100 * share)
    return [(i, " ".join(template[:50] + [f"w{rng.randrange(10**9)}" for _ in range(own)] + template[50:])) for i in range(n)]


def test_template_pages_that_do_not_link(spark, monkeypatch):
    """Work stays in proportion: no set is compared with all others."""
    pages = template_pages(5000, 0.16) + [(9000, " ".join(f"z{i}" for i in range(30))), (9001, " ".join(f"z{i}" for i in range(31)))]
    docs = spark.createDataFrame(pages, "doc_id long, text string")
    compared = []
    verify, many = ngramjoin.verify, ngramjoin._many_links
    monkeypatch.setattr(ngramjoin, "verify", lambda pairs, sets: compared.append(pairs.count()) or verify(pairs, sets))
    monkeypatch.setattr(ngramjoin, "_many_links", lambda mixed, sets, group: compared.append(mixed.where(f"members > {ngramjoin.FEW}").count()) or many(mixed, sets, group))
    got = {r.doc_id: r.component_id for r in ngramjoin.link_components(docs).collect()}
    assert got == {i: i for i, _ in pages if i != 9001} | {9001: 9000}
    assert sum(compared) <= 5000


def test_rows_of_hot_classes(spark):
    rows = [(i, "one text that very many rows hold here") for i in range(3000)] + [(5000 + i, f"text {i} of its own kind stands here {i}") for i in range(50)] + [(None, "one text that very many rows hold here"), (7000, None)]
    got = {(r.doc_id, r.component_id) for r in ngramjoin.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(3000)} | {(5000 + i, 5000 + i) for i in range(50)} | {(None, None), (7000, 7000)}


def test_very_long_texts(spark):
    rng = random.Random(5)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-9_000])), (3, " ".join(long[:40_000])), (4, "short text")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: c for d, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1][0] == 119_996

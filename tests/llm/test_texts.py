"""Language identification, quality and repeated passages on small tables."""

import random

import numpy as np
import pytest

from loomspan.llm import langid, quality, repeats, tokencounts

EN, DE, FR = "the quick brown fox jumps over the lazy dog and then runs into the forest with other animals", "der schnelle braune fuchs springt über den faulen hund und läuft dann mit anderen tieren in den wald", "le renard brun rapide saute par dessus le chien paresseux puis court dans la forêt avec des animaux"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и бежит в лес"


def shuffled(text, seed):
    words = text.split()
    random.Random(seed).shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(4 * i + j, shuffled(t, i), lang) for i in range(30) for j, (t, lang) in enumerate(((EN, "en"), (DE, "de"), (FR, "fr"), (RU, "ru")))]
    return langid.fit(spark.createDataFrame(rows + [(900, None, "en"), (901, "text", None)], "doc_id long, text string, lang string"))


def test_language_of_texts(spark, model):
    rows = [(1, EN), (2, DE), (3, FR), (4, RU), (5, None), (6, "12 !?"), (7, ""), (8, f"{EN} {EN} {DE}"), (1, EN), (9, EN * 2000)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double"), model).collect()]
    assert sorted((d, p) for d, p, _ in got) == sorted([(1, "en"), (1, "en"), (2, "de"), (3, "fr"), (4, "ru"), (5, "und"), (6, "und"), (7, "und"), (8, "en"), (9, "en")])
    assert all(0 <= s <= 1 for _, _, s in got) and 0.5 < next(s for d, _, s in got if d == 8) < 0.8


def test_spans_of_mixed_text(spark, model):
    got = langid.spans(spark.createDataFrame([(1, f"{EN} {DE} {RU}")], "doc_id long, text string"), model).orderBy("span").collect()
    assert [r.lang for r in got] == ["en", "de", "ru"] and sum(r.n_words for r in got) == len(f"{EN} {DE} {RU}".split())


def test_viterbi_is_brute_force():
    rng = np.random.default_rng(2)
    lengths = np.array([5, 0, 1, 4, 5])
    starts = np.cumsum(lengths) - lengths
    scores = rng.normal(size=(int(lengths.sum()), 3)) * 3
    labels = langid.viterbi(scores.astype(np.float32), np.arange(len(scores)), starts, lengths, 2.0)
    for s, n in zip(starts, lengths):
        best = max((sum(scores[s + i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:])) for path in np.ndindex(*[3] * n)), default=0)
        path = labels[s : s + n]
        assert abs(best - (sum(scores[s + i, p] for i, p in enumerate(path)) - 2.0 * (np.diff(path) != 0).sum())) < 1e-4


def test_three_hundred_languages(spark):
    labels = langid.viterbi(np.eye(300, dtype=np.float32)[[0, 299, 150, 128]] * 9, np.arange(4), np.array([0]), np.array([4]), 1.0)
    assert labels.tolist() == [0, 299, 150, 128]
    rng = random.Random(3)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(12)] for i in range(300)}
    rows = [(i, " ".join(w), lang) for i, (lang, w) in enumerate(words.items())]
    rows += [(1000 + i, EN, "l999") for i in range(200)]  # a frequent language takes nothing from the others' models
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = langid.fit(table, model_grams=120)
    assert len(many.langs) == 301
    want = {i: lang for i, _, lang in rows}
    assert {r.doc_id: r.lang_pred for r in langid.predict(table, many).collect()} == want
    assert {r.doc_id: r.lang for r in langid.spans(table, many).collect()} == want


def test_words_are_letters_with_their_marks(spark, model):
    assert langid.words("½ ² Ⅷ 12 _") == [] and langid.words("Straße, naïve e\u0301te") == ["straße", "naïve", "e\u0301te"]
    assert langid.words("हिन्दी में") == ["हिन्दी", "में"] and langid.words("中文 かな") == ["中", "文", "か", "な"]
    docs = spark.createDataFrame([(1, "½ ²"), (2, "\u0301"), (3, "Ⅷ")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()} == {("und", 0.0)}


def brute_language(train, text):
    """The whole prediction in plain Python: counts, scores and the best path over all languages."""
    import math
    from collections import Counter

    tally, written = {}, {}
    for t, lang in train:
        for w in langid.words(t):
            tally.setdefault(lang, Counter()).update([f" {w} ", *(f" {w} "[i : i + 3] for i in range(len(w)))])
            written.setdefault(lang, Counter())[langid.script(w[0])] += 1
    langs, every = sorted(tally), {g for c in tally.values() for g in c}
    weight = {x: sum(tally[x].values()) + 0.5 * (len(every) + 1) for x in langs}

    def scores(w):
        may = [x for x in langs if written[x][langid.script(w[0])] > 0.001 * sum(written[x].values())]
        if not may:
            return dict.fromkeys(langs, 0.0)
        pieces = [f" {w} ", *(f" {w} "[i : i + 3] for i in range(len(w)))]
        raw = {x: sum(math.log((tally[x][g] + 0.5) / weight[x]) for g in pieces) / math.sqrt(len(w)) for x in may}
        return {x: max(raw[x] - max(raw.values()), -langid.WORD_LIMIT) if x in raw else -langid.WORD_LIMIT for x in langs}

    best = None
    for w in langid.words(text):
        s = scores(w)
        if best is None:
            best = {x: (s[x], [x]) for x in langs}
            continue
        best = {x: max(((v + s[x] - (langid.SWITCH_PENALTY if x != y else 0), path + [x]) for y, (v, path) in best.items()), key=lambda p: p[0]) for x in langs}
    if best is None:
        return "und", 0.0
    path = max(best.values(), key=lambda p: p[0])[1]
    letters = Counter()
    for w, x in zip(langid.words(text), path):
        letters[x] += len(w)
    top = max(langs, key=lambda x: (letters[x], [-ord(c) for c in x]))
    return top, letters[top] / sum(letters.values())


def test_whole_prediction_is_brute_force(spark):
    rng = random.Random(12)
    train = [(shuffled(t, i)[: rng.randrange(20, 90)], lang) for i in range(8) for t, lang in ((EN, "en"), (DE, "de"), (FR, "fr"), (RU, "ru"))]
    m = langid.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, text string, lang string"))
    texts = [" ".join(shuffled(t, i)[: rng.randrange(60)] for t in rng.sample([EN, DE, FR, RU, "12 ½", "ελληνικά"], rng.randrange(4))) for i in range(60)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for i, t in enumerate(texts):
        want = brute_language(train, t)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-9, t


def test_held_out_accuracy(spark):
    """Of the test tables: languages and quality of rows that were not learned from."""
    from loomspan.llm.q_langid import op3_language_id
    from loomspan.llm.q_quality import op8_quality_crf

    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    said = [(docs[r.doc_id], r.lang_pred) for r in op3_language_id(spark, folder).where("held_out").collect() if docs[r.doc_id] is not None]
    assert len(said) > 100 and sum(a == b for a, b in said) >= 0.97 * len(said)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.predicted) for r in op8_quality_crf(spark, folder).where("held_out").collect() if r.doc_id in labels]
    assert len(judged) > 50 and sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_no_training_rows(spark):
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(3)
    counts = np.array([3, 1, 4])
    unary, step = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, z = quality.forward_backward(unary, step, counts)
    at, logz, want_pairs = 0, [], np.zeros((2, 2))
    for n in counts:
        paths = list(np.ndindex(*[2] * n))
        w = np.array([np.exp(sum(unary[at + i] * p for i, p in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        for i in range(n):
            assert abs(good[at + i] - w[[p[i] == 1 for p in paths]].sum() / w.sum()) < 1e-9
        for path, x in zip(paths, w / w.sum()):
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += x
        logz.append(np.log(w.sum()))
        at += n
    assert np.allclose(pairs, want_pairs) and np.allclose(sorted(z), sorted(logz))


def test_quality_learns_and_keeps(spark):
    rows = [(i, f"A plain sentence, number {i}, of some words.\nAnother one follows it here." if i % 2 else f"JUNK!!!! {i} |||| $$$$ %%%%\n#### @@@@ &&&& {i}") for i in range(80)] + [(100, None), (101, ""), (1, rowtext := "x " * 4000)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(70, 0), (70, 1), (None, 1)], "doc_id long, quality int")
    m = quality.fit(docs.where("doc_id <> 1"), labels)
    got = {(r.doc_id, r.predicted) for r in quality.score(docs, m).collect() if r.doc_id in range(60, 80)}
    assert got == {(i, i % 2) for i in range(60, 80)}
    scores = quality.score(docs, m).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores) and len(rowtext) == 8000
    kept = quality.keep_good(docs, m)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {61, 63, 65}
    assert quality.keep_good(docs.where("1 = 0"), m).collect() == []


def test_quality_of_long_and_repeated_texts(spark):
    """Long documents are learned from in part; equal texts have equal scores; the whole score is brute force."""
    good, bad = "A plain sentence of some words stands here.", "#### @@@@ |||| $$$$ %%%% &&&&"
    rows = [(i, "\n".join([(good, bad)[i % 2]] * (900 + i))) for i in range(12)] + [(50 + i, "\n".join([good, bad, good][: 1 + i % 3])) for i in range(9)]
    docs = spark.createDataFrame(rows + rows[:4], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(12)], "doc_id long, quality int")
    m = quality.fit(docs, labels, doc_lines=50, train_lines=700)
    got = {}
    for r in quality.score(docs, m).collect():
        got.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in got.values()) and len(got) == 21
    assert all((s > 0.5) == (i % 2 == 0) for i in range(12) for s in got[i])
    for i, text in rows[12:]:
        x, size, counts = quality.line_features([text])
        unary = quality.with_neighbours(x, counts) @ m.weights
        paths = list(np.ndindex(*[2] * len(size)))
        w = np.array([np.exp(sum(unary[k] * p for k, p in enumerate(path)) + sum(m.step[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        share = sum(w[j] / w.sum() * sum(s * p for s, p in zip(size, path)) for j, path in enumerate(paths)) / size.sum()
        assert abs(share - next(iter(got[i]))) < 1e-9
    assert quality.score(docs.limit(0), m).collect() == []


def test_quality_scores_do_not_depend_on_the_batch():
    """A text alone, first, last and after every other text has one score, to the last bit."""
    texts = ["", None, "x\nA line.", "A line.\nother words here", "A line.", "\n\n", "#### |||| @@@@\n#### |||| @@@@", "word " * 3000, "Ein Satz.\n" * 40, "A line.\nA line.\nA line."]
    draw = np.random.default_rng(3)
    m = quality.Model(draw.normal(size=3 * len(quality.FEATURES)) / 3, draw.normal(size=(2, 2)), 0.5)
    alone = [m.score([t])[0] for t in texts]
    assert quality.line_features(["x\nA line.", "A line.\nA line."])[0][:, quality.FEATURES.index("same_as_before")].tolist() == [0, 0, 0, 1]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert m.score([a, b]).tolist() == [alone[i], alone[j]]
        assert m.score([a, *texts])[0] == alone[i] and m.score([*texts, a])[-1] == alone[i]
        assert np.array_equal(m.score(texts[i:] + texts[:i]), alone[i:] + alone[:i])


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    m = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(docs, m).collect()[0].score == 0.5


def brute_passages(rows, size=50):
    holders, words = {}, {}
    for k, (d, t) in enumerate(rows):
        words[k] = (t or "").encode().lower().split()
        for i in range(len(words[k]) - size + 1):
            holders.setdefault(tuple(words[k][i : i + size]), set()).add((d, t))
    out = []
    for k, (d, _) in enumerate(rows):
        w = words[k]
        cover = sorted({j for i in range(len(w) - size + 1) if len(holders[tuple(w[i : i + size])]) > 1 for j in range(i, i + size)})
        runs = [[j] for j in cover[:1]]
        for a, b in zip(cover, cover[1:]):
            if b > a + 1:
                runs[-1].append(a)
                runs.append([b])
        out += [(d, r[0], (r[1] if len(r) > 1 else cover[-1]) + 1) for r in runs]
    return sorted(out, key=str)


def test_repeated_passages_are_brute_force(spark):
    rng = random.Random(9)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = [make(50), make(51), make(49), make(200), ["same"] * 120]
    rows = [(1, None), (2, ""), (3, "short")]
    for i in range(4, 40):
        t = make(rng.randrange(120))
        for p in rng.sample(shared, rng.randrange(3)):
            k = rng.randrange(len(t) + 1)
            t[k:k] = p
        rows.append((i, " ".join(t) + rng.choice(["", "\n"])))
    rows += [(50, rows[10][1]), (50, rows[10][1]), (60, " ".join(make(90) * 2).upper())]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, places int")
    found = repeats.repeated_passages(docs).collect()
    assert sorted((tuple(r)[:3] for r in found), key=str) == brute_passages(rows)
    words = {}
    for d, t in rows:
        words.setdefault(d, []).append((t or "").lower().split())
    near, links = {}, {}
    for r in found:
        assert r.partners[0].at_word == r.start_word
        for a, b in zip(r.partners, [*(p.at_word for p in r.partners[1:]), None]):
            end = min(b, r.end_word) if b is not None else a.at_word + 50
            end = max(end, a.at_word + 50)
            mine, theirs = words[r.doc_id], words[a.partner_id]
            assert any(x[a.at_word : end][:50] == y[a.partner_start : a.partner_start + 50] for x in mine for y in theirs)
            links.setdefault(r.doc_id, set()).add(a.partner_id)
            links.setdefault(a.partner_id, set()).add(r.doc_id)
    grams = {}
    for d, texts in words.items():
        for w in texts:
            for i in range(len(w) - 49):
                grams.setdefault(tuple(w[i : i + 50]), set()).add(d)
    for held in grams.values():
        for d in held:
            near.setdefault(d, set()).update(held)
    reach = lambda graph, d: next(s for s in [{d}] for _ in range(60) if not s.update(*(graph.get(x, ()) for x in list(s))) and _ == 59)
    assert {d: reach(links, d) for d in links} == {d: reach(near, d) for d in links}


def test_partners_where_many_hold_a_passage(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "BUCKET_ENTRIES", 50)
    monkeypatch.setattr("loomspan.llm.scratch.ARROW_ROWS", 7)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"own{i} " * (i % 3) + passage + f" tail{i}") for i in range(90)] + [(500, " ".join(f"x{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = repeats.repeated_passages(docs).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in found) == [(i, i % 3, i % 3 + 80) for i in range(90)]
    graph = {}
    for r in found:
        for p in r.partners:
            assert p.partner_id != r.doc_id and p.partner_start == p.at_word - r.doc_id % 3 + p.partner_id % 3
            graph.setdefault(r.doc_id, set()).add(p.partner_id)
            graph.setdefault(p.partner_id, set()).add(r.doc_id)
    seen = {0}
    for _ in range(90):
        seen |= {y for x in seen for y in graph[x]}
    assert len(seen) == 90


def test_tasks_grow_slower_than_buckets():
    assert tokencounts.tasks_for(40, 8) == 40 and tokencounts.tasks_for(10**6, 200) == 8000 and tokencounts.tasks_for(2, 200) == 200


def test_no_passages(spark):
    assert repeats.repeated_passages(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect() == []
    assert repeats.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []

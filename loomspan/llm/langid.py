"""Language identification of mixed-language text.

A word's script narrows the languages it may be in; within them a character
n-gram model scores the word; Viterbi over those scores, with a penalty for
every switch of language, labels the words of a text, and runs of one label
are its spans. The prediction for a whole text is the language that holds most
letters.

Words are runs of letters (Unicode category L) with the marks that follow
them. Scores are computed for the languages of a word's script alone.

Fitting counts n-grams over a sample of labelled rows, about ``train_rows``
for each language (all rows where there are fewer), chosen by a hash; the
model keeps all languages and all n-grams of the sample. It is sparse: its
size is that of these n-grams, some 75,000 for a language.

Defined results: a null text, or one without a letter, has the label ``und``
with score 0; rows that repeat a doc_id each give their row; an empty training
set labels everything ``und``; ties between languages go to the first by code
point; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, ready_for_python
from .shingles import tidy

#: Labelled rows of a language that are learned from, about (``fit(train_rows=...)``).
TRAIN_ROWS = 1_500
SWITCH_PENALTY = 6.0
#: A single word moves the balance between two languages by no more than this.
WORD_LIMIT = 4.0
SMOOTH = 0.5
UNKNOWN = "und"
#: Rows (languages) of a table that is broadcast.
BROADCAST_LANGS = 100_000
#: Scores of words and languages that a worker keeps, and that are computed at once.
CACHED, AT_ONCE = 20_000_000, 4_000_000
#: First code points of the ranges of scripts, in ascending order (fixed values).
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
_FIRST = [a for a, _ in SCRIPT_STARTS]
_ASCII_WORD = re.compile(r"[a-z]+")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def script(char: str) -> str:
    return SCRIPT_STARTS[bisect_right(_FIRST, ord(char)) - 1][1]


def words(text: str) -> list[str]:
    """Runs of letters and their marks, in lower case; letters of Han and Kana stand alone."""
    low = text.lower()
    if low.isascii():
        return _ASCII_WORD.findall(low)
    found = _WORD.findall(low)
    if max(low) < "\u3040":
        return found
    out = []
    for w in found:
        if max(w) >= "\u3040" and any(script(c) in ("Han", "Kana") for c in w):
            out.extend(c for c in w if c.isalpha())
        else:
            out.append(w)
    return out


def grams(word: str) -> list[str]:
    """The word between blanks, and the triples of that."""
    w = f" {word} "
    return [w, *[w[i : i + 3] for i in range(len(word))]]


@dataclass
class Model:
    """Row g of the sparse table, ``starts[g]`` to ``starts[g + 1]``, holds what n-gram g adds to ``floor`` for languages ``cols``."""

    langs: list[str]
    scripts: dict[str, np.ndarray]
    index: dict[str, int]
    starts: np.ndarray
    cols: np.ndarray
    gain: np.ndarray
    floor: np.ndarray
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "scores": None}

    def word_scores(self, new: list[str]) -> np.ndarray:
        """Log-likelihoods of the languages of each word relative to the best one of its script, at least -WORD_LIMIT."""
        out = np.full((len(new), len(self.langs)), -WORD_LIMIT, np.float32)
        by_script: dict[str, list[int]] = {}
        for i, w in enumerate(new):
            by_script.setdefault(script(w[0]), []).append(i)
        for name, rows in by_script.items():
            langs = self.scripts.get(name)
            if langs is None or not len(langs):
                out[rows] = 0  # no language is written in it: the word says nothing
                continue
            out[np.ix_(rows, langs)] = self._script_scores([new[i] for i in rows], langs)
        return out

    def _script_scores(self, new: list[str], langs: np.ndarray) -> np.ndarray:
        column = np.full(len(self.langs), -1, np.int64)
        column[langs] = np.arange(len(langs))
        get = self.index.get
        at = np.array([get(g, -1) for w in new for g in grams(w)], np.int64)
        size = np.fromiter(map(len, new), np.int64, len(new))
        word = np.repeat(np.arange(len(new)), size + 1)[at >= 0]
        at = at[at >= 0]
        run = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(run) + run, run) + np.arange(run.sum())
        col, word = column[self.cols[entry]], np.repeat(word, run)
        here = col >= 0
        total = np.bincount(word[here] * len(langs) + col[here], self.gain[entry][here], len(new) * len(langs)).reshape(len(new), -1)
        total += self.floor[langs] * (size + 1)[:, None]
        total /= np.sqrt(size)[:, None]  # triples overlap: long words hold more evidence, but not in proportion
        return np.maximum(total - total.max(1, keepdims=True), -WORD_LIMIT)

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Row numbers of the words' scores in ``scores``."""
        if self.scores is None or len(self.cache) * len(self.langs) > CACHED:
            self.cache, self.scores = {}, np.zeros((1024, len(self.langs)), np.float32)
        cache = self.cache
        new = list(set(tokens) - cache.keys())
        step = max(1, AT_ONCE // max(1, len(self.langs)))
        for i in range(0, len(new), step):
            some = new[i : i + step]
            end = len(cache) + len(some)
            while end > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[len(cache) : end] = self.word_scores(some)
            cache.update(zip(some, range(len(cache), end)))
        return np.fromiter(map(cache.__getitem__, tokens), np.int32, len(tokens))


def viterbi(scores: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of many texts at once; word j has the row rows[j] of ``scores``, text i the words starts[i] .. starts[i] + lengths[i].

    All texts advance together, longest first, so that each step is one array
    operation over the texts that still have words. A label is kept or left
    for the best one: what is stored of a step is one bit for each language
    and the best one.
    """
    labels = np.zeros(len(rows), np.int32)
    order = np.argsort(-lengths, kind="stable")
    first, n = starts[order], lengths[order]
    live = int((n > 0).sum())
    if not live:
        return labels
    first, n = first[:live], n[:live]
    steps = int(n[0])
    counts = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more than t words
    state = scores[rows[first]]
    stayed: list[np.ndarray] = []
    came: list[np.ndarray] = []
    for t in range(1, steps):
        k = counts[t]
        prev = state[:k]
        best = prev.argmax(1)
        jump = prev[np.arange(k), best][:, None] - np.float32(penalty)
        stayed.append(np.packbits(prev >= jump, axis=1))
        came.append(best.astype(np.int32))
        prev = np.maximum(prev, jump)
        # Only differences count; so a long text's sums keep their precision.
        state[:k] = prev - prev.max(1, keepdims=True) + scores[rows[first[:k] + t]]
    label = state.argmax(1)
    for t in range(steps - 1, -1, -1):
        k = counts[t]
        mine = label[:k]
        labels[first[:k] + t] = mine
        if t:
            bit = stayed[t - 1][np.arange(k), mine >> 3] >> (7 - (mine & 7)).astype(np.uint8) & 1
            label[:k] = np.where(bit == 1, mine, came[t - 1])
    return labels


def fit(docs: DataFrame, *, train_rows: int = TRAIN_ROWS, model_grams: int | None = None) -> Model:
    """Learn from ``docs`` (doc_id, text, lang); rows with a null are left out.

    All n-grams of the sample are kept; ``model_grams`` keeps so many of each
    language's most frequent ones, for a smaller model.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    known = docs.where("text is not null and lang is not null")
    share = known.groupBy(F.col("lang").alias("__lang")).agg((F.lit(float(train_rows)) / F.count("*")).alias("__share"))
    share = Scratch(spark, "langid").keep(share, "shares")
    if share.count() <= BROADCAST_LANGS:
        share = F.broadcast(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / F.lit(1e6)
    sample = known.withColumn("__draw", draw).join(share, F.col("lang") == F.col("__lang")).where("__draw < __share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(words(text))
            out: dict[tuple[str, str], int] = Counter()
            for lang, bag in seen.items():
                for w, k in bag.items():
                    out[lang, "\x00" + script(w[0])] += k
                    for g in grams(w):
                        out[lang, g] += k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], ["lang", "gram", "n"])

    counts = sample.mapInArrow(tidy(count), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    of_script = F.col("gram").startswith("\x00")
    if model_grams is not None:
        place = F.row_number().over(Window.partitionBy("lang", of_script).orderBy(F.col("n").desc(), "gram"))
        counts = counts.withColumn("place", place).where(F.col("place") <= model_grams)
    kept = counts.select("lang", "gram", "n").toArrow()  # of about train_rows texts for each language
    names = kept.column("lang").to_pylist()
    langs = sorted(set(names))
    at = {x: i for i, x in enumerate(langs)}
    index: dict[str, int] = {}
    by_script: dict[str, np.ndarray] = {}
    row, col, seen = [], [], []
    for lang, gram, n in zip(names, kept.column("gram").to_pylist(), kept.column("n").to_pylist()):
        if gram[0] == "\x00":
            by_script.setdefault(gram[1:], np.zeros(len(langs)))[at[lang]] = n
        else:
            row.append(index.setdefault(gram, len(index)))
            col.append(at[lang])
            seen.append(n)
    rows, cols, n = np.array(row, np.int64), np.array(col, np.int32), np.array(seen, np.float64)
    order = np.lexsort((cols, rows))
    rows, cols, n = rows[order], cols[order], n[order]
    weight = np.bincount(cols, n, len(langs)) + SMOOTH * (len(index) + 1)
    every = sum(by_script.values()) if by_script else np.zeros(len(langs))
    scripts = {s: np.flatnonzero(v > 0.001 * every) for s, v in by_script.items()}
    return Model(langs, scripts, index, np.searchsorted(rows, np.arange(len(index) + 1)), cols, np.log((n + SMOOTH) / SMOOTH).astype(np.float32), np.log(SMOOTH / weight))


def label_texts(model: Model, texts: list[str | None], penalty: float) -> Iterator[tuple[list[str], np.ndarray]]:
    """The words of each text and their labels."""
    tokens = [words(t) if t else [] for t in texts]
    lengths = np.array([len(x) for x in tokens], np.int64)
    starts = np.cumsum(lengths) - lengths
    rows = model.rows([w for x in tokens for w in x])
    labels = viterbi(model.scores, rows, starts, lengths, penalty)
    for x, a in zip(tokens, starts):
        yield x, labels[a : a + len(x)]


def _predict(model: Model, tokens: list[str], labels: np.ndarray) -> tuple[str, float]:
    if not tokens or not model.langs:
        return UNKNOWN, 0.0
    letters = np.bincount(labels, weights=np.fromiter(map(len, tokens), np.float64, len(tokens)), minlength=len(model.langs))
    best = int(letters.argmax())
    return model.langs[best], float(letters[best] / letters.sum())


def predict(docs: DataFrame, model: Model, *carry: Column, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Returns doc_id, then ``carry`` columns, lang_pred and score (the share of letters in that language)."""
    ready_for_python(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *carry, F.col("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of about train_rows texts for each language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            made = [_predict(m, x, y) for x, y in label_texts(m, b.column(b.num_columns - 1).to_pylist(), penalty)] if m.langs else [(UNKNOWN, 0.0)] * b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())], names)

    names = [*rows.columns[:-1], "lang_pred", "score"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(label), f"{kinds}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, *, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Runs of one language: doc_id, span, first_word, n_words, lang, words counted from 0 (see ``words``)."""
    ready_for_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for doc, (_, y) in zip(b.column(0).to_pylist(), label_texts(m, b.column(1).to_pylist(), penalty) if m.langs else ()):
                edges = [0, *(np.flatnonzero(np.diff(y)) + 1), len(y)] if len(y) else [0]
                out += [(doc, i, int(p), int(q - p), m.langs[y[p]]) for i, (p, q) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "span", "first_word", "n_words", "lang"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(label), "doc_id bigint, span int, first_word int, n_words int, lang string")

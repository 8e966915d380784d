"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's unary score is linear in its own
features and those of the lines before and after it; a 2 x 2 matrix scores the
step from one line to the next. Forward-backward gives each line's probability
of being good, and their mean weighted by length is the score of the document.

Fitting takes a sample of the labelled rows: about ``train_docs`` documents
chosen by a hash, of each at most ``doc_lines`` lines in a row (from a place
that a hash of the text chooses), and of these documents, in the hash's order,
as many as have ``train_lines`` lines together. All lines of a document carry
its label. Everything else is done on every row.

Defined results: a null or empty text is one empty line and gets a score like
any other; rows that repeat a doc_id each give their row; with no labels, or
labels of one class only, the score is the smoothed share of good labels;
labels that contradict each other for a doc_id are left out; extra columns are
ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, ready_for_python
from .shingles import tidy

#: Bounds of the sample (parameters of ``fit``): documents, lines in all, lines of one document.
TRAIN_DOCS = 4_000
TRAIN_LINES = 200_000
DOC_LINES = 400
STEPS = 250
RIDGE = 1e-3

LOWER, UPPER, OTHER_LETTER, DIGIT, SPACE, STOP, MARK, SYMBOL = range(8)
FEATURES = (
    "bias", "log_chars", "log_words", "word_chars", "letters", "upper", "digits", "stops", "marks", "symbols", "doubled_marks", "distinct", "same_as_before",
    "ends_in_stop", "no_letters", "any_doubled", "mostly_upper", "few_distinct", "short", "marks_per_word", "symbols_per_word", "doubled_per_word", "stops_per_word",
    "stutter", "any_stutter", "much_stutter", "any_symbol", "some_symbols",
)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point."""
    global _classes
    if _classes is None:
        by = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE, "Cc": SPACE}
        table = np.full(sys.maxunicode + 1, SYMBOL, np.uint8)
        for c in range(0x3100):
            kind = unicodedata.category(chr(c))
            table[c] = by.get(kind, OTHER_LETTER if kind[0] in "LM" else MARK if kind[0] == "P" else SYMBOL)
        table[0x3100:0xE000] = OTHER_LETTER
        table[0x20000:0x32400] = OTHER_LETTER
        for c in ".,;:?'\"()-":
            table[ord(c)] = STOP
        _classes = table
    return _classes


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, each line's weight (characters + 1), and the number of lines of each text."""
    per_text = [(t or "").split("\n") for t in texts]
    counts = np.array([len(x) for x in per_text], np.int64)
    lines = [y for x in per_text for y in x]
    n = len(lines)
    points = np.frombuffer("".join(f"{y}\n" for y in lines).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, lines), np.int64, n)
    at = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    kind = classes()[points]
    total = lambda mask: np.add.reduceat(mask.astype(np.int32), at) if n else np.zeros(0)
    space = kind == SPACE
    space_before = np.concatenate([[True], space[:-1]])
    mark = (kind == MARK) | (kind == SYMBOL)
    doubled = np.zeros(len(points), bool)
    doubled[1:] = (points[1:] == points[:-1]) & mark[1:]
    lower, upper, other = total(kind == LOWER), total(kind == UPPER), total(kind == OTHER_LETTER)
    digits, stops, marks, symbols, twice = total(kind == DIGIT), total(kind == STOP), total(kind == MARK), total(kind == SYMBOL), total(doubled)
    words = total(~space & space_before)
    tokens = [y.split() for y in lines]
    distinct = np.fromiter((len(set(y)) for y in tokens), np.float64, n)
    stutter = np.fromiter((sum(map(eq, y, y[1:])) for y in tokens), np.float64, n)
    same = np.fromiter((a == b for a, b in zip(lines, ["", *lines])), np.float64, n) if n else np.zeros(0)
    same[np.cumsum(counts) - counts] = 0  # a text's first line has none before it
    letters = lower + upper + other
    chars, w = np.maximum(size, 1), np.maximum(words, 1)
    last = np.where(size > 0, kind[at + np.maximum(size - 1, 0)], SPACE)
    columns = [
        np.ones(n), np.log1p(size) / 5, np.log1p(words) / 4, np.minimum(letters / w, 20) / 10, letters / chars, upper / np.maximum(letters, 1), digits / chars, stops / chars,
        marks / chars, symbols / chars, twice / chars, np.where(words > 0, distinct / w, 1.0), same, last == STOP, (letters == 0) & (size > 0), twice > 0, upper > 0.5 * np.maximum(letters, 1),
        (words > 5) & (distinct < 0.3 * w), size < 20, np.minimum(marks / w, 3), np.minimum(symbols / w, 3), np.minimum(twice / w, 3), np.minimum(stops / w, 3),
        stutter / w, stutter > 0, stutter > 0.2 * w, symbols > 0, symbols > 0.1 * w,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1) if n else np.zeros((0, len(FEATURES))), (size + 1).astype(np.float64), counts


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Append the features of the line before and of the line after (zeros at the ends of a text)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(counts)
    before[(ends - counts)[counts > 0]] = 0
    after[(ends - 1)[counts > 0]] = 0
    return np.concatenate([x, before, after], 1)


def _lengths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling length: their first rows, and how many have more than t lines."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    n = counts[order]
    return first, n, np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")


def _add(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(a.take(0, axis), a.take(1, axis))


def forward_backward(unary: np.ndarray, step: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, expected steps (2 x 2, summed), log Z of every text in the order of ``_lengths``.

    ``unary``: score of good over bad; all texts advance together, longest first.
    """
    first, n, live = _lengths(counts)
    scores = np.stack([np.zeros_like(unary), unary], 1)
    a, b = np.zeros_like(scores), np.zeros_like(scores)
    for t, k in enumerate(live):
        at = first[:k] + t
        a[at] = scores[at] + (_add(a[at - 1][:, :, None] + step, 1) if t else 0)
    for t in range(len(live) - 2, -1, -1):
        at = first[: live[t + 1]] + t
        b[at] = _add(step[None] + (scores[at + 1] + b[at + 1])[:, None, :], 2)
    z = np.logaddexp(a[first + n - 1, 0], a[first + n - 1, 1]) if len(n) else np.zeros(0)
    of = np.zeros(len(unary))
    pairs = np.zeros((2, 2))
    for t, k in enumerate(live):
        of[first[:k] + t] = z[:k]
        if t:
            at = first[:k] + t
            pairs += np.exp(a[at - 1][:, :, None] + step + (scores[at] + b[at])[:, None, :] - z[:k, None, None]).sum(0)
    return np.exp(np.minimum(a[:, 1] + b[:, 1] - of, 0)), pairs, z


@dataclass
class Model:
    weights: np.ndarray
    step: np.ndarray
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, size, counts = line_features(texts)
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        # einsum sums each row alike, wherever it stands in a batch; a matrix product need not.
        good, _, _ = forward_backward(np.einsum("ij,j->i", with_neighbours(x, counts), self.weights), self.step, counts)
        if not len(good):
            return np.zeros(0)
        at = np.cumsum(counts) - counts
        return np.clip(np.add.reduceat(good * size, at) / np.add.reduceat(size, at), 0.0, 1.0)


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
    """Maximum likelihood with a ridge, by Adam; ``labels`` (0 or 1) are of texts, ``counts`` their numbers of lines."""
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(0), np.zeros((2, 2)), float(prior))
    full = with_neighbours(x, counts)
    line_labels = np.repeat(labels, counts)
    seen = np.zeros((2, 2))
    for v in (0, 1):
        seen[v, v] = (counts[labels == v] - 1).clip(0).sum()
    theta = np.zeros(full.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, STEPS + 1):
        good, pairs, _ = forward_backward(full @ theta[:-4], theta[-4:].reshape(2, 2), counts)
        grad = np.concatenate([full.T @ (line_labels - good), (seen - pairs).ravel()]) / len(line_labels) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2), float(prior))


def fit(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES, doc_lines: int = DOC_LINES) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    ready_for_python(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    n = known.count()
    key = F.xxhash64("doc_id", F.lit(8))
    draw = F.pmod(key, F.lit(1_000_000)) / F.lit(1e6)
    sample = known.where(draw < F.lit(train_docs / max(n, 1))).select(F.col("doc_id").alias("__doc"), "q", key.alias("key"))
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__doc")).select("q", "key", F.xxhash64("text").alias("tie"), "text")  # about train_docs rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, counts = line_features(b.column(3).to_pylist())
            first = np.cumsum(counts) - counts
            taken = np.minimum(counts, doc_lines)
            first += (np.asarray(b.column(2)) & 0x7FFFFFFF) % (counts - taken + 1)
            packed = [x[i : i + k].astype("<f4").tobytes() for i, k in zip(first.tolist(), taken.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(taken, pa.int64()), pa.array(packed, pa.binary())], ["q", "key", "tie", "lines", "x"])

    made = Scratch(docs.sparkSession, "quality").keep(rows.mapInArrow(tidy(features), "q int, key bigint, tie bigint, lines bigint, x binary"), "features")
    so_far = F.sum("lines").over(Window.orderBy("key", "tie", "q").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # about train_docs rows
    got = made.withColumn("so_far", so_far).where(F.col("so_far") <= train_lines).select("q", "x").collect()
    got.sort(key=lambda r: (r["q"], r["x"]))
    lines = [np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)) for r in got]
    if not lines:
        return Model(np.zeros(0), np.zeros((2, 2)), 0.5)
    return train(np.concatenate(lines).astype(np.float64), np.array([len(x) for x in lines], np.int64), np.array([r["q"] for r in got]))


def score(docs: DataFrame, model: Model, *carry: Column) -> DataFrame:
    """Returns doc_id, then ``carry`` columns, score, and predicted (1 where the score is at least 0.5)."""
    ready_for_python(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *carry, F.col("text"))
    names = [*rows.columns[:-1], "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), f"{kinds}, score double, predicted int")


def line_marginals(docs: DataFrame, model: Model) -> DataFrame:
    """P(good) of every line: doc_id, good array<double> in the order of the lines."""
    ready_for_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, counts = line_features(b.column(1).to_pylist())
            good = forward_backward(with_neighbours(x, counts) @ model.weights, model.step, counts)[0] if len(model.weights) else np.full(len(x), model.prior)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.split(good, np.cumsum(counts)[:-1]) if len(counts) else [], pa.list_(pa.float64()))], ["doc_id", "good"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, good array<double>")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose text is predicted to be good."""
    ready_for_python(docs.sparkSession)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns, names).filter(pa.array(model.score(b.column(at).to_pylist()) >= 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)

"""Passages that repeat across documents, by sparse suffix arrays.

Of a text's suffixes only those are kept that start at minimisers: in every
window of ``MIN_WORDS`` words, the run of ``KEY_WORDS`` words with the lowest
hash. The choice depends on the window's words alone, so a passage that two
documents share puts suffixes at the same places of it in both. Kept suffixes
are sorted by the hash of their first ``KEY_WORDS`` words, which makes
suffixes that begin alike neighbours, and neighbours of different documents
are a seed.

A seed is extended to both sides. In a plain suffix array that means comparing
words with the neighbour in order; but the neighbour that goes on longest to
the right need not be the one that agrees to the left, and a passage shared
with another one would be lost. So of the windows that lie over a seed, to its
left and right, those whose words occur in another document are found in the
order of the whole window's hash: all extents with all partners, exactly.
Windows that touch join to one passage.

So a word is in a passage exactly if it lies in ``MIN_WORDS`` words in a row
that another document holds too (A-Z taken as a-z).

Every passage names partners: documents that hold its windows too, and where.
Over all passages the partners join all documents that share a window, though
not every pair of them is named.

Defined results: a null text and one below ``MIN_WORDS`` words have no
passages; a passage that repeats only within one document is none; rows that
repeat both doc_id and text are one document, each with its rows; rows of one
doc_id with different texts are documents of their own; an empty table gives
no rows; extra columns are ignored; a null doc_id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, ready_for_python
from .shingles import blocks, packed, run_hashes, tidy, word_hashes
from .tokencounts import shared_places

MIN_WORDS = 50
KEY_WORDS = 20
HOT_SHARE = 1_000


def minimisers(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` keys the place of its lowest one, the first of equals."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(keys))
    span = 1
    while span * 2 <= width:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(keys[b] < keys[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(keys[b] < keys[a], b, a)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each text: hashes of its key runs, of its windows, and each window's minimiser."""
    width = MIN_WORDS - KEY_WORDS + 1
    for _, _, raw, offsets in blocks(column):
        words, counts = word_hashes(raw, offsets, fold=True)
        keys, windows = run_hashes(words, KEY_WORDS), run_hashes(words, MIN_WORDS)
        lowest = minimisers(keys, width)
        at = 0
        for n in counts.tolist():
            m = max(0, n - MIN_WORDS + 1)
            yield keys[at : at + m + width - 1] if m else keys[:0], windows[at : at + m], lowest[at : at + m] - at, n
            at += n


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens, places = [], []
        for keys, _, lowest, _ in _texts(b.column(1)):
            p = lowest[np.concatenate([[True], lowest[1:] != lowest[:-1]])] if len(lowest) else lowest
            tokens.append(keys[p])
            places.append(p.astype("<i4"))
        yield pa.RecordBatch.from_arrays([b.column(0), packed(tokens), packed(places)], ["doc", "tokens", "places"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens, places = [], []
        for (_, windows, lowest, _), seeds in zip(_texts(b.column(2)), b.column(3)):
            over = np.flatnonzero(np.isin(lowest, np.frombuffer(seeds.as_buffer(), "<i4")))
            tokens.append(windows[over])
            places.append(over.astype("<i4"))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(tokens), packed(places)], ["doc", "doc_id", "tokens", "places"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part of a passage that runs along with one partner."""
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("doc", "doc_id", "start_word", "end_word", "at_word", "partner", "partner_start")}
        for doc, doc_id, *packs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(i) for i in (2, 3, 4))):
            at, other, where = (np.frombuffer(x.as_buffer(), t) for x, t in zip(packs, ("<i4", "<i8", "<i4")))
            cut = np.diff(at) > MIN_WORDS  # windows that touch or overlap join
            first = np.concatenate([[0], np.flatnonzero(cut) + 1])
            last = np.concatenate([np.flatnonzero(cut), [len(at) - 1]])
            turn = np.concatenate([[True], cut | (np.diff(other) != 0) | (np.diff(where) != np.diff(at))])
            part = np.flatnonzero(turn)
            of = np.searchsorted(first, part, side="right") - 1
            for k, v in (("start_word", at[first[of]]), ("end_word", at[last[of]] + MIN_WORDS), ("at_word", at[part]), ("partner", other[part]), ("partner_start", where[part])):
                out[k].append(v)
            out["doc"] += [doc] * len(part)
            out["doc_id"] += [doc_id] * len(part)
        join = lambda k, t: pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, np.int32), t)
        made = [pa.array(out["doc"], pa.int64()), pa.array(out["doc_id"], pa.int64()), *(join(k, pa.int64() if k == "partner" else pa.int32()) for k in ("start_word", "end_word", "at_word", "partner", "partner_start"))]
        yield pa.RecordBatch.from_arrays(made, list(out))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (from 0, the end not included) and partners of every repeated passage of ``docs`` (doc_id, text).

    ``partners``: at_word, partner_id, partner_start, in order: from at_word of
    the document on, the words are those from partner_start of the partner.
    """
    ready_for_python(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    keyed = docs.where("text is not null").select(F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seeds = scratch.keep(keyed.select("doc", "text").mapInArrow(tidy(_seeds), "doc bigint, tokens binary, places binary").where(F.octet_length("tokens") > 0), "seeds")
    entries = int(seeds.agg(F.sum(F.octet_length("tokens"))).head()[0] or 0) // 8
    seeded = scratch.keep(shared_places(seeds, entries).select("doc", "places"), "seeded")
    scratch.drop("seeds")
    over = keyed.join(seeded.hint("merge"), "doc").select("doc", "doc_id", "text", "places")
    windows = scratch.keep(over.mapInArrow(tidy(_windows), "doc bigint, doc_id bigint, tokens binary, places binary"), "windows")
    scratch.drop("seeded")
    entries = int(windows.agg(F.sum(F.octet_length("tokens"))).head()[0] or 0) // 8
    held = shared_places(windows.select("doc", "tokens", "places"), entries)
    schema = "doc bigint, doc_id bigint, start_word int, end_word int, at_word int, partner bigint, partner_start int"
    # Of rows that repeat doc_id and text each has its passages.
    rows = windows.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    parts = scratch.keep(rows.join(held, "doc").select("doc", "doc_id", "places", "partners", "partner_places").mapInArrow(tidy(_passages), schema), "parts")
    names = rows.select(F.col("doc").alias("partner"), F.col("doc_id").alias("partner_id"))
    partner = F.struct("at_word", "partner_id", "partner_start")
    # Partners that more than one in HOT_SHARE parts name are at most that many; others are joined by a shuffle.
    named = scratch.keep(parts.groupBy("partner").agg(F.count("*").alias("times")).join(names, "partner"), "named")
    total = named.agg(F.sum("times")).head()[0] or 0
    often = F.broadcast(named.where(F.col("times") > total / HOT_SHARE).drop("times"))
    seldom = parts.join(often.select("partner"), "partner", "left_anti").join(named.where(F.col("times") <= total / HOT_SHARE).drop("times"), "partner")
    passages = parts.join(often, "partner").unionByName(seldom).groupBy("doc", "doc_id", "start_word", "end_word").agg(F.array_sort(F.collect_list(partner)).alias("partners"))
    copies = passages.join(rows.select("doc", "rows"), "doc").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    return copies.select("doc_id", "start_word", "end_word", "partners")

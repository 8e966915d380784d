"""In how many documents a token occurs, told back to the documents, without a row for each occurrence.

Batches of documents sort their tokens and pack (token, document) entries by
token bucket into a few binary rows; a bucket's entries are sorted and
neighbours compared. A token that a batch alone holds ``cap`` times is known
to be frequent there: the batch's documents are told at once, and one flag in
place of its entries goes to the bucket. So a token that a third of all
documents hold sends at most ``cap`` entries for each batch.

A bucket has about ``BUCKET_ENTRIES`` entries; a task gets several, in order,
and holds one at a time. Tasks grow with the square root of the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import ready_for_python
from .shingles import tidy, unpacked

#: Entries of a bucket, about; a task holds some 100 bytes for each.
BUCKET_ENTRIES = 250_000
#: Entries that are sorted and sent at once: about as many for each row as there are times more than buckets.
SEND_ENTRIES = 2_000_000
ENTRIES, TOLD, FLAGS = 0, 1, 2
_SENT = "bucket int, kind int, tokens binary, docs binary, places binary"


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _joined(batches: Iterator[pa.RecordBatch], bytes_each: int) -> Iterator[pa.Table]:
    """Batches gathered up to so many bytes of tokens."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column(1).nbytes
        if n >= bytes_each:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _send(cap: int, buckets: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _joined(batches, 8 * min(SEND_ENTRIES, 64 * buckets)):
            tokens, sizes = unpacked(b.column(1))
            docs = np.repeat(np.asarray(b.column(0).combine_chunks()), sizes)
            at = unpacked(b.column(2), "<i4")[0] if places else np.zeros(len(tokens), np.int32)
            order = np.lexsort((at, docs, tokens) if places else (docs, tokens))
            tokens, docs, at = tokens[order], docs[order], at[order]
            starts = _starts(tokens)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tokens))))
            fresh = np.concatenate([[True], (docs[1:] != docs[:-1]) | (group[1:] != group[:-1])]) if len(tokens) else np.zeros(0, bool)
            holders = np.bincount(group, fresh, len(starts)).astype(np.int64)
            if not places:  # rows that stand for one document send an entry once
                tokens, docs, at, group = tokens[fresh], docs[fresh], at[fresh], group[fresh]
                starts = _starts(tokens)
            hot = holders >= cap
            told = hot[group] if len(group) else np.zeros(0, bool)
            out: list[tuple] = []
            if told.any():
                out.append((int(tokens[0] % np.uint64(buckets)), TOLD, _blob(tokens[told]), _blob(docs[told]), _blob(at[told])))
            first = starts[hot]
            # In place of what was told goes a flag, or the first holder, which stands for the others.
            instead = (ENTRIES, tokens[first], docs[first], at[first]) if places else (FLAGS, tokens[first], None, None)
            for kind, t, d, p in ((ENTRIES, tokens[~told], docs[~told], at[~told]), instead):
                bucket = (t % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.append(_starts(bucket[by]), len(by))
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    part = by[i:j]
                    out.append((int(bucket[part[0]]), kind, _blob(t[part]), _blob(d[part]) if d is not None else b"", _blob(p[part]) if places and p is not None else b""))
            for i in range(0, len(out), 4096):
                columns = list(zip(*out[i : i + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "kind", "tokens", "docs", "places"])

    return run


def _reply(docs: np.ndarray, values: tuple[np.ndarray, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries packed by bucket of documents, so that a document makes no row of its own in every task."""
    to = docs % buckets
    order = np.argsort(to, kind="stable")
    edges = np.append(_starts(to[order]), len(order))
    rows = []
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        part = order[i:j]
        rows.append((int(to[part[0]]), _blob(docs[part]), *(_blob(v[part]) for v in values), *[b""] * (3 - len(values))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["bucket", "docs", "one", "two", "three"])


_REPLY = "bucket int, docs binary, one binary, two binary, three binary"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows of one bucket after the other; rows come in the order of buckets."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        numbers = np.asarray(b.column(0))
        edges = np.append(_starts(numbers), len(numbers))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if held and numbers[i] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = numbers[i]
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def partners(tokens: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of entries sorted by token and document, each one's partner: the token's first entry, or for its document the first one of the next document."""
    starts = _starts(tokens)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tokens))))
    own = docs == docs[starts][group]
    other = starts + np.bincount(group, own, len(starts)).astype(np.int64)
    return np.where(own, np.minimum(other[group], len(tokens) - 1), starts[group])


def _count(cap: int, places: bool, buckets: int, finish):
    """Reply with ``finish(tokens, docs, places, counts)``, documents and values, for entries whose token has two holders or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_bucket(batches):
            kinds = np.asarray(b.column(1))
            got: dict[int, tuple] = {}
            for kind in (ENTRIES, TOLD, FLAGS):
                mine = b.filter(pa.array(kinds == kind))
                t, d = unpacked(mine.column(2))[0], unpacked(mine.column(3), "<i8")[0]
                got[kind] = t, d, unpacked(mine.column(4), "<i4")[0] if places else np.zeros(len(d), np.int32)
            t, d, p = got[TOLD]
            if len(t):
                order = np.lexsort((p, d, t))  # several batches' tokens
                yield from _reply(*finish(t[order], d[order], p[order], np.full(len(t), cap, np.int64)), buckets)
            tokens, docs, at = got[ENTRIES]
            if not len(tokens):
                continue
            flags = np.unique(got[FLAGS][0])
            order = np.lexsort((at, docs, tokens))
            tokens, docs, at = tokens[order], docs[order], at[order]
            starts = _starts(tokens)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(tokens))))
            fresh = np.concatenate([[True], (docs[1:] != docs[:-1]) | (group[1:] != group[:-1])])
            counts = np.bincount(group, fresh, len(starts)).astype(np.int64)
            counts[np.isin(tokens[starts], flags, assume_unique=True)] = cap
            counts = np.minimum(counts, cap)[group]
            keep = counts >= 2
            yield from _reply(*finish(tokens[keep], docs[keep], at[keep], counts[keep]), buckets)

    return run


def _gather(kinds: tuple[str, ...], build):
    """``build(documents, first entries, values)`` over the sorted entries of a bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_bucket(batches):
            docs = unpacked(b.column(1), "<i8")[0]
            order = np.argsort(docs, kind="stable")
            docs = docs[order]
            starts = _starts(docs)
            yield build(docs[starts], starts, *(unpacked(b.column(2 + i), kind)[0][order] for i, kind in enumerate(kinds)))

    return run


def tasks_for(buckets: int, least: int) -> int:
    """Tasks for so many buckets: one each while they are few, then fewer."""
    return max(least, min(buckets, ceil(8 * sqrt(buckets))))


def _told(rows: DataFrame, entries: int, cap: int, places: bool, finish, kinds: tuple[str, ...], build, schema: str) -> DataFrame:
    spark = rows.sparkSession
    ready_for_python(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-entries // BUCKET_ENTRIES))
    tasks = tasks_for(buckets, least)
    sent = rows.mapInArrow(tidy(_send(cap, buckets, places)), _SENT).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    replied = sent.mapInArrow(tidy(_count(cap, places, buckets, finish)), _REPLY).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return replied.mapInArrow(tidy(_gather(kinds, build)), schema)


def _cut(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column: the values from each start to the next."""
    ends = (np.append(starts, len(values)) * values.dtype.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def shared_counts(rows: DataFrame, entries: int) -> DataFrame:
    """doc, n_shared: how many tokens of a document another one holds too (documents with any).

    ``rows``: doc, tokens (packed 64-bit values, distinct within a document);
    ``entries``: the number of tokens in all.
    """

    def finish(tokens, docs, at, counts):
        d, n = np.unique(docs, return_counts=True)
        return d, (n.astype("<i8"),)

    def build(docs, starts, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.add.reduceat(n, starts), pa.int64())], ["doc", "n_shared"])

    return _told(rows, entries, 2, False, finish, ("<i8",), build, "doc bigint, n_shared bigint")


def shared_tokens(rows: DataFrame, entries: int, cap: int) -> DataFrame:
    """doc, tokens, counts: the packed tokens that other documents hold too; counts are bytes and stop at ``cap``.

    ``rows`` as for ``shared_counts``.
    """

    def build(docs, starts, tokens, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), _cut(tokens, starts), _cut(counts, starts)], ["doc", "tokens", "counts"])

    return _told(rows, entries, cap, False, lambda tokens, docs, at, counts: (docs, (tokens, counts.astype(np.uint8))), ("<u8", "u1"), build, "doc bigint, tokens binary, counts binary")


def shared_places(rows: DataFrame, entries: int) -> DataFrame:
    """doc, places, partners, partner_places: packed 32-bit places whose tokens other documents hold too, and of each one other document (64 bits) and its place.

    ``rows``: doc, tokens, places (packed alike; a token may stand at several
    places of a document). All holders of a token are joined by partners: each
    has the first holder its bucket or batch knows, and the first ones of
    batches have that of the bucket.
    """

    def finish(tokens, docs, at, counts):
        other = partners(tokens, docs)
        return docs, (at.astype("<i4"), docs[other], at[other].astype("<i4"))

    def build(docs, starts, places, others, other_places) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(places))))
        order = np.lexsort((other_places, others, places, group))
        group, places, others, other_places = group[order], places[order], others[order], other_places[order]
        keep = np.concatenate([[True], (places[1:] != places[:-1]) | (group[1:] != group[:-1])]) if len(places) else np.zeros(0, bool)
        starts = np.searchsorted(group[keep], np.arange(len(docs)))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(_cut(v[keep], starts) for v in (places, others, other_places))], ["doc", "places", "partners", "partner_places"])

    return _told(rows, entries, 2, True, finish, ("<i4", "<i8", "<i4"), build, "doc bigint, places binary, partners binary, partner_places binary")

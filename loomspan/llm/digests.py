"""SHA-256 over long ordered sequences that lie in many rows, with bounded memory.

A digest of a whole sequence is taken from left to right, so the last step for
one sequence is one task; all it does is to feed bytes to the hash, a piece at
a time. Pieces are made before that, wherever the range-sorted rows lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import Scratch, ready_for_python
from .shingles import tidy

#: Values in a piece.
PIECE = 4096


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, b, value) to pieces (a, b, first, text) of at most ``PIECE`` values."""
    key, held, out = None, [], []

    def full() -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(columns[i], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["a", "b", "first", "text"])

    for batch in batches:
        for a, b, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != key or len(held) == PIECE:
                if held:
                    out.append((*key, held[0], ",".join(map(str, held))))
                key, held = (a, b), []
            held.append(value)
        if out:
            yield full()
            out = []
    if held:
        out.append((*key, held[0], ",".join(map(str, held))))
        yield full()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (a, b, sha256)."""
    key, hashed, out = None, None, []

    def full() -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(columns[i], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "sha256"])

    for batch in batches:
        for a, b, _, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != key:
                if key is not None:
                    out.append((*key, hashed.hexdigest()))
                key, hashed = (a, b), hashlib.sha256(text.encode())
            else:
                hashed.update(b"," + text.encode())
        if out:
            yield full()
            out = []
    if key is not None:
        out.append((*key, hashed.hexdigest()))
        yield full()


def joined_sha256(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """a, b, sha256 of the comma-joined decimal values, ascending, of each (a, b); ``rows`` is a kept table of three bigints a, b, value without nulls."""
    ready_for_python(rows.sparkSession)
    ordered = rows.repartitionByRange("a", "b", "value").sortWithinPartitions("a", "b", "value")
    pieces = scratch.keep(ordered.mapInArrow(tidy(_pieces), "a bigint, b bigint, first bigint, text string"), name)
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(tidy(_digests), "a bigint, b bigint, sha256 string")

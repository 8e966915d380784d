"""Hashes of words and of runs of words, computed over whole Arrow buffers.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``; with ``fold`` A-Z
count as a-z. Its hash is a polynomial over a random table of bytes, taken
from prefix sums, so that no Python object is made for a word. Hashes have 64
bits; two different runs within two compared documents collide with a
probability of about 2^-64 for each pair of runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once, at some 60 bytes of memory for each; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_rng = np.random.default_rng(20_240_229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def tidy(run):
    """``run`` as it is, but memory that a task no longer needs goes back to the system at its end: workers live on."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return tidied


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1), modulo 2^64."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1), base, np.uint64)
        out[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(out)
        if n > 4 * BLOCK_BYTES:
            _powers.clear()
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first row, end row, their bytes, and offsets into these (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_BYTES, side="right")) - 1)
        yield a, b, raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def word_hashes(raw: np.ndarray, offsets: np.ndarray, *, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a block, and the number of words of each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_BLANK[raw]
    edge = np.zeros(n + 1, bool)  # a text's first byte starts a word, whatever the text before ends in
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _TABLE)[raw] * powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64) * _BASE)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def run_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` words; runs that cross texts are for the caller to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        total = np.zeros(n, np.uint64)
        for i, p in enumerate(powers(_BASE, size + 1)[1:]):
            total += words[i : i + n] * p
    else:
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(_BASE, len(words)), out=sums[1:])
        total = (sums[size:] - sums[:-size]) * powers(_INVERSE, len(words))[:n]
    return mix(total + np.uint64((salt * 2 + 1) * 0x632BE59BD9B4E019 % (1 << 64)) + np.uint64(size))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text: runs of ``size`` words; the whole sequence where there are fewer; none without words."""
    for _, _, raw, offsets in blocks(texts):
        words, counts = word_hashes(raw, offsets, fold=True)
        runs = run_hashes(words, size)
        at = 0
        for n in counts.tolist():
            if n >= size:
                yield np.unique(runs[at : at + n - size + 1])
            elif n:
                yield run_hashes(words[at : at + n], n, salt=1)
            else:
                yield np.zeros(0, np.uint64)
            at += n


def packed(parts: list[np.ndarray]) -> pa.Array:
    """A binary column of arrays, without a Python object for each."""
    sizes = np.fromiter((p.nbytes for p in parts), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(ends) // width

"""Byte-level BPE encoding and decoding of documents.

Short texts are encoded whole, where they lie. A text longer than
``chunk_chars`` is cut into overlapping chunks that are pre-tokenised in
parallel. Chunk i is matched from its own start; the first position at or past
its end that is a pre-token boundary of both its chain and the next chunk's
chain is where the two resynchronise: matches look only forward, so behind a
common boundary both chains are the same. The pieces between those positions
are encoded and joined; where no common boundary lies in the overlap (a run of
letters longer than it), the rest of the text is encoded in one piece.

Defined results: a null text counts as empty (no tokens, hash of no bytes);
rows that repeat a doc_id each give their own row; a null doc_id is kept; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ready_for_python
from .shingles import tidy

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: A match that ends closer to the end of a chunk could differ if more text followed.
GUARD_CHARS = 8
SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string"

_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """Ranks and pattern of one vocabulary, loaded once in each Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())

    def boundaries(self, text: str, start: int = 0) -> list[int]:
        return [start, *(m.end() for m in self.pattern.finditer(text, start))]


def codec(ranks_path: str, pattern: str) -> Codec:
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks_path, pattern)
    return _codecs[key]


def digest_row(c: Codec, ids: np.ndarray) -> tuple[int, np.ndarray, str, str]:
    """Token count, ids, and the hashes of the ids (little-endian, 32 bits) and of the decoded bytes."""
    return len(ids), ids, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def chunk_cut(c: Codec, text: str, core: int) -> tuple[int, list[int], list[int], np.ndarray]:
    """Encode a chunk whose own part is its first ``core`` characters, the rest being overlap.

    Returns where this chain and the next chunk's meet (-1: nowhere in the
    overlap; the length of the text for the last chunk), the boundaries in the
    zone that the previous chunk overlaps with the number of ids before each,
    and the ids up to that meeting point.
    """
    zone_end = min(len(text), OVERLAP_CHARS + GUARD_CHARS)
    zone = [p for p in c.boundaries(text[: zone_end + GUARD_CHARS]) if p <= zone_end - GUARD_CHARS] if len(text) > zone_end else c.boundaries(text)
    if len(text) <= core:
        cut = len(text)
    else:
        ours, last = set(c.boundaries(text)), len(text) - GUARD_CHARS
        cut = next((p for p in c.boundaries(text, core) if p in ours and p <= last), -1)
    zone = [p for p in zone if cut < 0 or p <= cut]
    parts, counts = [], [0]
    for a, b in zip(zone, zone[1:]):
        parts.append(c.encode(text[a:b]))
        counts.append(counts[-1] + len(parts[-1]))
    parts.append(c.encode(text[zone[-1] : cut]) if cut >= 0 else np.empty(0, np.uint32))
    return cut, zone, counts, np.concatenate(parts)


def stitch(c: Codec, chunks: list[dict]) -> np.ndarray:
    """Ids of a text from its chunks in order (keys: core, cut, zone, counts, ids)."""
    out, at = [], 0
    for i, x in enumerate(chunks):
        zone = x["zone"].tolist()
        if x["cut"] < 0 or at not in zone:
            out.append(c.encode("".join(y["core"] for y in chunks[i:])[at:]))
            break
        out.append(x["ids"][x["counts"][zone.index(at)] :])
        at = x["cut"] - len(x["core"])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _rows(ids: list, made: list[tuple[int, np.ndarray, str, str]], with_ids: bool) -> pa.RecordBatch:
    n, arrays, one, two = (list(x) for x in zip(*made)) if made else ([], [], [], [])
    if with_ids:
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
    else:
        lists = pa.nulls(len(n), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), lists, pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, with_ids: bool = True, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and decode the ids again.

    Returns doc_id, n_tokens, ids (null without ``with_ids``), and the SHA-256
    of the ids and of the decoded bytes. Special tokens are ordinary text.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            yield _rows(b.column(0).to_pylist(), [digest_row(c, c.encode(t)) for t in b.column(1).to_pylist()], with_ids)

    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(tidy(whole), SCHEMA)

    pieces = (
        rows.where(F.length("text") > chunk_chars)
        .select("doc_id", "text", F.xxhash64("text").alias("key"), F.explode(F.sequence(F.lit(0), F.expr(f"cast((length(text) - 1) div {chunk_chars} as int)"))).alias("chunk"))
        .select("doc_id", "key", "chunk", F.expr(f"substring(text, chunk * {chunk_chars} + 1, {chunk_chars + OVERLAP_CHARS})").alias("text"))
        .repartition("doc_id", "key", "chunk")
    )
    cut_schema = "doc_id bigint, key bigint, chunk int, core string, cut int, zone binary, counts binary, ids binary"

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("core", "cut", "zone", "counts", "ids")}
            for text in b.column(3).to_pylist():
                cut, zone, counts, ids = chunk_cut(c, text, chunk_chars)
                for k, v in (("core", text[:chunk_chars]), ("cut", cut), ("zone", np.array(zone, "<i4").tobytes()), ("counts", np.array(counts, "<i4").tobytes()), ("ids", ids.astype("<u4").tobytes())):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out["core"], pa.string()), pa.array(out["cut"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("zone", "counts", "ids"))], ["doc_id", "key", "chunk", "core", "cut", "zone", "counts", "ids"])

    def join(table: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        copies = sum(r["chunk"] == 0 for r in rows)  # the same text may stand in several rows of a doc_id
        chunks = [r | {k: np.frombuffer(r[k], "<u4" if k == "ids" else "<i4") for k in ("zone", "counts", "ids")} for r in rows[::copies]]
        made = digest_row(c, stitch(c, chunks))
        return pa.Table.from_batches([_rows([rows[0]["doc_id"]] * copies, [made] * copies, with_ids)])

    long = pieces.mapInArrow(tidy(cuts), cut_schema).groupBy("doc_id", "key").applyInArrow(join, SCHEMA)
    return short.unionByName(long)

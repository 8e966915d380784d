"""Conversations as marked text with a loss mask, and read back.

Turns (from ``layouts``) are sorted by range, so that a long conversation
spreads over partitions; each partition joins its turns to pieces of at most
``PIECE_CHARS`` code points (one turn at least). A piece holds whole turns and
the spans of its text that a loss counts: what assistants say, without marks.
A conversation is its pieces in order.

A template marks where a turn begins, where its text begins, and its end.
Within roles and texts, backslashes are doubled and a backslash goes after the
first character of each control string, of this template or another; so no
control string is left there, and ``unescape`` gives back what was there.

``read_back`` parses the pieces and hashes what it finds, a piece at a time.
Pieces that are a whole conversation are read where they lie; only those of
conversations that may go on in another partition are brought together.

Defined results: turns stand in ascending order (null first), those of one
number in the order of the SHA-256 of role and text; null roles and texts are
empty; rows with a null conv_id are one conversation; repeated rows are turns;
other columns are ignored; very long texts are one piece each; an empty table
gives no pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, ready_for_python
from .shingles import tidy

PIECE_CHARS = 1 << 20


@dataclass(frozen=True)
class Template:
    """Marks around a turn, control strings that texts must not hold, and the role whose texts a loss counts."""

    turn: str = "<|im_start|>"
    text: str = "<|im_sep|>"
    end: str = "<|im_end|>\n"
    reserved: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: str = "assistant"

    def escaped(self, text: Column) -> Column:
        controls = "|".join(rf"\Q{c}\E" for c in self.reserved)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?s)(?={controls})(.)", "$1\\\\")

    def parse(self, piece: str) -> list[tuple[str, str]]:
        """The (role, text) turns of a piece."""
        turns, at = [], 0
        mark = re.compile(f"{re.escape(self.turn)}(.*?){re.escape(self.text)}(.*?){re.escape(self.end)}", re.S)
        while at < len(piece):
            m = mark.match(piece, at)
            if not m:
                raise ValueError(f"no turn begins at {at}")
            turns.append((unescape(m[1]), unescape(m[2])))
            at = m.end()
        return turns


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


PIECES = "conv_id bigint, block bigint, piece bigint, whole boolean, text string, loss array<struct<at: bigint, size: bigint>>"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())])))


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, formatted, chars, at, size) to pieces."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId()
    begun, conv, first = False, None, True
    texts: list[str] = []
    spans: list[dict] = []
    chars = made = 0

    def piece(whole: bool) -> pa.RecordBatch:
        nonlocal texts, spans, chars, made
        row = (conv, block, made, whole, "".join(texts), spans)
        texts, spans, chars, made = [], [], 0, made + 1
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], ["conv_id", "block", "piece", "whole", "text", "loss"])

    for b in batches:
        for c, text, n, at, size in zip(*(x.to_pylist() for x in b.columns)):
            if begun and c != conv:
                yield piece(not first and not made)
                first, made = False, 0
            elif texts and chars + n > most:
                yield piece(False)
            begun, conv = True, c
            texts.append(text)
            if size is not None:
                spans.append({"at": chars + at, "size": size})
            chars += n
    if begun:
        yield piece(False)


def _batched(pieces: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Small pieces by the hundred."""
    held, chars = [], 0
    for p in pieces:
        held.append(p)
        chars += p.nbytes
        if len(held) == 256 or chars > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, chars = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def format_turns(turns: DataFrame, template: Template = Template(), *, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces (conv_id, block, piece, whole, text, loss) of ``turns`` (conv_id, turn, role, text); a conversation's are in order of block, then piece."""
    ready_for_python(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), digest.alias("digest"), F.monotonically_increasing_id().alias("salt"))
    keys = ["conv_id", "turn", "digest", "salt"]  # not the text, as Spark samples keys to the driver
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    own = ordered.select("conv_id", template.escaped(F.col("role")).alias("r"), template.escaped(F.col("text")).alias("t"), (F.col("role") == template.learned).alias("learned"))
    at = F.length("r") + len(template.turn) + len(template.text)
    marked = own.select("conv_id", F.concat(F.lit(template.turn), "r", F.lit(template.text), "t", F.lit(template.end)).alias("formatted"), (at + F.length("t") + len(template.end)).cast("bigint").alias("chars"), at.cast("bigint").alias("at"), F.when(F.col("learned"), F.length("t")).cast("bigint").alias("size"))
    return marked.mapInArrow(tidy(lambda b: _batched(_joined(b, piece_chars), 4 * piece_chars)), PIECES)


def _read(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Ordered pieces to digests of their conversations."""
    begun, conv = False, None
    n = loss_chars = chars = 0
    said = loss = None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    out: list[tuple] = []

    def full() -> pa.RecordBatch:
        nonlocal out
        columns, out = list(zip(*out)), []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for b in batches:
        for c, text, spans in zip(*(x.to_pylist() for x in b.columns)):
            if not begun or c != conv:
                if begun:
                    out.append((conv, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                begun, conv, n, loss_chars, chars, said, loss = True, c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, words in template.parse(text):
                said.update(f"{role}\n{words}\n".encode())
                n += 1
            for s in spans:
                learned = unescape(text[s["at"] : s["at"] + s["size"]])
                loss.update(learned.encode())
                loss_chars += len(learned)
            chars += len(text)
        if out:
            yield full()
    if begun:
        out.append((conv, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield full()


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from kept ``pieces`` alone."""
    ready_for_python(pieces.sparkSession)
    columns = ["conv_id", "text", "loss"]
    kinds = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    spread = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece").select(*columns)
    return pieces.where("whole").select(*columns).mapInArrow(tidy(lambda b: _read(b, template)), kinds).unionByName(spread.mapInArrow(tidy(lambda b: _read(b, template)), kinds))


def formatted(turns: DataFrame, scratch: Scratch, template: Template = Template()) -> DataFrame:
    """``format_turns``, written to the shared folder."""
    return scratch.keep(format_turns(turns, template), "formatted")

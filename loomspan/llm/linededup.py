"""Line deduplication over levelled sorted runs of line hashes.

The index is a set of runs: tables of line hashes, bucketed and sorted by both
hashes. A batch of documents drops the lines whose hashes are in a run, and
those that a smaller doc_id of the batch holds; then the hashes new to the
index become a run of level 0. The batch's distinct hashes are shuffled once,
into the runs' buckets; meeting the runs is then a merge of sorted buckets,
without a shuffle or sort of any run. ``FANOUT`` runs of a level are compacted
into one of the next, bucket by bucket, also without a shuffle, so that a
batch meets only a few runs.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with
A-Z in lower case; keys below ``MIN_CHARS`` code points are never dropped. Two
64-bit hashes stand for a key.

Batches taken in ascending order of doc_id give the result of one pass over
all of them: a key found in two documents or more stays only in the smallest
doc_id that holds it (all its lines there stay). Their number grows with the
logarithm of the input and is always large enough to compact.

A line that more than one in ``HOT_SHARE`` of a batch's lines equal is hot:
there are at most ``HOT_SHARE`` such keys, so they are broadcast to where the
lines are; all others meet their lines in a shuffle.

Defined results: a null or empty text is one empty line, which stays; rows
that repeat a doc_id are parts of one document, so they never make a line
repeated; rows with a null doc_id keep their lines and aren't indexed; an
empty table gives no rows; ties cannot occur, as doc_ids order the holders;
extra columns are kept (``deduplicate_lines``) or ignored.
"""

from __future__ import annotations

from contextlib import contextmanager
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

MIN_CHARS = 10
FANOUT = 3
#: Batches of an input of up to ``SMALL`` documents; each doubling beyond that adds one.
BATCHES, SMALL = 5, 50_000_000
HOT_SHARE = 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay. For ASCII texts, which the first branch finds, lower() is the same and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def key_hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, of (hash of the text), line (its place from 0), h1, h2: the keys of each row that are long enough."""
    key = F.col("__key")
    return (
        docs.where("doc_id is not null and text is not null")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("of"), F.split("text", "\n").alias("__lines"))  # once for a text, not for a line
        .select("doc_id", "of", F.posexplode("__lines").alias("line", "__line"))
        .select("doc_id", "of", "line", line_key(F.col("__line")).alias("__key"))
        .where(F.length(key) >= MIN_CHARS)
        .select("doc_id", "of", "line", key_hashes(key).alias("h"))
        .select("doc_id", "of", "line", "h.h1", "h.h2")
    )


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Lets plans rely on the order within buckets, which have one file each here."""
    before = spark.conf.get(_ORDERED)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


class LineIndex:
    """Levelled runs of the line hashes of all documents added so far.

    A run is the part ``not old`` of a table (h1, h2, first, last, lines, old).
    """

    def __init__(self, scratch: Scratch, buckets: int | None = None):
        self.spark, self.scratch = scratch.spark, scratch
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def _write(self, keys: DataFrame) -> str:
        """``keys`` as a run; its rows lie in its buckets already."""
        table = self.scratch.bucketed(keys, "line_runs", self.buckets, "h1", "h2")
        self.made.append(table)
        return table

    def _drop(self, table: str) -> None:
        self.scratch.drop_table(table)
        self.made.remove(table)

    def compacted(self, runs: list[str]) -> DataFrame:
        """The rows of some runs, whose keys differ, still in their buckets."""
        rows = self.spark.table(runs[0]).where("not old")
        for r in runs[1:]:
            rows = rows.unionByName(self.spark.table(r).where("not old"))
        return rows.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("lines").alias("lines"), F.lit(False).alias("old"))

    def _push(self, table: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= FANOUT:
            runs, self.levels[level] = self.levels[level], []
            self._push(self._write(self.compacted(runs)), level + 1)
            for r in runs:
                self._drop(r)

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def holders(self, lines: DataFrame) -> DataFrame:
        """The keys of ``lines`` with their smallest and largest doc_id, number of lines, and whether a run holds them."""
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            partly = lines.groupBy("h1", "h2", F.spark_partition_id().alias("__at")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("lines"))
            keys = partly.repartition(self.buckets, "h1", "h2").groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("lines").alias("lines"))
        else:
            keys = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("lines"))
        runs = self.runs()
        for i, run in enumerate(runs):
            seen = self.spark.table(run).where("not old").select("h1", "h2", F.lit(True).alias(f"seen{i}"))
            keys = keys.join(seen.hint("merge"), ["h1", "h2"], "left")
        old = F.coalesce(*(F.col(f"seen{i}") for i in range(len(runs))), F.lit(False))
        return keys.select("h1", "h2", "first", "last", "lines", old.alias("old"))

    def add(self, lines: DataFrame, name: str, *, last: bool = False) -> DataFrame:
        """Dropped lines (doc_id, of, line) of a batch, whose keys then belong to the index, unless it is the ``last`` batch.

        ``lines`` is as from ``line_hashes``; rows may repeat.
        """
        scratch, place = self.scratch, ["doc_id", "of", "line"]
        with sorted_buckets(self.spark):
            table = self._write(self.holders(lines))
            held = self.spark.table(table)
            n = held.agg(F.sum("lines")).head()[0] or 0
            # Keys with several holders, or known before.
            repeated = held.where("old or first < last").select("h1", "h2", "first", "old", (F.col("lines") > n / HOT_SHARE).alias("hot"))
            hot = scratch.keep(repeated.where("hot").drop("hot"), f"{name}-hot")  # at most HOT_SHARE rows
            later = "old or doc_id > first"
            often = lines.join(F.broadcast(hot), ["h1", "h2"]).where(later).select(*place)
            others = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
            seldom = others.join(repeated.where("not hot"), ["h1", "h2"]).where(later).select(*place)
            dropped = scratch.keep(often.unionByName(seldom), f"{name}-dropped")
            if last:
                self._drop(table)
            else:
                self._push(table)
        return dropped

    def close(self) -> None:
        for t in [*self.made]:
            self._drop(t)
        self.levels = []


def batches_for(n: int) -> int:
    """Batches for n documents."""
    return BATCHES + max(0, int(log2(max(n, 1) / SMALL)) + 1 if n > SMALL else 0)


def dropped_lines(docs: DataFrame, scratch: Scratch, *, batches: int | None = None) -> DataFrame:
    """doc_id, of, line of the lines that go, found in batches of ascending doc_id."""
    ids = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    batches = batches or batches_for(ids.count())
    edges = sorted({min(int(x), (1 << 63) - 1) for x in ids.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    batch = F.lit(0)
    for x in edges:
        batch = batch + (F.col("doc_id") > F.lit(x)).cast("int")
    lines = scratch.keep(line_hashes(docs).withColumn("batch", batch), "lines", by="batch")
    index, parts = LineIndex(scratch, scratch.buckets("lines")), []
    try:
        for i in range(len(edges) + 1):
            parts.append(index.add(lines.where(F.col("batch") == i).drop("batch"), f"batch{i}", last=i == len(edges)))
    finally:
        index.close()
    scratch.drop("lines")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_drops(docs: DataFrame, *, batches: int | None) -> DataFrame:
    """``docs`` with ``__drops``: the places of the lines that go, ascending (null: none)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    places = F.array_sort(F.collect_set("line"))  # bounded by the lines of a document
    drops = dropped_lines(docs, scratch, batches=batches).groupBy(F.col("doc_id").alias("__drop_id"), F.col("of").alias("__drop_of")).agg(places.alias("__drops"))
    drops = scratch.keep(drops, "drops")
    # Both sides grow with the input, so the texts move once, at every size.
    return docs.join(drops.hint("merge"), (F.col("doc_id").cast("bigint") == F.col("__drop_id")) & (F.xxhash64("text") == F.col("__drop_of")), "left").drop("__drop_id", "__drop_of")


def _kept_lines() -> Column:
    """The lines that stay; array_except hashes whole numbers, so this is linear in the lines, however many go."""
    text = F.array(F.struct(F.split("text", "\n").alias("lines"), F.col("__drops").alias("gone")))  # bound once

    def staying(t: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(t["lines"]) - 1), t["gone"]), lambda p: t["lines"][p])

    return F.transform(text, staying)[0]


def deduplicate_lines(docs: DataFrame, *, batches: int | None = None) -> DataFrame:
    """The rows of ``docs``, columns as they are, with repeated lines gone from ``text``.

    A column ``n_chars``, if there, is the length of the new text. A text whose
    lines all go is empty; its row stays.
    """
    names = docs.columns
    marked = _with_drops(docs, batches=batches)
    text = F.when(F.col("__drops").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(), "\n"))
    out = marked.withColumn("__new", text)
    return out.select(*(F.col("__new").alias("text") if c == "text" else F.length(F.coalesce("__new", F.lit(""))).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in names))


def dedup_report(docs: DataFrame, *, batches: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept of each row."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    n_lines = (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    marked = _with_drops(docs.select("doc_id", "text"), batches=batches)
    kept = F.when(F.col("__drops").isNotNull(), _kept_lines())
    cut = marked.select("doc_id", whole.alias("whole"), n_lines.alias("n_lines"), kept.alias("kept"))
    dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("bigint")
    return cut.select("doc_id", "n_lines", dropped.alias("n_dropped"), F.sha2(F.coalesce(F.array_join("kept", "\n"), F.col("whole")), 256).alias("kept_sha256"))

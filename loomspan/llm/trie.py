"""Trie of conversation prefixes, summed over subtrees by heavy paths.

A node is a distinct sequence of first turns of some conversations, its
members. It is named by its smallest member and its depth, which together are
unique. Sequences are compared by 128-bit keys: a turn's digest is hashed with
its depth, and the sum of these hashes over a prefix is the prefix's key, so
keys come from prefix sums, also for a conversation in many blocks.

Every node chooses as heavy child the one with the most members (then the
smallest name). Any other child has at most half of its parent's members, so
a path to the root has at most log2(conversations) light edges. A node's path
begins at its last light ancestor (or itself); the number of light nodes above
is its level. Paths are kept as arrays, in segments of ``BLOCK`` depths. From
the deepest level up, each segment is suffix-summed in one step, later
segments' sums are added, and what path heads have is added to their parents,
on the next level up. So the rounds are logarithmic, however deep the trie is.

Hot conversations, nodes and parents: turns are placed by a range sort and
summed by block; a node that more than one in ``HOT_SHARE`` of all prefixes
share is broadcast (there are fewer than ``HOT_SHARE``), others meet their
prefixes in a shuffle; light children are summed before they are shuffled to
their parent.

Defined results: null turns come first; turns of one number stand in the order
of the SHA-256 of role and text; null roles and texts are empty; rows with a
null conv_id are no conversation's; repeated rows are turns of their own; very
long texts are hashed whole, other columns ignored; an empty table has no
nodes, not even the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import placed
from .scratch import Scratch, ready_for_python
from .shingles import tidy

#: Depths in a block of a conversation and in a segment of a path.
BLOCK = 4096
HOT_SHARE = 1_000
#: A word, as everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Trie:
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ``ends``: conv_id, depth, member for each conversation, at the node where it ends."""

    nodes: DataFrame
    ends: DataFrame


def placed_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, place (from 0), digest and words of every turn of ``conversations`` (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    return placed(scratch.keep(rows, "turns"), ["conv_id"], ["turn", "digest"], scratch, "placed").select("conv_id", "place", "digest", "words")


def meet(many: DataFrame, few: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``many`` rows with ``few``, whose keys are unique; ``weight`` is the number of rows of ``many`` that a key has, ``total`` their sum."""
    hot = F.broadcast(few.where(F.col(weight) > total / HOT_SHARE))  # fewer than HOT_SHARE rows
    often = many.join(hot, keys)
    seldom = many.join(hot.select(*keys), keys, "left_anti").join(few.where(F.col(weight) <= total / HOT_SHARE), keys)
    return often.unionByName(seldom)


def _block(depth: Column) -> Column:
    return F.floor(depth / BLOCK).cast("bigint")


def _prefixes(sequences: DataFrame, deep: bool, scratch: Scratch) -> DataFrame:
    """``sequences`` with the keys of each prefix (k1, k2) and of the one before (p1, p2)."""
    x, y = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit(11))
    lanes = [v for h in (x, y) for v in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]  # 32 bits each, so that sums don't overflow
    rows = sequences.select("conv_id", "depth", "words", "last", _block(F.col("depth")).alias("block"), *(v.alias(f"t{i}") for i, v in enumerate(lanes)))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if deep:
        rows = scratch.keep(rows, "lanes")
        sums = rows.groupBy("conv_id", "block").agg(*(F.sum(f"t{i}").alias(f"t{i}") for i in range(4)))
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for a block
        carried = sums.select("conv_id", "block", *(F.sum(f"t{i}").over(before).alias(f"c{i}") for i in range(4))).where("block > 0")
        carried = scratch.keep(carried, "carried")
        rows = rows.join(carried.hint("merge"), ["conv_id", "block"], "left")
    summed = [F.sum(f"t{i}").over(within) + (F.coalesce(f"c{i}", F.lit(0)) if deep else F.lit(0)) for i in range(4)]
    rows = rows.select("conv_id", "depth", "words", "last", *(s.alias(f"s{i}") for i, s in enumerate(summed)), *(F.col(f"t{i}") for i in range(4)))
    key = lambda parts: (F.xxhash64(*parts), F.xxhash64(*parts[::-1], F.lit(12)))
    k1, k2 = key([F.col(f"s{i}") for i in range(4)])
    p1, p2 = key([F.col(f"s{i}") - F.col(f"t{i}") for i in range(4)])
    return rows.select("conv_id", "depth", "words", "last", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"))


def _marked(prefixes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes with members, children and whether they are their parent's heavy child; and their sums by parent."""
    nodes = prefixes.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("words").alias("words"))
    nodes = scratch.keep(nodes, "nodes")
    best = F.max_by(F.struct("k1", "k2"), F.struct("n_convs", F.bitwise_not("node")))
    kids = scratch.keep(nodes.groupBy((F.col("depth") - 1).alias("depth"), "p1", "p2").agg(F.count("*").alias("n_children"), best.alias("heavy")), "kids")
    heavy = kids.select((F.col("depth") + 1).alias("depth"), "heavy.k1", "heavy.k2", F.lit(True).alias("is_heavy"))
    counts = kids.select("depth", F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    key = ["depth", "k1", "k2"]
    marked = nodes.drop("p1", "p2").join(counts, key, "left").join(heavy, key, "left")
    return scratch.keep(marked.select(*key, "node", "n_convs", "words", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("is_heavy").isNull().alias("light")), "marked"), kids


def _on_paths(walks: DataFrame, root: int, deep: bool, scratch: Scratch) -> DataFrame:
    """A row for each node but the root: its parent, its path's head, its parent's path's head, and its level."""
    block = _block(F.col("depth"))
    rows = walks.withColumn("block", block)
    in_block = Window.partitionBy("conv_id", "block").orderBy("depth")
    up_to = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("light"), F.struct("node", "depth"))
    kind = "struct<node: bigint, depth: bigint>"
    start = F.struct(F.lit(root).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("depth"))
    if deep:
        sums = rows.groupBy("conv_id", "block").agg(F.max_by(F.struct("node", "depth"), F.when(F.col("light"), F.col("depth"))).alias("h"), F.count_if("light").alias("l"), F.max_by("node", "depth").alias("n"))
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        had = sums.select("conv_id", "block", F.last("h", True).over(before).alias("c_head"), F.sum("l").over(before).alias("c_level"), F.last("n").over(before).alias("c_node"))
        rows = rows.join(scratch.keep(had.where("block > 0"), "heads").hint("merge"), ["conv_id", "block"], "left")
    else:
        rows = rows.withColumns({"c_head": F.lit(None).cast(kind), "c_level": F.lit(0).cast("bigint"), "c_node": F.lit(None).cast("bigint")})
    rows = rows.withColumn("head", F.coalesce(F.last(head, True).over(up_to).cast(kind), "c_head", start))
    above = F.coalesce(F.lag("head").over(in_block), "c_head", start)
    parent = F.coalesce(F.lag("node").over(in_block), "c_node", F.lit(root))
    level = F.count_if("light").over(up_to) + F.coalesce("c_level", F.lit(0))
    rows = rows.select("conv_id", "depth", "node", "n_convs", "n_children", "words", "light", "head", above.alias("above"), parent.alias("parent"), level.alias("level"))
    return rows.where("node = conv_id")


def _suffix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (head, seg, first, turns, added) with the sums from each of their nodes to the segment's end."""
    for b in batches:
        turns, added = b.column("turns"), b.column("added")
        flat, size = turns.flatten(), pc.list_value_length(turns).to_numpy(zero_copy_only=False)
        value = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("depth", "leaves", "saved")}
        ends = np.cumsum(size)
        starts = ends - size
        more, extra = added.flatten(), pc.fill_null(pc.list_value_length(added), 0).to_numpy(zero_copy_only=False)
        if len(more):
            # Depths in a segment follow one another.
            at = np.repeat(starts - value["depth"][starts], extra) + more.field("depth").to_numpy(zero_copy_only=False)
            for c in ("leaves", "saved"):
                np.add.at(value[c], at, more.field(c).to_numpy(zero_copy_only=False))
        out = {}
        for c in ("leaves", "saved"):
            total = np.concatenate([[0], np.cumsum(value[c])])
            out[c] = np.repeat(total[ends], size) - total[:-1]
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(out[c])) for c in ("leaves", "saved")]
        sums = [pa.array(out[c][starts]) for c in ("leaves", "saved")]
        names = ["head", "seg", "first", "above", "turns"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *lists, *sums], [*names, "leaves", "saved", "all_leaves", "all_saved"])


def _raised(sums: DataFrame, column: str, by: Column) -> DataFrame:
    return sums.withColumns({column: F.transform(column, lambda v: v + by), f"all_{column}": F.col(f"all_{column}") + by})


TURN = "struct<depth: bigint, conv_id: bigint, parent: bigint, n_convs: bigint, n_children: bigint, leaves: bigint, saved: bigint>"
HEAD = "struct<node: bigint, depth: bigint>"
PART = f"head {HEAD}, seg bigint, first boolean, above {HEAD}, turns array<{TURN}>"


def _summed(paths: DataFrame, top: int, deep: bool, scratch: Scratch) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, from the deepest level to the root's."""
    added, done = None, []
    for level in range(top, -1, -1):
        rows = paths.where(F.col("level") == level).drop("level")
        if added is None:
            rows = rows.withColumn("added", F.lit(None).cast("array<struct<depth: bigint, leaves: bigint, saved: bigint>>"))
        else:
            rows = rows.join(added.hint("merge"), ["head", "seg"], "left")
        sums = rows.select("head", "seg", "first", "above", "turns", "added").mapInArrow(tidy(_suffix_sums), f"{PART}, leaves array<bigint>, saved array<bigint>, all_leaves bigint, all_saved bigint")
        if deep:
            sums = scratch.keep(sums, f"parts{level}")
            later = Window.partitionBy("head").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)  # a row for a segment
            rest = sums.select("head", "seg", *(F.coalesce(F.sum(f"all_{c}").over(later), F.lit(0)).alias(f"rest_{c}") for c in ("leaves", "saved")))
            sums = sums.join(rest.where("rest_leaves > 0").hint("merge"), ["head", "seg"], "left")
            for c in ("leaves", "saved"):
                sums = _raised(sums, c, F.coalesce(f"rest_{c}", F.lit(0)))
        sums = scratch.keep(sums.select("head", "seg", "first", "above", "turns", "leaves", "saved", "all_leaves", "all_saved"), f"sums{level}")
        done.append(sums.select("turns", "leaves", "saved"))
        if level:
            depth = F.col("head.depth") - 1
            to = sums.where("first").groupBy(F.col("above").alias("head"), depth.alias("depth")).agg(F.sum("all_leaves").alias("leaves"), F.sum("all_saved").alias("saved"))
            added = to.groupBy("head", _block(F.col("depth")).alias("seg")).agg(F.collect_list(F.struct("depth", "leaves", "saved")).alias("added"))  # at most BLOCK entries
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    node = F.explode(F.arrays_zip("turns", "leaves", "saved")).alias("n")
    rows = out.select(node)
    return rows.select("n.turns.conv_id", "n.turns.depth", F.col("n.turns.parent").alias("parent_conv_id"), "n.turns.n_convs", "n.turns.n_children", F.col("n.leaves").alias("n_leaves"), F.col("n.saved").alias("saved_tokens"))


def prefix_trie(sequences: DataFrame, conversations: DataFrame, scratch: Scratch) -> Trie:
    """The trie of ``sequences`` (conv_id, depth from 1 without gaps, digest, words, last), kept tables both.

    ``conversations`` (conv_id, total) has every conversation with its number of
    turns, turnless ones too; ``last`` marks a conversation's last turn.
    """
    spark = sequences.sparkSession
    ready_for_python(spark)
    counts = conversations.agg(F.min("conv_id").alias("root"), F.count("*").alias("n"), F.max("total").alias("deepest"), F.sum("total").alias("prefixes")).head()
    if not counts.n:
        bigints = ", ".join(f"{c} bigint" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
        return Trie(spark.createDataFrame([], bigints), spark.createDataFrame([], "conv_id bigint, depth bigint, member bigint"))
    root, deep = counts.root, counts.deepest >= BLOCK
    prefixes = scratch.keep(_prefixes(sequences, deep, scratch), "prefixes")
    marked, kids = _marked(prefixes, scratch)
    walks = scratch.keep(meet(prefixes.select("conv_id", "depth", "last", "k1", "k2"), marked, ["depth", "k1", "k2"], "n_convs", counts.prefixes).drop("k1", "k2"), "walks")
    ends = walks.where("last").select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    ends = ends.unionByName(conversations.where("total = 0").select(F.lit(root).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.col("conv_id").alias("member")))
    of_root = kids.where("depth = 0").head()
    columns = "conv_id bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, words bigint, light boolean, head struct<node: bigint, depth: bigint>, above struct<node: bigint, depth: bigint>, level bigint"
    top = spark.createDataFrame([(root, 0, None, counts.n, of_root.n_children if of_root else 0, 0, False, (root, 0), None, 0)], columns)
    rows = scratch.keep(_on_paths(walks, root, deep, scratch).drop("node").unionByName(top), "on-paths")
    turn = F.struct("depth", "conv_id", "parent", "n_convs", "n_children", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    begins = F.col("depth") == F.col("head.depth")
    paths = rows.groupBy("level", "head", _block(F.col("depth")).alias("seg")).agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.bool_or(begins).alias("first"), F.max(F.when(begins, F.col("above"))).alias("above"))
    paths = scratch.keep(paths.select("level", "head", "seg", "first", "above", "turns"), "paths", by="level")
    return Trie(_summed(paths, rows.agg(F.max("level")).head()[0], deep, scratch), ends)

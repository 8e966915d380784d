"""Merkle manifest of a dataset: a tree for each source, and one over the sources' roots.

A leaf is the SHA-256 of a row's fields, each written as its number of UTF-8
bytes, a colon and its value, or ``-`` for null. Within a source, leaves stand
in ascending order of doc_id; runs of ``FANOUT`` consecutive nodes become the
SHA-256 of their digests (as hex text) until one node, the source's subroot,
remains. The subroots in the order of their sources (null first, by UTF-8
bytes) are the leaves of the last tree, whose root stands for all rows.

Trees are reduced by superblocks. The indices of a level's nodes are dealt into
buckets of ``FANOUT ** LEVELS`` neighbours; one grouped task reduces a bucket
to its root, so a level of Spark work takes ``LEVELS`` levels of the tree, and
a source with most of all rows is many buckets. The buckets' roots are the
next level's nodes. On the way back each bucket gets its root's proof from
above and puts its own nodes' lower proofs before it, so no proof is stored
below the top; a task holds one bucket.

Whether a bucket is a whole tree needs no count: a first bucket that is not
full is one, and a full one takes the same steps either way.

A proof is an array of steps from the leaf to the root; each has the digests
before and after the own one in its run, concatenated. ``fold`` recomputes the
root from a leaf and a proof with built-in functions, so that checking needs
nothing of this module's tasks.

Defined results: null fields (doc_id, too) are ``-``; a null doc_id comes
first in its source; rows of one doc_id stand in the order of their leaves;
repeated rows are leaves of their own; a null source is a source; empty and
very long texts are hashed whole; a source of one row has its leaf as subroot;
with one source its subroot is the root; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import placed
from .scratch import Scratch, ready_for_python

FANOUT = 3
#: Levels of the tree that one bucket reduces: 3^7 = 2,187 nodes, some 300 kB.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """Length-prefixed text of a field."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_digests(proof: Column) -> Column:
    """All digests of a proof in order, concatenated."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def _join(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def bucket_levels(digests: list[str], bucket: int, levels: int) -> Iterator[list[str]]:
    """Each level of a bucket below its root, then the root alone."""
    whole = bucket == 0 and len(digests) < FANOUT**levels
    done = 0
    while len(digests) > 1 if whole else done < levels:
        yield digests
        digests = [_join(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)]
        done += 1
    yield digests


def bucket_root(nodes: pd.DataFrame, levels: int) -> pd.DataFrame:
    """One bucket (tree, bucket, place, digest) to its root: tree, place, digest."""
    tree, bucket = nodes["tree"].iloc[0], int(nodes["bucket"].iloc[0])
    *_, root = bucket_levels(nodes.sort_values("place")["digest"].tolist(), bucket, levels)
    return pd.DataFrame({"tree": [tree], "place": [bucket], "digest": root})


def bucket_proofs(nodes: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    """The bucket's rows with each node's proof: its steps in the bucket, then those of the bucket's root."""
    nodes = nodes.sort_by("place")
    below = list(bucket_levels(nodes["digest"].to_pylist(), nodes["bucket"][0].as_py(), levels))[:-1]
    upper = above["proof"][0].as_py()
    tail_before, tail_after = [x["before"] for x in upper], [x["after"] for x in upper]
    before, after = [], []
    for i in range(len(nodes)):
        for level in below:
            run = i - i % FANOUT
            before.append("".join(level[run:i]))
            after.append("".join(level[i + 1 : run + FANOUT]))
            i //= FANOUT
        before += tail_before
        after += tail_after
    steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
    size = len(below) + len(upper)
    proofs = pa.ListArray.from_arrays(pa.array([i * size for i in range(len(nodes) + 1)], pa.int32()), steps)
    out = nodes.drop_columns(["bucket"])
    for name in above.column_names:
        if name not in ("tree", "bucket"):
            out = out.append_column(name, proofs if name == "proof" else pa.array([above[name][0].as_py()] * len(nodes), pa.string()))
    return out


def _bucketed(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"place div {FANOUT**levels}"))


def _climb(nodes: DataFrame, scratch: Scratch, name: str, step: int) -> list[DataFrame]:
    """``nodes`` (tree, place, digest, others) and above them the levels of bucket roots, up to one node for each tree."""
    levels = [nodes]
    while not levels[-1].where("place > 0").isEmpty():
        roots = _bucketed(levels[-1].select("tree", "place", "digest"), step).groupBy("tree", "bucket").applyInPandas(lambda nodes: bucket_root(nodes, step), "tree string, place bigint, digest string")
        levels.append(scratch.keep(roots, f"{name}{len(levels)}"))
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame, scratch: Scratch, name: str, step: int) -> DataFrame:
    """The lowest level's rows with the columns of ``tops`` (tree, proof, texts) for their tree; each proof leads to the tree's root and goes on as that of ``tops``."""
    more = [c for c in tops.columns if c != "tree"]
    if len(levels) == 1:
        return levels[0].join(tops, "tree")  # every tree is one node
    above = levels[-1].select("tree", F.col("place").alias("bucket")).join(tops, "tree")
    for i in range(len(levels) - 2, -1, -1):
        rows = levels[i] if not i else levels[i].select("tree", "place", "digest")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*rows.schema.fields, *above.select(more).schema.fields])
        pairs = _bucketed(rows, step).groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket"))
        above = pairs.applyInArrow(lambda nodes, root: bucket_proofs(nodes, root, step), kinds)
        if i:
            above = scratch.keep(above, f"{name}{i}").select("tree", F.col("place").alias("bucket"), *more)
    return above


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, then the columns of ``carry``, leaf, subroot, root and proof of every row of ``docs``.

    ``fields`` are hashed in their order. ``carry`` are expressions over
    ``docs`` that are wanted beside the proof; keep them small, as they move
    with the leaves. A bucket takes ``levels`` levels of the tree.
    """
    spark = docs.sparkSession
    ready_for_python(spark)
    scratch = Scratch(spark, "merkle")
    carry = carry or {}
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))  # never null, in the sources' order
    leaves = docs.select(F.col("doc_id"), F.col("source"), tree.alias("tree"), leaf_digest([F.col(f) for f in fields]).alias("digest"), *(c.alias(f"carry_{k}") for k, c in carry.items()))
    leaves = scratch.keep(leaves, "leaves")
    trees = _climb(placed(leaves, ["tree"], ["doc_id", "digest"], scratch, "placed"), scratch, "level", levels)
    subroots = scratch.keep(trees[-1].select(F.col("tree").alias("of"), "digest"), "subroots")
    tops = placed(subroots, [], ["of"], scratch, "sources").withColumn("tree", F.lit("all"))
    top = _climb(tops, scratch, "top", levels)
    root = top[-1].select("tree", F.array().cast(PROOF).alias("proof"), F.col("digest").alias("root"))  # one row
    of_sources = _descend(top, root, scratch, "above", levels).select(F.col("of").alias("tree"), "proof", "root", F.col("digest").alias("subroot"))
    found = _descend(trees, scratch.keep(of_sources, "of-sources"), scratch, "down", levels)
    return found.select("doc_id", "source", *(F.col(f"carry_{k}").alias(k) for k in carry), F.col("digest").alias("leaf"), "subroot", "root", "proof")

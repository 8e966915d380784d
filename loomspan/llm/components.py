"""Connected components by alternating large-star and small-star steps.

Every step keeps the components and moves edges towards the smallest node;
when neither step changes anything, each node's edge leads to the smallest of
its component. Steps are aggregations with partial sums and joins, so a node
with many edges is split like any skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node of its own to one that leads nowhere."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or (out = 1 and into > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b longs; loops do nothing)."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    step = 0
    while not _settled(now):
        step += 1
        now = scratch.keep(_small(_large(now)), f"{name}-{step}")
        if step > 1:
            scratch.drop(f"{name}-{step - 1}")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())

"""Query op11: the prefix trie of conversations that begin like others of their twenty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .digests import joined_sha256
from .scratch import Scratch
from .trie import meet, placed_turns, prefix_trie

#: Conversations that share their first turns, and the number of shared turns below which each draws its own.
FAMILY, MOST = 20, 4


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sequences and conversations: each has the first h turns of its family's first, then its own after as many; ``turns`` as from ``placed_turns``."""
    own = scratch.keep(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    lead = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("lead"))
    h = F.when(F.col("conv_id") % FAMILY == 0, F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string")) % MOST).cast("bigint")  # the first of a family is itself again
    shared = own.withColumns({"base": base, "h": h}).join(lead, "base", "left").withColumn("lead", F.coalesce(F.slice("lead", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<place: bigint, digest: binary, words: bigint>>")))
    k, rest = F.size("lead").cast("bigint"), F.greatest(F.col("n") - F.col("h"), F.lit(0))
    shared = scratch.keep(shared.select("conv_id", "n", "h", "lead", k.alias("k"), (k + rest).alias("total")), "shared")
    rows = own.agg(F.sum("n")).head()[0] or 0
    later = meet(turns, shared.select("conv_id", "n", "h", "k"), ["conv_id"], "n", rows).where("place >= h")
    sequences = later.select("conv_id", (F.col("place") - F.col("h") + F.col("k") + 1).alias("depth"), "digest", "words", (F.col("place") == F.col("n") - 1).alias("last"))
    led = shared.where("k > 0").select("conv_id", "k", "total", F.explode("lead").alias("t"))
    led = led.select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.digest", "t.words", (F.col("t.place") + 1 == F.col("total")).alias("last"))
    return sequences.unionByName(led), shared.select("conv_id", "total")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "prefix-trie")
    turns = placed_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), scratch)
    sequences, conversations = rebuilt(turns, scratch)
    trie = prefix_trie(sequences, conversations, scratch)
    ends = scratch.keep(trie.ends.select(F.col("conv_id").alias("a"), F.col("depth").alias("b"), F.col("member").alias("value")), "ends")
    digests = joined_sha256(ends, scratch, "pieces").select(F.col("a").alias("conv_id"), F.col("b").alias("depth"), "sha256")
    found = trie.nodes.join(digests.hint("merge"), ["conv_id", "depth"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
SQL = {
    "op11_prefix_trie": r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM turns
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), [8::BIGINT, 7, 6, 5, 4, 3, 2, 1]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM (SELECT DISTINCT conv_id FROM turns)
), drawn AS (
  SELECT conv_id, base, (4294967295 - crc) % 4 AS h FROM convs
), joined AS (
  SELECT d.conv_id, 0 AS part, p.place, p.digest, p.words FROM drawn d JOIN placed p ON p.conv_id = d.base AND p.place <= d.h
  UNION ALL
  SELECT d.conv_id, 1, p.place, p.digest, p.words FROM drawn d JOIN placed p ON p.conv_id = d.conv_id AND p.place > d.h
), rebuilt AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM joined
), chained AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS node_key, 0::BIGINT AS words FROM drawn
  UNION ALL
  SELECT c.conv_id, r.depth, sha256(c.node_key || r.digest), r.words FROM chained c JOIN rebuilt r ON r.conv_id = c.conv_id AND r.depth = c.depth + 1
), nodes AS (
  SELECT depth, node_key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM chained GROUP BY depth, node_key
), members AS (
  SELECT c.conv_id AS member, n.* FROM chained c JOIN nodes n ON n.depth = c.depth AND n.node_key = c.node_key
), edges AS (
  SELECT DISTINCT a.conv_id AS parent, b.conv_id, b.depth FROM members a JOIN members b ON a.member = b.member AND b.depth = a.depth + 1
), kids AS (
  SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM edges GROUP BY ALL
), counted AS (
  SELECT n.*, e.parent, coalesce(k.n_children, 0)::BIGINT AS n_children FROM nodes n LEFT JOIN kids k USING (conv_id, depth) LEFT JOIN edges e USING (conv_id, depth)
), below AS (
  -- a node's path to the root is that of its smallest member
  SELECT m.conv_id, m.depth, sum(c.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves FROM counted c JOIN members m ON m.member = c.conv_id AND m.depth <= c.depth GROUP BY ALL
), ended AS (
  SELECT m.conv_id, m.depth, string_agg(m.member::VARCHAR, ',' ORDER BY m.member) AS ids FROM members m JOIN (SELECT conv_id, max(depth) AS depth FROM chained GROUP BY conv_id) l ON l.conv_id = m.member AND l.depth = m.depth GROUP BY ALL
)
SELECT conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM counted JOIN below USING (conv_id, depth) LEFT JOIN ended USING (conv_id, depth)
""",
}

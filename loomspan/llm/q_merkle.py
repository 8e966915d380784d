"""Query op12: every row of documents as a leaf, its proof, and the root folded from what tampering left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merkle import FIELDS, fold, leaf_digest, manifest, proof_digests


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, carry={"given": leaf_digest([cut if f == "text" else F.col(f) for f in FIELDS])})
    folded = found.withColumn("folded_root", fold(F.col("given"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_digests(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
SQL = {
    "op12_merkle_manifest": r"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                     lambda crc, c: list_reduce(list_prepend(xor(crc, c), [8::BIGINT, 7, 6, 5, 4, 3, 2, 1]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         -- the checksum is the complement of crc: even where crc is odd
         CASE WHEN crc % 2 = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row_id FROM leaves
), nodes AS (
  SELECT 0 AS level, source, place, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT level + 1, source, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY level, source, place // 3, n
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, place // 3, n
), steps AS (
  SELECT a.level, a.source, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
  FROM nodes a JOIN nodes b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL
), top_steps AS (
  SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
  FROM tops a JOIN tops b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL
), folded AS (
  SELECT row_id, source, 0 AS level, place, coalesce(tampered, leaf) AS digest, '' AS proof FROM placed
  UNION ALL
  SELECT f.row_id, f.source, f.level + 1, f.place // 3, sha256(s.before || f.digest || s.after), f.proof || s.before || s.after
  FROM folded f JOIN steps s ON s.level = f.level AND s.source IS NOT DISTINCT FROM f.source AND s.place = f.place
), at_subroot AS (
  SELECT row_id, source, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM folded GROUP BY row_id, source
), top_folded AS (
  SELECT f.row_id, 0 AS level, s.place, f.digest, f.proof FROM at_subroot f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source
  UNION ALL
  SELECT f.row_id, f.level + 1, f.place // 3, sha256(s.before || f.digest || s.after), f.proof || s.before || s.after FROM top_folded f JOIN top_steps s ON s.level = f.level AND s.place = f.place
), ended AS (
  SELECT row_id, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM top_folded GROUP BY row_id
)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = r.digest AS verified
FROM placed p JOIN ended e USING (row_id) JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN (SELECT digest FROM tops WHERE n = 1) r
""",
}

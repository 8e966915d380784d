"""Query op5: repeated lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .linededup import dedup_report


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)
), holders AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (h.key IS NOT NULL AND l.doc_id > h.first) AS gone
  FROM lines l LEFT JOIN holders h ON l.key = h.key AND length(l.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}

"""Query op4: all documents mixed by mean weights 1, 2, 3 in turn over their sources, rising and falling in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import plan


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", F.floor(F.col("position") * 1e6).alias("position_ppm"))


QUERIES = {"op4_source_mix": op4_source_mix}
SQL = {
    "op4_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS draw FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         CASE WHEN (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 2 = 0 THEN 0.5 ELSE -0.5 END::DOUBLE AS lean, 3 * source_size AS cap FROM totals
), ranked AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM weighted
), marked AS (
  SELECT *, (total - before)::DOUBLE * weight > cap::DOUBLE * after AS capped FROM ranked
), rest AS (
  SELECT before AS rest_before, after AS rest_after FROM marked WHERE NOT capped ORDER BY place LIMIT 1
), goals AS (
  SELECT source, source_size, weight, weight * (1 - lean) AS w0, weight * (1 + lean) AS w1, CASE WHEN capped THEN cap::DOUBLE ELSE (total - rest_before)::DOUBLE * weight / rest_after END AS target FROM marked LEFT JOIN rest ON true
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.weight, g.w0, g.w1, g.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, round(target)::BIGINT - ahead)) + greatest(0, least(size, round(target)::BIGINT - ahead - source_size))
        + greatest(0, least(size, round(target)::BIGINT - ahead - 2 * source_size)))::BIGINT AS taken,
       -- the position of the first round: the integral w0 t + (w1 - w0) t^2 / 2 of the schedule reaches x
       CASE WHEN ahead <= target THEN floor(coalesce(2 * x / nullif(w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * x), 0), 0) * 1e6)::BIGINT END AS position_ppm
FROM (SELECT *, CASE WHEN target > 0 THEN least(ahead::DOUBLE / target * weight, weight) ELSE 0 END AS x FROM placed)
""",
}

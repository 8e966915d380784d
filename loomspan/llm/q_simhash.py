"""Query op6: fingerprints of every text of documents, of its edited text, and their likeness; of every hundredth doc_id also the near ones among all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .simhash import fingerprint_report


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), F.col("doc_id") % 100 == 0)


QUERIES = {"op6_fingerprints": op6_fingerprints}
SQL: dict[str, str] = {}

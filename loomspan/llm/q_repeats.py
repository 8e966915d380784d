"""Query op10: every passage of at least 50 words that another document holds too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .repeats import repeated_passages


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op10_suffix_repeats": op10_suffix_repeats}
SQL: dict[str, str] = {}

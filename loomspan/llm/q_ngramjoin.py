"""Query op1: components of documents that share four fifths of their five-word runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ngramjoin import link_components


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
SQL: dict[str, str] = {}

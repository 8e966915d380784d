"""Query op8: quality of every text of documents, learned from the labels that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import Model, fit, score


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def production_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Fitted on labels that aren't held out."""
    return fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = production_model(spark, docs, sf_dir)
    return score(docs, model, F.coalesce(held_out(), F.lit(False)).alias("held_out"))


QUERIES = {"op8_quality_crf": op8_quality_crf}
SQL: dict[str, str] = {}

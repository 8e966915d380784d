"""Query op3: the language of every text of documents, learned from the rows that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import fit, predict


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs.where(~held))
    return predict(docs, model, F.coalesce(held, F.lit(False)).alias("held_out"))


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}

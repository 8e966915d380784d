"""Query op9: the 20 nearest embeddings of every twentieth one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(table, F.col("vec_id") % 20 == 0)


QUERIES = {"op9_nearest": op9_nearest}
SQL: dict[str, str] = {}

"""Intermediate tables of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """Frames written as Parquet and read back, so that lineage stays short and survives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="loomspan-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.base = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        where = f"{self.base}/{name}"
        frame.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(frame.schema).parquet(where)

    def placed(self, frame: DataFrame, name: str, *order: Column | str) -> DataFrame:
        """``frame`` and place, from 0, in a total order: sorted by range, each part's offset is the sizes of those before it."""
        rows = self.keep(frame.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), name)
        part = F.shiftright("__at", 33)
        sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
        before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
        offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__offset"))
        place = F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
        return rows.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("place", place).drop("__part", "__at", "__offset")

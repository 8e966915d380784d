"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet into ``spark.checkpoint.dir`` and reading it
back, so a lost executor never costs more than the stage in flight.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Rows an Arrow batch may hold on its way to Python: with texts of some kB, a few MB.
ARROW_ROWS = 1000

#: Compressed bytes that a bucket of a table may have, about.
BUCKET_BYTES = 128 << 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only where Spark runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="loomspan-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def ready_for_python(spark: SparkSession) -> None:
    """Ship the package, and bound the rows of an Arrow batch, as a text may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


class Scratch:
    """Tables of one operator call under the shared folder.

    ``keep`` writes a frame and returns it as read from there; ``drop`` deletes
    tables whose work is done. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        path = self._path(self.base)
        self._fs(path).deleteOnExit(path)

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def keep(self, frame: DataFrame, name: str, *, by: str | None = None) -> DataFrame:
        """``by`` names a column whose values get a folder each, so that a filter on it reads no others."""
        where = f"{self.base}/{name}"
        out = frame.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(where)
        return self.spark.read.schema(frame.schema).parquet(where)

    def bucketed(self, frame: DataFrame, name: str, buckets: int, *by: str) -> str:
        """The name of a table of ``frame``, bucketed and sorted by columns; its files are in this folder."""
        table = f"{name}_{uuid.uuid4().hex}"
        frame.write.option("path", f"{self.base}/{table}").bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
        return table

    def buckets(self, name: str) -> int:
        """Buckets for the rows of a kept table: as many as shuffles have partitions, more where these would be large."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.bytes(name) // BUCKET_BYTES)

    def drop_table(self, table: str) -> None:
        self.spark.sql(f"drop table if exists {table}")
        path = self._path(f"{self.base}/{table}")
        self._fs(path).delete(path, True)

    def bytes(self, name: str) -> int:
        path = self._path(f"{self.base}/{name}")
        return self._fs(path).getContentSummary(path).getLength()

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.base}/{name}")
            self._fs(path).delete(path, True)
        # Shuffle files of frames that are gone are freed only when the driver's collector runs; a drop is a rare, large step.
        self.spark._jvm.System.gc()

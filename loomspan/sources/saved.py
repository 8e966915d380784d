"""Saved pages and sitemaps as a data source, and a chain of handlers tried row by row.

``frame.write.format("saved_pages")`` writes each row's last column as a file
of its own, below a folder for each other column's value; tasks put at most
``FILES`` files into one ``part`` of a ``task`` folder. A part is what one task
reads back, so the driver knows tasks and parts but no page, and a hot domain is
read by many tasks. Folders of attempts that failed are removed when the others
are committed, and so is what an overwritten path held. Folders not below
``task=``, such as those Spark's own writer makes, are read by one task each.
``handled`` gives each row to the first handler whose condition it meets, as
column expressions; the rest go to the generic reader, so that only these are
parsed as pages.
"""

from __future__ import annotations

import re
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators import pages
from ..session import ship

#: Files that one task reads, and bytes of their text in an Arrow batch.
FILES, BATCH = 500, 1 << 20
SCHEMA = "domain string, file string, html string"
#: Stands for null and for no characters in a folder's name, as in Spark's own.
NOTHING = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _opened(path: str):
    """The store that Arrow opens for a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and "://" not in path:
        path = path.replace("file:/", "file:///", 1)
    path = re.sub(r"^s3[an]://", "s3://", path)
    store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store, root.rstrip("/")


def _listed(store, path: str, recursive: bool = False, missing: bool = False) -> list:
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(path, recursive=recursive, allow_not_found=missing))
    return sorted((x for x in found if not x.base_name.startswith(("_", "."))), key=lambda x: x.path)


def _remove(store, found, tries: int = 5) -> None:
    """A killed attempt may still write into its folder for a moment; it makes no folder anew once that is gone."""
    for i in range(tries):
        try:
            return store.delete_file(found.path) if found.is_file else store.delete_dir(found.path)
        except FileNotFoundError:
            return None
        except OSError:
            if i + 1 == tries:
                raise
            time.sleep(1)


@dataclass
class Folder(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    folder: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Folder]:
        store, root = _opened(self.path)
        tops = [x for x in _listed(store, root) if not x.is_file]
        return [Folder(x.path) for top in tops for x in (_listed(store, top.path) if top.base_name.startswith("task=") else [top])]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder
            return
        store, root = _opened(self.path)
        rows, size = [], 0
        for x in _listed(store, partition.path, recursive=True):
            names = dict(p.split("=", 1) for p in x.path.removeprefix(root).split("/") if "=" in p)
            if x.is_file and {"domain", "file"} <= names.keys():
                domain, file = (None if names[k] == NOTHING else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), names[k]) for k in ("domain", "file"))
                with store.open_input_stream(x.path) as f:
                    rows.append((domain, file, f.read().decode("utf-8", "replace").removesuffix("\n")))
                size += x.size
                if size >= BATCH:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in zip(*rows, strict=True)], ["domain", "file", "html"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.job = path, names, overwrite, f"j{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        context = TaskContext.get()
        folder = f"task={self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        n, part, made, copies = 0, "", set(), Counter()
        for batch in iterator:
            for *values, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n % FILES == 0:
                    part, made, copies = f"{root}/{folder}/part={n // FILES}", set(), Counter()
                    store.create_dir(part, recursive=n == 0)
                where = part
                for name, value in zip(self.names, values, strict=True):
                    where += f"/{name}=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", str(value)) if value not in (None, "") else NOTHING)
                    if where not in made:
                        store.create_dir(where, recursive=False)
                        made.add(where)
                copies[where] += 1
                with store.open_output_stream(f"{where}/{copies[where]}.txt") as f:
                    f.write(text if isinstance(text, bytes) else (text or "").encode())
                    f.write(b"\n")
                n += 1
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        kept = {m.folder for m in messages if m}
        for x in _listed(store, root):
            if x.base_name not in kept and (self.overwrite or self.job in x.base_name):
                _remove(store, x)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        for x in _listed(store, root, missing=True):
            if self.job in x.base_name:
                _remove(store, x)


class SavedPages(DataSource):
    """Option: path, the folder that pages are written to and read from (any store that Arrow opens)."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema.fieldNames()[:-1], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SavedPages)


def located(spark: SparkSession, path: str) -> str:
    """``path`` with Spark's default store where it names none; Arrow would take the local disk."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()


def save(frame: DataFrame, path: str) -> None:
    """``frame`` as files in ``path``, which is overwritten: the last column's text, in folders named by the columns before it."""
    register(frame.sparkSession)
    pages._ready(frame)
    *names, text = frame.columns
    frame.select(*names, F.col(text).cast("binary").alias(text)).write.format("saved_pages").mode("overwrite").save(located(frame.sparkSession, path))


@dataclass(frozen=True)
class Handler:
    """``applies`` decides by columns of a row; ``read`` gives its title and content."""

    name: str
    applies: Callable[[], Column]
    read: Callable[[], tuple[Column, Column]]


def handled(rows: DataFrame, handlers: list[Handler], fmt: str = "text") -> DataFrame:
    """``rows`` (url, html, others) with handler, title and content: of the first handler that applies, else of the reader of pages."""
    mine = F.coalesce(*(F.when(h.applies(), F.lit(h.name)) for h in handlers), F.lit("page"))
    marked = rows.withColumn("handler", mine)
    title, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h in handlers:
        t, c = h.read()
        title, content = F.when(F.col("handler") == h.name, t).otherwise(title), F.when(F.col("handler") == h.name, c).otherwise(content)
    marked = marked.withColumns({"__title": title, "__content": content, "html": F.when(F.col("handler") == "page", F.col("html"))})
    read = pages.read_pages(marked, fmt, info=("title",))
    own = F.col("handler") != "page"
    return read.withColumns({"title": F.when(own, F.col("__title")).otherwise(F.col("title")), "content": F.when(own, F.col("__content")).otherwise(F.col("content"))}).drop("__title", "__content", "h1", "note", "length")

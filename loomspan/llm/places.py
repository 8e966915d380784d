"""Places of rows within groups, where one group may hold most of the rows.

Rows are range-sorted by group and order, so that a large group spreads over
many partitions. Each partition numbers its own rows while they stream by; a
group that an earlier partition began gets the earlier rows' number added. At
most one group continues into a partition, so these additions are at most one
row for each partition and can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, ready_for_python
from .shingles import tidy


def run_starts(keys: list[pa.Array]) -> np.ndarray:
    """Where a row's keys differ from those of the row before (the first row not counted); nulls are equal."""
    n = len(keys[0]) if keys else 0
    new = np.zeros(n, bool)
    for k in keys:
        a, b = k.slice(1), k.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
    return new


def _local(batches: Iterator[pa.RecordBatch], groups: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds block (the partition's number), local (place within the group and partition) and first (the partition's first group)."""
    block, last, before, runs = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(b.schema.get_field_index(g)) for g in groups]
        new, own = run_starts(keys) if keys else np.zeros(b.num_rows, bool), tuple(k[0].as_py() for k in keys)
        if last is not None and own != last:
            before, runs = 0, runs + 1
        index = np.arange(b.num_rows)
        start = np.maximum.accumulate(np.where(new, index, 0))
        local, first = index - start + np.where(start == 0, before, 0), np.cumsum(new) + runs == 0
        last, before, runs = tuple(k[-1].as_py() for k in keys), int(local[-1]) + 1, runs + int(new.sum())
        columns = [*b.columns, pa.array(np.full(b.num_rows, block, np.int64)), pa.array(local.astype(np.int64)), pa.array(first)]
        yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "__block", "__local", "__first"])


def placed(rows: DataFrame, groups: list[str], order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``place``: 0, 1, ... within each group in ascending order (nulls first), kept in the shared folder.

    Rows that ``order`` does not tell apart stand in any order. ``rows`` is
    read twice (Spark samples it for the ranges), so it should be a kept table.
    """
    ready_for_python(rows.sparkSession)
    salted = rows.withColumn("__salt", F.monotonically_increasing_id())  # rows alike in all else still spread
    keys = [*groups, *order, "__salt"]
    sorted_rows = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__salt")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    local = scratch.keep(sorted_rows.mapInArrow(tidy(lambda b: _local(b, groups)), f"{kinds}, __block bigint, __local bigint, __first boolean"), name)
    pair = [*groups, "__block"]
    # A group that goes on: the first of its partition, though another partition holds some of it, too.
    begun = local.where("__first and __local = 0").select(*(F.col(g).alias(f"__{g}") for g in groups)).distinct() if groups else None  # a row for each partition at most
    alike = F.lit(True)
    for g in groups:
        alike &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    sizes = (local.join(F.broadcast(begun), alike, "left_semi") if groups else local).groupBy(*pair).agg(F.count("*").alias("__rows"))
    earlier = Window.partitionBy(*groups).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of such a group
    offsets = sizes.select(*(F.col(g).alias(f"__{g}") for g in groups), F.col("__block").alias("__at"), F.sum("__rows").over(earlier).alias("__before")).where("__before > 0")
    out = local.join(F.broadcast(scratch.keep(offsets, f"{name}-offsets")), alike & (F.col("__block") == F.col("__at")), "left")
    return out.select(*rows.columns, (F.col("__local") + F.coalesce("__before", F.lit(0))).alias("place"))

"""Keyed limits and deduplication on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def limit_stream(events: DataFrame, limit: int, seconds: float, *, key: str = "user_id") -> DataFrame:
    """A stream of events (key, event_id, ts) with allowed: the rule of ``keyed.rate_limit``, with a key's window start and count as state."""
    schema = f"{key} {events.schema[key].dataType.simpleString()}, event_id bigint, allowed boolean"

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"].astype("int64") / 1e9 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].map(lambda x: x.timestamp()):
            if start is None or t - start >= seconds:
                start, count = float(t), 0
            count += 1
            allowed.append(count <= limit)
        state.update((start, count))
        yield pd.DataFrame({key: name[0], "event_id": rows["event_id"], "allowed": allowed})

    picked = events.select(key, F.col("event_id").cast("bigint").alias("event_id"), "ts")
    return picked.groupBy(key).applyInPandasWithState(fold, schema, "start double, count bigint", "append", GroupStateTimeout.NoTimeout)


def dedup_stream(pages: DataFrame, *, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream of pages (url, ts) once for each url within the delay; the memory is bounded by time, not by a count."""
    return pages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url"])

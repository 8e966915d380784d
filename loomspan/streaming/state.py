"""Health and blocking by key on streams, with timers and expiring state; crawls of seeds as they come.

State is in the store that Spark checkpoints, so a restart goes on where it
stopped: rows that came before are not counted again. Rows of a key must come
in order of time over batches; within a batch they are sorted. The results are
those of ``keyed.health_with_cooldown`` and ``keyed.blocked`` on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.crawl import CrawlConfig, crawl

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Timers and expiring state need the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Health(StatefulProcessor):
    """Failures and attempts of a key, and since when it is out of use. A timer forgets a key whose cooldown is over."""

    def __init__(self, cooldown: float, least: int, threshold: float):
        self.cooldown, self.least, self.threshold = cooldown, least, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", "failures long, total long, since double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures, total, since = self.state.get() if self.state.exists() else (0, 0, None)
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        active, off = [], []
        for t, ok in zip(batch["ts"], batch["ok"]):
            if since is not None and t - since >= self.cooldown:
                failures, total, since = 0, 0, None
            active.append(since is None)
            if since is None:
                total, failures = total + 1, failures + (not ok)
                if not ok and total >= self.least and failures > total * self.threshold:
                    since = float(t)
            off.append(active[-1] and since is not None)
        self.state.update((int(failures), int(total), since))
        if since is not None:
            self.handle.registerTimer(int((since + self.cooldown) * 1000))
        yield pd.DataFrame({"key": [key[0]] * len(batch), "seq": batch["seq"], "active": active, "deactivates": off})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            since = self.state.get()[2]
            if since is not None and int((since + self.cooldown) * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "active": pd.Series(dtype="bool"), "deactivates": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def health_stream(attempts: DataFrame, cooldown: float, *, least: int = 3, threshold: float = 0.5, late: str = "0 seconds") -> DataFrame:
    """A stream of attempts (key long, seq long, at timestamp, ok) with active and deactivates; times are event times."""
    use_state(attempts.sparkSession)
    rows = attempts.withWatermark("at", late).select("key", "seq", "at", (F.unix_micros("at") / 1e6).alias("ts"), "ok")
    return rows.groupBy("key").transformWithStateInPandas(Health(cooldown, least, threshold), "key long, seq long, active boolean, deactivates boolean", "append", "EventTime")


class Blocking(StatefulProcessor):
    """The streak of a key's failures and until when it is held back; a key that nothing is heard of expires."""

    def __init__(self, window: float, cooldown: float, threshold: int, ttl_ms: int):
        self.window, self.cooldown, self.threshold, self.ttl = window, cooldown, threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "n long, last double, until double", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last, until = self.state.get() if self.state.exists() else (0, None, None)
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        held = []
        for t, kind in zip(batch["ts"], batch["kind"]):
            held.append(until is not None and t < until)
            if kind == "ok":
                n, last, until = 0, None, None
            elif kind == "fail":
                n = 1 if last is None or t - last > self.window else n + 1
                last, until = float(t), float(t) + self.cooldown if n >= self.threshold else None
        self.state.update((int(n), last, until))
        yield pd.DataFrame({"key": [key[0]] * len(batch), "seq": batch["seq"], "blocked": held})

    def close(self) -> None:
        pass


def blocked_stream(events: DataFrame, *, window: float, cooldown: float, threshold: int, ttl_ms: int = 86_400_000) -> DataFrame:
    """A stream of events (key long, seq long, ts double, kind: fail, ok or ask) with blocked; state of a key expires ``ttl_ms`` after it was last heard of (by the clock)."""
    use_state(events.sparkSession)
    rows = events.select("key", "seq", "ts", "kind")
    return rows.groupBy("key").transformWithStateInPandas(Blocking(window, cooldown, threshold, ttl_ms), "key long, seq long, blocked boolean", "append", "ProcessingTime")


def crawl_stream(seeds: DataFrame, store: DataFrame, path: str, config: CrawlConfig = CrawlConfig()):
    """A writer (start it) that crawls each batch of a stream of seeds (url) and puts its rows under ``path``/batch=<number>; a batch that is done again replaces its rows."""

    def one(batch: DataFrame, number: int) -> None:
        crawl(batch.sparkSession, batch.select("url"), store, config=config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return seeds.writeStream.foreachBatch(one)

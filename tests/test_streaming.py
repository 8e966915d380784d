import os
import random
import time

import pytest

from loomspan.operators import keyed
from loomspan.streaming.limits import dedup_stream, limit_stream
from loomspan.streaming.state import blocked_stream, crawl_stream, health_stream


def run(query_frame, tmp_path, name, mode="append"):
    q = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q.sparkSession.table(name) if hasattr(q, "sparkSession") else None


@pytest.fixture
def events(spark, tmp_path):
    folder = os.path.join(tmp_path, "in")
    rows = [(1, i, float(t)) for i, t in enumerate([0, 1, 2, 9, 10, 11, 12, 21])] + [(2, 100, 5.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, t double").selectExpr("user_id", "event_id", "timestamp_millis(cast(t * 1000 as bigint)) as ts", "concat('u', user_id) as url").write.parquet(folder)
    return spark.readStream.schema("user_id long, event_id long, ts timestamp, url string").parquet(folder)


def test_limit_stream(spark, events, tmp_path):
    run(limit_stream(events, 2, 10.0), tmp_path, "limited")
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    assert [got[i] for i in range(8)] == [True, True, False, False, True, True, False, True] and got[100]


def test_dedup_stream(spark, events, tmp_path):
    run(dedup_stream(events), tmp_path, "deduped")
    assert sorted(r.url for r in spark.table("deduped").collect()) == ["u1", "u2"]


def restarted(spark, tmp_path, rows, schema, stream, name):
    """Rows of a stream over files that come one by one, with a restart from the checkpoint between any two."""
    folder, out = f"{tmp_path}/{name}", f"{tmp_path}/{name}-out"
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # a checkpoint keeps the number it began with
    for i in range(2):
        part = rows[i * len(rows) // 2 : (i + 1) * len(rows) // 2]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        frame = stream(spark.readStream.schema(schema).parquet(folder))
        q = frame.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").start()
        began = time.time()
        while sum(p["numInputRows"] for p in q.recentProgress) < len(part) and time.time() - began < 100 and q.isActive:
            time.sleep(0.2)
        q.stop()  # state that expires by the clock keeps a query running
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    return spark.read.parquet(out).collect()


def test_health_goes_on_after_restarts(spark, tmp_path):
    draw = random.Random(9)
    rows = [(draw.randrange(4), i, 1000.0 + i * 10, draw.random() < 0.4) for i in range(240)]
    schema = "key long, seq long, ts double, ok boolean"
    timed = lambda f: health_stream(f.selectExpr("key", "seq", "timestamp_micros(cast(ts * 1e6 as bigint)) as at", "ok"), 150.0)
    got = sorted((r.key, r.seq, r.active, r.deactivates) for r in restarted(spark, tmp_path, rows, schema, timed, "health"))
    batch = keyed.health_with_cooldown(spark.createDataFrame(rows, schema), 150.0, key="key", seq="seq")
    assert got == sorted((r.key, r.seq, r.active, r.deactivates) for r in batch.collect()) and any(r[3] for r in got)


def test_blocking_goes_on_after_restarts(spark, tmp_path):
    draw = random.Random(10)
    rows = [(draw.randrange(3), i, float(i), draw.choice(["fail", "fail", "ask", "ok"] if i % 20 < 3 else ["fail", "ask"])) for i in range(200)]
    schema = "key long, seq long, ts double, kind string"
    rule = {"window": 6.0, "cooldown": 9.0, "threshold": 3}
    got = sorted((r.key, r.seq, r.blocked) for r in restarted(spark, tmp_path, rows, schema, lambda f: blocked_stream(f, **rule), "blocked"))
    batch = keyed.blocked(spark.createDataFrame(rows, schema), **rule)
    assert got == sorted((r.key, r.seq, r.blocked) for r in batch.collect()) and len({r[2] for r in got}) == 2


def test_crawls_of_seeds_as_they_come(spark, tmp_path):
    store = spark.createDataFrame([("https://a.x/", '<a href="/b">b</a>'), ("https://a.x/b", "<p>b</p>"), ("https://c.x/", "<p>c</p>")], "url string, html string")
    for i, url in enumerate(("https://a.x/", "https://c.x/")):
        spark.createDataFrame([(url,)], "url string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/seeds")
        q = crawl_stream(spark.readStream.schema("url string").parquet(f"{tmp_path}/seeds"), store, f"{tmp_path}/crawled").option("checkpointLocation", f"{tmp_path}/crawl-cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = sorted((r.batch, r.url, r.depth) for r in spark.read.parquet(f"{tmp_path}/crawled").collect())
    assert got == [(0, "https://a.x/", 0), (0, "https://a.x/b", 1), (1, "https://c.x/", 0)]

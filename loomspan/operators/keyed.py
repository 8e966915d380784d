"""State by key: rate limits, health, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Store

IDEMPOTENT = ("GET", "HEAD", "OPTIONS", "PUT", "DELETE", "TRACE")
RETRYABLE = (429, 500, 502, 503, 504)


#: Rows of a block: what one task's fold holds at a time.
BLOCK = 262_144


def _leave(table):
    """Where the chain from each place of a block leaves the block, by doubling its steps."""
    import numpy as np

    rows = table.sort_by("place")
    places, after = rows.column("place").to_numpy(), rows.column("after").to_numpy()
    base, end = places[0], places[-1] + 1
    while (inside := after < end).any():
        after = np.where(inside, after[np.where(inside, after - base, 0)], after)
    return rows.set_column(rows.schema.get_field_index("leaves"), "leaves", [after])


def _starts(table):
    """The last window's start at or before each place of a block (-1: before the block)."""
    import numpy as np

    rows = table.sort_by("place")
    places, after = rows.column("place").to_numpy(), rows.column("after").to_numpy()
    base, end, at = places[0], places[-1] + 1, rows.column("entry")[0].as_py()
    start = np.full(len(places), -1, np.int64)
    while at is not None and at < end:
        start[at - base] = at
        at = int(after[at - base])
    return rows.set_column(rows.schema.get_field_index("start"), "start", [np.maximum.accumulate(start)])


def _entered(files: Store, steps: DataFrame, blocks: int, block: int) -> DataFrame:
    """``steps`` (place, after, block) with entry: where the chain from place 0 enters each block, null where it passes by."""
    steps = files.keep(steps.withColumn("leaves", F.col("after")).groupBy("block").applyInArrow(_leave, "place bigint, after bigint, block bigint, leaves bigint"), "left")
    first = steps.where("place = 0").select("place", "leaves")
    ends = steps.select(F.col("leaves").alias("place")).distinct()
    jumps = files.keep(steps.join(ends, "place", "left_semi").select("place", "leaves").unionByName(first).distinct(), "jumps")
    reached = files.keep(first.select("place"), "reached")
    for i in range((blocks - 1).bit_length()):
        on = reached.join(jumps, "place").select(F.col("leaves").alias("place"))
        reached = files.keep(reached.unionByName(on).distinct(), f"reached{i}")
        far = jumps.select(F.col("place").alias("from"), F.col("leaves").alias("place"))
        jumps = files.keep(far.join(jumps, "place").select(F.col("from").alias("place"), "leaves"), f"jumps{i}")
    entries = reached.groupBy(F.floor(F.col("place") / block).alias("block")).agg(F.min("place").alias("entry"))
    return steps.join(entries, "block", "left")


def rate_limit(events: DataFrame, limit: int, seconds: float, *, key: str = "user_id", ts: str = "ts", seq: str = "event_id", block: int = BLOCK) -> DataFrame:
    """``key``, ``seq`` and allowed of ``events``: at most ``limit`` in a window that a key's first request opens; refused requests count too.

    The request that opens the next window is the first one at least
    ``seconds`` later, or the next key's first: one chain through all requests
    in order of key and time. Two range sorts give every request's step; blocks
    of places shorten steps to those that leave them, and doubling over what
    blocks are left for finds where the chain enters each. So a hot key is
    many tasks, and no task holds more than a block.

    Defined results: requests without a time are neither allowed nor counted
    (null); a null key is a key; ties are ordered by ``seq``.
    """
    files = Store(events.sparkSession, "limit")
    kind = events.schema[ts].dataType.typeName()
    time, span = (F.unix_micros(F.col(ts).cast("timestamp")), F.lit(round(seconds * 1e6))) if kind.startswith("timestamp") else (F.col(ts), F.lit(seconds))
    asked = events.select(key, time.alias("__t"), F.col(seq).cast("bigint").alias(seq))
    rows = files.placed(asked.where("__t is not null"), "requests", key, "__t", seq)
    # Before a probe of time + seconds stand its place in probes and the requests that come too soon.
    probes = rows.select(key, (F.col("__t") + span).alias("__t"), F.lit(0).alias("__is"), F.col("place").alias("__of"))
    both = probes.unionByName(rows.select(key, "__t", F.lit(1).alias("__is"), F.col("place").alias("__of")))
    steps = files.placed(both, "steps", key, "__t", "__is", "__of").where("__is = 0").select("__of", (F.col("place") - F.col("__of")).alias("after"), F.floor(F.col("__of") / block).alias("block"))
    steps = steps.withColumnRenamed("__of", "place")
    blocks = (rows.agg(F.max("place")).head()[0] or 0) // block + 1
    entered = steps.withColumn("entry", F.lit(0).cast("bigint")) if blocks == 1 else _entered(files, steps, blocks, block)
    opened = entered.select("place", "after", "block", "entry", F.col("place").alias("start")).groupBy("block").applyInArrow(_starts, "place bigint, after bigint, block bigint, entry bigint, start bigint")
    opened = files.keep(opened.select("place", "block", "start"), "opened")
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    carried = opened.groupBy("block").agg(F.max("start").alias("__last")).select("block", F.max("__last").over(earlier).alias("__before"))
    known = opened.join(carried, "block").select("place", (F.col("place") - F.when(F.col("start") >= 0, F.col("start")).otherwise(F.col("__before")) < limit).alias("allowed"))
    found = rows.join(known, "place").select(key, seq, "allowed")
    return found.unionByName(asked.where("__t is null").select(key, seq, F.lit(None).cast("boolean").alias("allowed")))


def delay_rule(name: Column, rules: list[tuple[str, int]]) -> Column:
    """The first rule that fits a host: its name, ``*.suffix`` (names below it only), or an empty one for all. Gives its number."""
    out = F.lit(None).cast("int")
    for pattern, number in reversed(rules):
        fits = F.lit(True) if not pattern else F.endswith(name, F.lit(pattern[1:])) if pattern.startswith("*.") else name == pattern
        out = F.when(fits, F.lit(number)).otherwise(out)
    return out


def schedule(requests: DataFrame, *, key: str = "domain", ts: str = "ts", seq: str = "seq", delay: str = "delay", until: str = "until", block: int = BLOCK) -> DataFrame:
    """``requests`` with ``start``: when each may begin, in order of time, ``delay`` seconds after the one before of its key, and not before any ``until`` that its key has been told by then.

    start = max(due, start before + delay) is a running maximum of
    due - place * delay, plus place * delay, so it needs no fold: requests are
    placed by a range sort, and maxima are taken in blocks of places with what
    earlier blocks reached carried in. A hot key is many tasks. Each key has
    one delay. A row with an ``until`` is a request that was refused: it is
    scheduled like any other, and its ``until`` holds for those after it.

    Defined results: null delays are 0; rows with a null key or time have a
    null start; ties are ordered by ``seq``.
    """
    files = Store(requests.sparkSession, "schedule")
    told = F.col(until).cast("double") if until in requests.columns else F.lit(None).cast("double")
    rows = requests.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rows = files.placed(rows.withColumns({"__t": F.col(ts).cast("double"), "__until": told, "__delay": F.coalesce(F.col(delay).cast("double"), F.lit(0.0))}), "requests", key, "__t", seq)
    rows = rows.withColumn("__block", F.floor(F.col("place") / block))
    here = Window.partitionBy(key, "__block").orderBy("place")
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a key

    def running(frame: DataFrame, value: Column, upto: int, name: str) -> DataFrame:
        """``frame`` with the maximum of ``value`` over its key's rows so far (``upto`` 0: with its own; -1: without)."""
        kept = files.keep(frame.withColumn("__v", value), name)
        carried = kept.groupBy(key, "__block").agg(F.max("__v").alias("__m")).select(key, "__block", F.max("__m").over(earlier).alias("__before"))
        joined = kept.join(carried.where("__before is not null").hint("merge"), [key, "__block"], "left")
        return joined.withColumn(name, F.greatest(F.max("__v").over(here.rowsBetween(Window.unboundedPreceding, upto)), F.col("__before"))).drop("__v", "__before")

    rows = running(rows, F.col("__until"), -1, "__held")
    due = F.greatest(F.col("__t"), F.col("__held"))
    rows = running(rows, due - F.col("place") * F.col("__delay"), 0, "__reached")
    found = rows.withColumn("start", F.col("__reached") + F.col("place") * F.col("__delay")).select(*requests.columns, "start")
    rest = requests.where(F.col(key).isNull() | F.col(ts).isNull()).withColumn("start", F.lit(None).cast("double"))
    return found.unionByName(rest)


def health(attempts: DataFrame, *, key: str = "user_id", ok: str = "ok", order: str = "event_id", least: int = 3, threshold: float = 0.5) -> DataFrame:
    """``attempts`` and deactivates: a failure at which a key has ``least`` attempts or more and fails above the threshold (no cooldown in between)."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    failures, total = F.sum((~F.col(ok)).cast("int")).over(past), F.count("*").over(past)
    return attempts.withColumns({"failures": failures, "total": total}).withColumn("deactivates", ~F.col(ok) & (F.col("total") >= least) & (F.col("failures") > F.col("total") * threshold))


def health_with_cooldown(attempts: DataFrame, cooldown: float, *, key: str = "user_id", ok: str = "ok", ts: str = "ts", seq: str = "event_id", least: int = 3, threshold: float = 0.5) -> DataFrame:
    """``attempts``' key and seq, whether the key was active (its counts start anew when ``cooldown`` seconds have gone since it was put out of use), and whether the attempt deactivates it.

    Attempts of a key that is out of use count for nothing. The fold over a
    key's attempts carries its counts and the time it was put out of use.
    """
    schema = f"{key} {attempts.schema[key].dataType.simpleString()}, {seq} bigint, active boolean, deactivates boolean"

    def fold(table):
        import pyarrow as pa

        rows = table.sort_by([(ts, "ascending"), (seq, "ascending")])
        failures = total = 0
        since, active, off = None, [], []
        for t, good in zip(rows.column(ts).to_pylist(), rows.column(ok).to_pylist()):
            if since is not None and t - since >= cooldown:
                failures, total, since = 0, 0, None
            active.append(since is None)
            if since is None:
                total += 1
                failures += not good
                if not good and total >= least and failures > total * threshold:
                    since = t
            off.append(active[-1] and since is not None)
        return pa.table({key: rows.column(key), seq: rows.column(seq), "active": pa.array(active, pa.bool_()), "deactivates": pa.array(off, pa.bool_())})

    return attempts.select(key, F.col(ts).cast("double").alias(ts), F.col(seq).cast("bigint").alias(seq), ok).groupBy(key).applyInArrow(fold, schema)


def backoff(attempt: Column, *, base: float = 0.5, cap: float = 10.0, jitter: Column | None = None) -> Column:
    """Seconds before an attempt (from 0), doubling up to the cap; ``jitter`` from -1 to 1 moves it by up to 30 %."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))
    return wait if jitter is None else wait * (F.lit(1.0) + F.lit(0.3) * jitter)


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def idempotent(method: Column) -> Column:
    return F.upper(method).isin(*IDEMPOTENT)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After value: a number, or a date of the web's format; null for neither."""
    date = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(F.trim(value).rlike(r"^\d+$"), F.trim(value).cast("bigint")).when(date.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(date) - F.unix_timestamp(now)))


def deadline(seconds: Column) -> Column:
    return F.least(F.greatest(F.coalesce(seconds, F.lit(8)), F.lit(1)), F.lit(60))


def fetch_outcome(status: Column, challenged: Column, timed_out: Column) -> Column:
    return F.when(timed_out, "timeout").when(challenged, "challenge").when(status == 429, "rate_limited").when(status >= 400, "upstream_error").otherwise("ok")


def cache_reads(events: DataFrame, ttl: float, *, key: str = "key", ts: str = "ts", kind: str = "kind") -> DataFrame:
    """``events`` and hit: a read finds the last write before it if that is younger than ``ttl`` seconds."""
    past = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    written = F.last(F.when(F.col(kind) == "write", F.col(ts)), ignorenulls=True).over(past)
    return events.withColumn("hit", F.when(F.col(kind) == "read", F.coalesce((F.col(ts) - written) < ttl, F.lit(False))))


def _held(ttl: float, capacity: int, key: str, ts: str, kind: str):
    def fold(events, held):
        import pyarrow as pa

        cache = dict(zip(*(held.sort_by("__place").column(c).to_pylist() for c in (key, ts))))
        rows = events.sort_by("place")
        hits: list[bool | None] = []
        for k, t, what in zip(*(rows.column(c).to_pylist() for c in (key, ts, kind))):
            hits.append(k in cache and t is not None and cache[k] is not None and t - cache[k] < ttl if what == "read" else None)
            if what == "write":
                cache.pop(k, None)
                cache[k] = t  # the last in order
                if len(cache) > capacity:
                    del cache[next(iter(cache))]
        return rows.drop_columns(["place", "__block"]).append_column("hit", pa.array(hits, pa.bool_()))

    return fold


def live_until_evicted(events: DataFrame, ttl: float, capacity: int, *, key: str = "key", ts: str = "ts", kind: str = "kind", seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """``cache_reads`` of a cache that holds ``capacity`` keys: a write of a further key pushes out the one written longest ago.

    What the cache holds at any time are the ``capacity`` keys written last.
    That state merges: of two stretches of events each gives its last writes,
    and the latest of them are those of both. So events are cut into blocks in
    order of time, states are carried over them by doubling, and each block is
    folded alone from the state before it: a task holds a block and a state.

    Defined results: a null key is a key; ties are ordered by ``seq``.
    """
    files = Store(events.sparkSession, "evict")
    rows = files.placed(events, "events", ts, seq).withColumn("__block", F.floor(F.col("place") / block))
    latest = Window.partitionBy("__block").orderBy(F.col("__w.place").desc())

    def states(writes: DataFrame, name: str) -> DataFrame:
        last = writes.groupBy("__block", key).agg(F.max("__w").alias("__w"))
        return files.keep(last.withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= capacity).drop("__n"), name)

    state = states(rows.where(F.col(kind) == "write").select("__block", key, F.struct(F.col("place").alias("place"), F.col(ts).alias("ts")).alias("__w")), "state")
    blocks = (rows.agg(F.max("__block")).head()[0] or 0) + 1
    for i in range((blocks - 1).bit_length()):
        on = state.withColumn("__block", F.col("__block") + (1 << i)).where(F.col("__block") < blocks)
        state = states(state.unionByName(on), f"state{i}")
    before = state.select((F.col("__block") + 1).alias("__block"), key, F.col("__w.place").alias("__place"), F.col("__w.ts").alias(ts)).where(F.col("__block") < blocks)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema] + ["hit boolean"])
    return rows.groupBy("__block").cogroup(before.groupBy("__block")).applyInArrow(_held(ttl, capacity, key, ts, kind), schema)


def blocked(events: DataFrame, *, window: float, cooldown: float, threshold: int, key: str = "key", ts: str = "ts", seq: str = "seq", kind: str = "kind") -> DataFrame:
    """``events`` (fail, ok or ask) and blocked: whether a key's failures hold it back at that time, before the event itself.

    A failure more than ``window`` seconds after the last one starts a new
    streak, and so does the first one after a success; from the
    ``threshold``-th failure of a streak on, each blocks for ``cooldown``.
    """
    order = Window.partitionBy(key).orderBy(ts, seq)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fail, time = F.col(kind) == "fail", F.col(ts)
    last_fail, last_ok = F.last(F.when(fail, time), ignorenulls=True).over(before), F.last(F.when(F.col(kind) == "ok", F.col("__n")), ignorenulls=True).over(before)
    last_n = F.last(F.when(fail, F.col("__n")), ignorenulls=True).over(before)
    numbered = events.withColumn("__n", F.row_number().over(order))
    marked = numbered.withColumn("__new", fail & (last_fail.isNull() | (time - last_fail > window) | F.coalesce(last_ok > last_n, F.lit(False))))
    streak = marked.withColumn("__streak", F.sum(F.col("__new").cast("int")).over(order))
    nth = F.sum(fail.cast("int")).over(Window.partitionBy(key, "__streak").orderBy(ts, seq))
    until = streak.withColumn("__until", F.when(fail & (nth >= threshold), time + cooldown)).withColumn("__f", F.when(fail, F.struct(F.col("__n").alias("n"), F.col("__until").alias("until"))))
    held = until.withColumn("__held", F.last("__f", ignorenulls=True).over(before)).withColumn("__ok", F.last(F.when(F.col(kind) == "ok", F.col("__n")), ignorenulls=True).over(before))
    open_again = F.coalesce(F.col("__ok") > F.col("__held.n"), F.lit(False))
    return held.withColumn("blocked", F.coalesce((time < F.col("__held.until")) & ~open_again, F.lit(False))).select(*events.columns, "blocked")

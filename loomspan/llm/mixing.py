"""Mixing sources to target weights along a curriculum.

A source has a weight schedule: knots (time, weight) over the training run,
time from 0 to 1, straight between them. Its demand is the integral of the
schedule, scaled so that the sources' demands at time 1 are their targets:
shares of the total by mean weight, none above ``repeats`` times what the
source holds; what is cut off is shared again by weight until none is above.

A source's documents stand in a fixed random order (MD5 of doc_id and text),
round after round. The words before a document are its offset; the inverse of
the source's cumulative demand turns an offset into a position in training.
Words that have a position are taken; demand never reaches those behind the
target, which have none. Rows are range-sorted by position.

Offsets are prefix sums in two levels: within slices of a source's order, and
over the slices, so that a source that holds most rows is spread over many
tasks; the number of slices follows from the number of rows. Rows alike in
doc_id, text and source are one row there, with their number.

Sources are one row each; only their schedules are made in one task.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, last in order; null doc_ids are told apart by their texts;
rows that repeat doc_id, text and source stand one after the other; a source
without words takes nothing; an empty table gives no rows; extra columns are
ignored (``mix_documents``: kept).
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

REPEATS = 3
#: Rows of a slice, about.
SLICE_ROWS = 1_000_000
WEIGHTS = (1, 2, 3)
#: Weights start that share below (in turn: above) their mean and end as far on the other side.
SLOPE = 0.5


def word_count(text: Column) -> Column:
    """Words of a text, counted as the blanks that end one: no array is built."""
    ended = F.concat(F.coalesce(text, F.lit("")), F.lit(" "))
    return F.regexp_count(ended, F.lit(r"[^\x20\x09-\x0D][\x20\x09-\x0D]")).cast("bigint")


def cycle_schedules(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, slope: float = SLOPE) -> DataFrame:
    """``sources`` (source, source_size) with schedules: mean weights in turn by code point, null last; every other one rises, the others fall."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    lean = F.when(place % 2 == 0, F.lit(float(slope))).otherwise(F.lit(-float(slope)))
    return sources.withColumn("schedule", F.array(F.struct(F.lit(0.0).alias("t"), (weight * (1 - lean)).alias("w")), F.struct(F.lit(1.0).alias("t"), (weight * (1 + lean)).alias("w"))))


def targets(sources: DataFrame, scratch: Scratch, *, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (source, source_size, schedule) with weight (the schedule's integral) and target.

    The free sources share what the capped ones leave; those above their cap
    are capped; and so on until none is above.
    """
    knot = lambda i: F.element_at("schedule", i)
    areas = F.transform(F.sequence(F.lit(1), F.size("schedule") - 1), lambda i: (knot(i + 1)["t"] - knot(i)["t"]) * (knot(i + 1)["w"] + knot(i)["w"]) / 2)
    known = sources.withColumn("weight", F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)).withColumn("cap", F.col("source_size") * F.lit(repeats))
    known = scratch.keep(known, "weights")
    total = known.agg(F.sum("source_size")).head()[0] or 0
    level = capped_size = None  # the words left and the weight that shares them
    while True:
        over = F.lit(False) if level is None else F.lit(float(level[0])) * F.col("weight") > F.col("cap") * F.lit(level[1])
        capped, weight = known.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).head()
        if capped == capped_size:
            break
        capped_size, level = capped, (total - capped, float(weight or 0.0))
        if not weight:
            break
    goal = F.coalesce(F.try_divide(F.lit(float(level[0])) * F.col("weight"), F.lit(level[1])), F.lit(0.0))
    above = F.lit(float(level[0])) * F.col("weight") > F.col("cap") * F.lit(level[1])
    return known.select("source", "source_size", "schedule", "weight", F.when(above, F.col("cap").cast("double")).otherwise(goal).alias("target"))


def position(offset: Column, target: Column, weight: Column, schedule: Column) -> Column:
    """Time at which a source's demand reaches ``offset``: the inverse of its integrated schedule; null where it never does."""
    need = F.coalesce(F.try_divide(offset, target), F.lit(0.0)) * weight
    start = F.struct(F.lit(0.0).alias("done"), F.lit(1.0).alias("t"), F.lit(False).alias("found"))

    def step(acc: Column, i: Column) -> Column:
        a, b = F.element_at(schedule, i), F.element_at(schedule, i + 1)
        span = b["t"] - a["t"]
        area = span * (a["w"] + b["w"]) / 2
        x = F.least(F.greatest(need - acc["done"], F.lit(0.0)), area)
        # x = w s + (slope / 2 span) s^2, solved for s without cancellation
        root = F.sqrt(a["w"] * a["w"] + F.coalesce(F.try_divide(2 * (b["w"] - a["w"]) * x, span), F.lit(0.0)))
        s = F.coalesce(F.try_divide(2 * x, a["w"] + root), F.lit(0.0))
        here = ~acc["found"] & (area > 0) & (need <= acc["done"] + area)
        return F.struct((acc["done"] + area).alias("done"), F.when(here, a["t"] + s).otherwise(acc["t"]).alias("t"), (acc["found"] | here).alias("found"))

    at = F.aggregate(F.sequence(F.lit(1), F.size(schedule) - 1), start, step)["t"]
    return F.when(offset <= target, at)


def draw(docs: DataFrame) -> Column:
    """The place of a document in its source's order."""
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("bigint").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(docs["text"], F.lit(""))))


def _sized(docs: DataFrame) -> DataFrame:
    """source, draw, doc_id, size and copies: rows of ``docs`` alike in all of them are one."""
    rows = docs.select(F.col("source").cast("string").alias("source"), draw(docs).alias("draw"), F.col("doc_id").cast("bigint").alias("doc_id"), word_count(F.col("text")).alias("size"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def place(sized: DataFrame, schedules=cycle_schedules, *, repeats: int = REPEATS) -> DataFrame:
    """``sized`` with source_size, target, weight, schedule and offset, the words of the source that stand before the first copy."""
    scratch = Scratch(sized.sparkSession, "mixing")
    rows = scratch.keep(sized, "sizes")
    digits = max(1, ceil(log(max(rows.count(), 1) / SLICE_ROWS, 16)))
    rows = rows.withColumn("slice", F.left("draw", F.lit(digits))).withColumn("words", F.col("size") * F.col("copies"))
    slices = scratch.keep(rows.groupBy("source", "slice").agg(F.sum("words").alias("slice_size")), "slices")
    known = scratch.keep(targets(schedules(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))), scratch, repeats=repeats), "sources")
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(F.col("source").alias("s"), F.col("slice").alias("l"), F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("start"))  # a row for a million
    within = Window.partitionBy("source", "slice").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("words").over(within), F.lit(0)))
    both = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("l"))).join(known.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t")))
    return both.select("doc_id", "source", "draw", "size", "copies", "source_size", "target", "weight", "schedule", (F.col("start") + F.col("ahead")).alias("offset"))


def _rounds(offset: Column, repeats: int, known=F.col) -> Column:
    """Of each round the document's offset, its position, and the words of it that have one; ``known`` names size, target and what belongs to them."""
    size, target = known("size"), known("target")
    goal = F.round(target)  # whole words

    def one(r: Column) -> Column:
        start = offset + r * known("source_size")
        inverse = lambda x: position(x, goal, known("weight"), known("schedule"))
        words = F.when(inverse(start + size).isNotNull(), size).when(inverse(start).isNotNull(), goal.cast("bigint") - start).otherwise(F.lit(0))
        return F.struct(start.alias("start"), position(start, target, known("weight"), known("schedule")).alias("position"), words.cast("bigint").alias("words"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(repeats - 1).cast("bigint")), one)


def plan(docs: DataFrame, schedules=cycle_schedules, *, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) and position (of the first round; null: not taken) of every row of ``docs`` (doc_id, source, text), range-sorted by position."""
    placed = place(_sized(docs), schedules, repeats=repeats)
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    rows = placed.withColumn("copy", copy).withColumn("rounds", _rounds(F.col("offset") + F.col("copy") * F.col("size"), repeats))
    taken = F.aggregate("rounds", F.lit(0).cast("bigint"), lambda a, r: a + r["words"])
    rows = rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.element_at("rounds", 1)["position"].alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_documents(docs: DataFrame, schedules=cycle_schedules, *, repeats: int = REPEATS) -> DataFrame:
    """Rows of ``docs``, columns as they are, as often as the mix takes them, range-sorted by training position.

    Documents stay whole: a round of a document is in the mix if half of it
    lies before the target. ``docs`` needs doc_id, source and text.
    """
    missing = F.lit("\x00null")
    placed = place(_sized(docs), schedules, repeats=repeats).where((F.col("size") > 0) & (F.col("offset") + F.col("size") / 2 < F.col("target")))
    mine = placed.select(F.col("draw").alias("__draw"), F.coalesce("source", missing).alias("__source"), F.struct("offset", "size", "source_size", "target", "weight", "schedule").alias("__mix"))
    keyed = docs.select("*", draw(docs).alias("__draw"), F.coalesce(F.col("source").cast("string"), missing).alias("__source"))
    # Rows alike in doc_id, text and source are told apart by their turn, counted as they pass.
    turn = F.row_number().over(Window.partitionBy("__draw", "__source").orderBy("__draw")) - 1
    every = keyed.join(mine, ["__draw", "__source"]).withColumn("__turn", turn.cast("bigint"))
    mix = lambda c: F.col("__mix")[c]
    rounds = _rounds(mix("offset") + F.col("__turn") * mix("size"), repeats, mix)
    taken = F.transform(F.filter(rounds, lambda r: r["start"] + mix("size") / 2 < mix("target")), lambda r: r["position"])
    timed = every.withColumn("__at", F.explode(taken))
    return timed.repartitionByRange("__at").sortWithinPartitions("__at", "__draw").select(*docs.columns)

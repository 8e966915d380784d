"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are signs of rotated principal components. Each rotation is learned by
alternating signs and orthogonal fits on a sample of ``FIT_ROWS`` vectors;
several of them, from different starts, give ``BITS`` bits. The first
``INDEX_BITS`` bits are cut into substrings, and each substring has an index
of its own: rows (part, bucket) that hold ids and codes of the vectors whose
substring has that value.

Two codes within radius r have substring distances whose sum is at most r, so
some part i has a distance of at most t[i] wherever the t[i] add up to
r - parts + 1 (pigeonhole). A query probes, part by part, the buckets that
near; the probes are joined to the index by (part, bucket). What a bucket
holds is compared on whole codes: a code within the radius is reported by the
first part in which it is near, so no pair comes twice. Radii on longer and
longer prefixes of the code, up to ``BITS``, thin out what the index lets
through. The pairs fetch their vectors by id and are ranked by their inner
products, in double precision (sums are exact before one rounding).

The radii are the smallest with which ``CALIBRATE`` queries find ``RECALL`` of
their true neighbours among all rows. Queries that find too few candidates
within them probe again with wider ones, at last with all buckets.

The width of a substring follows from the number of rows and the radius: wider
ones have smaller buckets, but more of them lie near a query.

Equal vectors are one entry of the index, with the ids that can matter; so a
vector that many rows hold costs what one costs.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, as queries or candidates; a
row with the query's own vec_id is no candidate; rows that repeat a vec_id are
candidates, and queries, of their own; equal scores go to the smaller vec_id;
with fewer than k candidates all are returned; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, ready_for_python
from .shingles import tidy

FIT_ROWS = 4_000
FIT_ROUNDS = 15
#: Queries, drawn from the sample, whose true neighbours among all rows set the radii.
CALIBRATE = 300
RECALL = 0.965
BITS = 1_024
INDEX_BITS = 64
#: Prefixes of the code, in bits, that have a radius each.
LEVELS = (64, 128, 256, 512, 1_024)
#: Widths of substrings to choose from, and what a probe costs in comparisons of two codes.
WIDTHS = (8, 16)
PROBE_COST = 500
#: Vectors whose postings, and queries whose probes, are packed together.
POSTINGS, PROBES = 65_536, 2_048
#: Bytes of one packed row, about.
PACK_BYTES = 1 << 20
#: How far the radii of later probes move from the calibrated ones towards all bits.
WIDER = (0.25, 0.5, 1.0)
#: Query rows that hold one vector are spread over so many partitions.
SALTS = 16


@dataclass
class Model:
    mean: np.ndarray
    planes: np.ndarray
    radii: tuple[int, ...] = LEVELS

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of 64-bit words for each vector."""
        return np.packbits((x - self.mean) @ self.planes > 0, axis=1, bitorder="little").view("<u8")


def learn(x: np.ndarray) -> Model:
    """Fit mean and rotations on the vectors ``x``."""
    mean = x.mean(0)
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1]
    z = z @ axes
    rng = np.random.default_rng(7)
    planes, have, dims = [], 0, x.shape[1]
    while have < BITS:
        r = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(FIT_ROUNDS):
            u, _, v = np.linalg.svd(np.sign(z @ r).T @ z)
            r = (u @ v).T
        planes.append(axes @ r)
        have += dims
    return Model(mean, np.concatenate(planes, 1)[:, :BITS])


def level_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired codes on each prefix of ``LEVELS``: a column for each."""
    steps = np.cumsum(np.bitwise_count(a ^ b), axis=-1, dtype=np.int32)
    return steps[..., [bits // 64 - 1 for bits in LEVELS]]


def radii_for(apart: np.ndarray, recall: float = RECALL) -> tuple[int, ...]:
    """The smallest radii, at one quantile for all levels, that keep ``recall`` of the neighbours at distances ``apart``."""
    radii = LEVELS
    for share in (1.0, 0.998, 0.996, 0.994, 0.992, 0.99, 0.985, 0.98, 0.975, 0.97):
        tried = np.quantile(apart, share, axis=0, method="higher")
        if (apart <= tried).all(1).mean() < recall:
            break
        radii = tuple(int(r) for r in tried)
    return radii


def thresholds(radius: int, parts: int) -> list[int]:
    """Of each part the distance up to which it is probed (-1: not at all), so that every code within ``radius`` is found."""
    if radius >= INDEX_BITS:
        return [INDEX_BITS // parts] + [-1] * (parts - 1)
    base, more = divmod(radius - parts + 1, parts)
    return [base + 1] * more + [base] * (parts - more)


def best_width(rows: int, radius: int) -> int:
    """Bits of a substring with the least work for a query: probes, and codes in the buckets probed."""

    def work(width: int) -> float:
        probes = [sum(math.comb(width, j) for j in range(t + 1)) for t in thresholds(radius, INDEX_BITS // width)]
        return sum(p * PROBE_COST + rows * p / 2**width for p in probes)

    return min(WIDTHS, key=work)


def _flips(width: int, reach: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``reach`` bits set."""
    every = np.arange(1 << width, dtype=np.uint64)
    return every[np.bitwise_count(every) <= reach]


def usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dims)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _packs(part: int, buckets: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries of one part packed by bucket."""
    order = np.argsort(buckets, kind="stable")
    buckets, ids, codes = buckets[order], ids[order], codes[order]
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
    most = PACK_BYTES // (8 * codes.shape[1] + 8)
    spans = [(i, min(i + most, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for i in range(a, b, most)]
    at = 0
    while at < len(spans):
        end = at + 1
        while end < len(spans) and spans[end][1] - spans[at][0] <= 8 * most:
            end += 1
        some = spans[at:end]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(some), pa.int32()), pa.array([int(buckets[a]) for a, _ in some], pa.int32()), pa.array([ids[a:b].tobytes() for a, b in some], pa.binary()), pa.array([codes[a:b].tobytes() for a, b in some], pa.binary())],
            ["part", "bucket", "ids", "codes"],
        )
        at = end


_PACKED = "part int, bucket int, ids binary, codes binary"


def _entries(rows: DataFrame, model: Model, dims: int, width: int, reach: list[int] | None, size: int) -> DataFrame:
    """Postings of ``rows`` (c, embedding) under their own buckets, or, with ``reach``, probes under the buckets near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, size):
            ids, codes = np.asarray(t.column(0).combine_chunks()).astype("<i8"), model.codes(_vectors(t.column(1).combine_chunks(), dims))
            for part in range(INDEX_BITS // width):
                own = codes[:, 0] >> np.uint64(part * width) & np.uint64((1 << width) - 1)
                if reach is None:
                    yield from _packs(part, own.astype(np.int64), ids, codes)
                elif reach[part] >= 0:
                    flips = _flips(width, reach[part])
                    step = max(1, (1 << 20) // len(flips))
                    for a in range(0, len(ids), step):
                        near = (own[a : a + step, None] ^ flips).astype(np.int64).ravel()
                        row = np.repeat(np.arange(a, min(a + step, len(ids))), len(flips))
                        order = np.argsort(near, kind="stable")
                        near, row = near[order], row[order]
                        for i in range(0, len(row), 1 << 16):  # codes are copied a piece at a time
                            yield from _packs(part, near[i : i + (1 << 16)], ids[row[i : i + (1 << 16)]], codes[row[i : i + (1 << 16)]])

    return rows.select("c", "embedding").mapInArrow(tidy(run), _PACKED)


def met_in_bucket(part: int, width: int, reach: list[int], radii: tuple[int, ...], mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the codes ``mine`` and ``theirs``, which share a probed bucket of ``part``, that are within the radii and near in no earlier part."""
    i, j = [], []
    mask = np.uint64((1 << width) - 1)
    for a in range(0, len(mine), max(1, (1 << 20) // max(1, len(theirs)))):
        some = mine[a : a + max(1, (1 << 20) // max(1, len(theirs)))]
        x = (some[:, 0, None] ^ theirs[:, 0]).ravel()
        at = np.flatnonzero(np.bitwise_count(x) <= radii[0])
        x = x[at]
        for p in range(part):
            if reach[p] >= 0:
                apart = np.bitwise_count(x >> np.uint64(p * width) & mask) > reach[p]
                at, x = at[apart], x[apart]
        q, c = np.divmod(at, len(theirs))
        so_far, word = np.bitwise_count(x).astype(np.int32), 1
        for bits, radius in zip(LEVELS[1:], radii[1:]):
            upto = bits // 64
            so_far = so_far + np.bitwise_count(some[q, word:upto] ^ theirs[c, word:upto]).sum(1, dtype=np.int32)
            near = so_far <= radius
            q, c, so_far, word = q[near], c[near], so_far[near], upto
        i.append(q + a)
        j.append(c)
    return np.concatenate(i) if i else np.zeros(0, np.int64), np.concatenate(j) if j else np.zeros(0, np.int64)


def _search(probes: DataFrame, postings: DataFrame, width: int, reach: list[int], radii: tuple[int, ...]) -> DataFrame:
    """q, c: ids of all queries and vectors within the radii, each pair once."""
    theirs = postings.select("part", "bucket", F.col("ids").alias("their_ids"), F.col("codes").alias("their_codes"))
    # Probes and postings both grow with the table, whatever is guessed of their sizes.
    met = probes.hint("merge").join(theirs, ["part", "bucket"]).select("part", "ids", "codes", "their_ids", "their_codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = BITS // 64
        for b in batches:
            for part, *packed in zip(b.column(0).to_pylist(), *(b.column(k) for k in range(1, 5))):
                q, qc, c, cc = (np.frombuffer(x.as_buffer(), t) for x, t in zip(packed, ("<i8", "<u8", "<i8", "<u8")))
                i, j = met_in_bucket(part, width, reach, radii, qc.reshape(-1, words), cc.reshape(-1, words))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(c[j])], ["q", "c"])

    return met.mapInArrow(tidy(run), "q bigint, c bigint")


def _classes(good: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: h1, h2, embedding, asks (whether a query holds it), members (the k + 1 smallest vec_ids, each with its rows, at most k)."""
    key = ["h1", "h2"]
    once = good.groupBy(*key).agg(F.first("embedding").alias("embedding"), F.max("asks").alias("asks"))
    ids = good.groupBy(*key, "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    first = ids.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("place") <= k + 1)
    return once.join(first.groupBy(*key).agg(F.collect_list(F.struct("vec_id", "n")).alias("members")), key)


def _true_neighbours(classes: DataFrame, asks: np.ndarray, model: Model, k: int) -> np.ndarray:
    """Distances (a column for each level) between the vectors ``asks`` and their k nearest among all."""
    dims, mine, square = asks.shape[1], model.codes(asks), (asks**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, code = np.zeros((len(asks), 0)), np.zeros((len(asks), 0, BITS // 64), "<u8")
        for t in _gathered(batches, 4096):
            x = _vectors(t.column(0).combine_chunks(), dims)
            s = asks @ x.T
            s[(square[:, None] + (x**2).sum(1) - 2 * s) <= 1e-12 * square[:, None]] = -np.inf  # the query's own vector
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            score = np.concatenate([score, np.take_along_axis(s, top, 1)], 1)
            code = np.concatenate([code, model.codes(x)[top]], 1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, code = np.take_along_axis(score, top, 1), np.take_along_axis(code, top[:, :, None], 1)
        if score.shape[1]:
            apart = level_distances(np.repeat(mine[:, None], score.shape[1], 1), code)
            ask = np.repeat(np.arange(len(asks)), score.shape[1])
            keep = np.isfinite(score.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ask[keep], pa.int32()), pa.array(score.ravel()[keep]), pa.array(list(apart.reshape(-1, len(LEVELS))[keep]), pa.list_(pa.int32()))], ["ask", "score", "apart"])

    found = classes.select("embedding").mapInArrow(tidy(run), "ask int, score double, apart array<int>")
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.col("score").desc(), "apart"))
    rows = found.withColumn("place", place).where(F.col("place") <= k).select("apart").collect()  # CALIBRATE times k
    return np.array([r["apart"] for r in rows], np.int64).reshape(-1, len(LEVELS))


def _scored(pairs: DataFrame, classes: DataFrame, dims: int) -> DataFrame:
    """q, c and score, the inner product of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_vectors(b.column(i), dims).tolist() for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([math.sumprod(p, q) for p, q in zip(x, y)], pa.float64())], ["q", "c", "score"])

    theirs = classes.select("c", F.col("embedding").alias("theirs"))
    mine = classes.where("asks").select(F.col("c").alias("q"), F.col("embedding").alias("mine"))
    return pairs.join(theirs, "c").join(mine, "q").select("q", "c", "mine", "theirs").mapInArrow(tidy(run), "q bigint, c bigint, score double")


def candidate_pairs(classes: DataFrame, model: Model, dims: int, k: int, scratch: Scratch) -> DataFrame:
    """q, c: what the queries among ``classes`` (c, embedding, asks, members) find in the index, wide enough for k neighbours where there are that many."""
    n = classes.count()
    width = best_width(n, model.radii[0])
    postings = scratch.keep(_entries(classes.coalesce(max(1, -(-n // POSTINGS))), model, dims, width, None, POSTINGS), "postings")
    asking, found = classes.where("asks"), None
    for i, wider in enumerate((0.0, *WIDER)):
        radii = tuple(r + math.ceil((bits - r) * wider) for r, bits in zip(model.radii, LEVELS))
        reach = thresholds(radii[0], INDEX_BITS // width)
        few = asking.coalesce(max(1, -(-asking.count() // PROBES)))
        pairs = scratch.keep(_search(_entries(few, model, dims, width, reach, PROBES), postings, width, reach, radii), f"pairs{i}")
        if radii == LEVELS:
            lacking = asking.limit(0)
        else:
            held = pairs.join(classes.select("c", F.size("members").alias("m")), "c").groupBy("q").agg(F.sum("m").alias("held")).where(F.col("held") > k)
            lacking = scratch.keep(asking.join(held, asking["c"] == held["q"], "left_anti"), f"lacking{i}")
        done = pairs.join(lacking.select(F.col("c").alias("q")), "q", "left_anti")
        found = done if found is None else found.unionByName(done)
        if radii == LEVELS or lacking.isEmpty():
            return found
        asking = lacking
    return found


def nearest(table: DataFrame, queries: Column, *, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest of each row of ``table`` (vec_id, embedding) where ``queries`` holds."""
    spark = table.sparkSession
    ready_for_python(spark)
    scratch = Scratch(spark, "ann")
    kind = table.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks")).where("vec_id is not null")
    lengths = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0]["d"]
    hashed = rows.where(usable(F.col("embedding"), dims)).select("*", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    good = scratch.keep(hashed, "good")
    # The ids of classes are given once and written, so they stay what they are when tasks are run again.
    classes = scratch.keep(_classes(good, k).select("*", F.monotonically_increasing_id().alias("c")), "classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], schema)
    draw = F.pmod(F.xxhash64("h1", F.lit(9)), F.lit(1_000_000)) / F.lit(1e6)
    sample = classes.where(draw < F.lit(1.2 * FIT_ROWS / n)).orderBy(F.xxhash64("h1", F.lit(9)), "h1", "h2").select("embedding").limit(FIT_ROWS).collect()
    x = np.array([r["embedding"] for r in sample or classes.select("embedding").limit(10).collect()], np.float64)
    model = learn(x)
    if n > k + 1:
        apart = _true_neighbours(classes, x[np.random.default_rng(5).permutation(len(x))[:CALIBRATE]], model, k)
        model.radii = radii_for(apart)
    pairs = candidate_pairs(classes, model, dims, k, scratch)
    scored = _scored(pairs, classes, dims).join(classes.select("c", "members"), "c").select("q", "score", F.inline("members"))
    # In order of score and id, all up to the (k + 1)-th different id: without the query's own, k are left.
    fresh = (F.row_number().over(Window.partitionBy("q", "vec_id").orderBy(F.col("score").desc())) == 1).cast("int")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = scored.withColumn("fresh", fresh).withColumn("ids", F.sum("fresh").over(order) - F.col("fresh")).where(F.col("ids") <= k)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "n"))).alias("near"))
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asks = good.where("asks").select("vec_id", "h1", "h2").join(classes.where("asks").select("h1", "h2", F.col("c").alias("q")), ["h1", "h2"])
    asks = asks.select(F.col("vec_id").alias("query_id"), "q", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    others = F.filter("near", lambda e: e["vec_id"] != F.col("query_id"))
    flat = F.flatten(F.transform(others, lambda e: F.array_repeat(F.struct(e["vec_id"].alias("vec_id"), (-e["minus"]).alias("score")), e["n"])))
    met = asks.join(salted, ["q", "salt"]).select("query_id", F.posexplode(F.slice(flat, 1, k)).alias("at", "e"))
    return met.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")

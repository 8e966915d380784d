"""Document fingerprints: SimHash over weighted terms, and search by permuted block tables.

Terms are the words of a text, split at blanks; a word's weight is its length
in code points, so that long, rarer words outweigh short ones. Each term's
64-bit hash votes with its weight on 64 signed sums; a bit is set where its
sum is positive. All of it is column expressions: one shift and mask takes two
bits of a hash at once into the halves of a long, so that 32 sums hold the 64
votes.

For search within radius r a fingerprint is cut into b > r blocks: two
fingerprints within r bits agree on at least b - r of them, so the tables
keyed by each choice of b - r blocks (the permutations that bring them to the
front) find all. b grows with the logarithm of the number of fingerprints, so
that a key has more bits than it takes to number them.

The document after another one is found on ids and hashes alone, in ranges of
``RANGE_ROWS`` rows; texts are shuffled once by their own key, and the part of
a text that the document before needs once more. No task gets more of the
texts than any other, however ids are spread.

Defined results: a null text counts as empty, and an empty text has the
fingerprint of no votes (zeros); equal texts have equal fingerprints; rows
that repeat a doc_id follow each other in the order of their texts' hashes;
the document after the last is the first, so a single one is its own next; an
empty table gives no rows; extra columns are ignored; a null doc_id sorts
before all others.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BITS = 64
#: Two bits of a hash, 32 apart, in the halves of a long; sums hold weights up to 2^31 for a text.
_PAIR = 0x1_0000_0001
#: Rows (ids and hashes) of a range in which next documents are found.
RANGE_ROWS = 2_000_000
RADIUS = 3
#: Bits by which a key is longer than the number of fingerprints needs.
SPARE_BITS = 4
#: Fingerprints in one packed row of a block table.
PACK = 2_048
#: A document: whether its doc_id is there, the doc_id, two hashes of its text.
KEY = ["z", "k", "t1", "t2"]


def vote_sums(term_hash: Column, weight: Column) -> list[Column]:
    """Aggregates v0 .. v31 (bit i in the low half, bit i + 32 in the high half) and the sum of weights."""
    votes = [F.sum(F.shiftrightunsigned(term_hash, i).bitwiseAND(F.lit(_PAIR)) * weight).alias(f"v{i}") for i in range(BITS // 2)]
    return [*votes, F.sum(weight).alias("votes")]


def bits_of(sums: list[Column], total: Column) -> Column:
    """The fingerprint, a long, from the sums."""
    parts = []
    for i, s in enumerate(sums):
        for at, votes in ((i, s.bitwiseAND(F.lit(0xFFFFFFFF))), (i + BITS // 2, F.shiftrightunsigned(s, 32))):
            parts.append(F.when(votes * 2 > total, F.shiftleft(F.lit(1).cast("bigint"), at)).otherwise(F.lit(0).cast("bigint")))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def terms(text: Column) -> Column:
    """The words of a text; '' comes first or last where blanks do, and gets no weight."""
    return F.split(text, r"[\x20\x09-\x0D]+")


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``bits``; the keys tell the rows of ``rows`` apart and, with equal texts, may repeat."""
    word = F.col("__term")
    exploded = rows.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("__term"))
    sums = exploded.groupBy(*keys).agg(*vote_sums(F.xxhash64(word), F.length(word).cast("bigint")))
    return sums.select(*keys, bits_of([F.col(f"v{i}") for i in range(BITS // 2)], F.col("votes")).alias("bits"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (F.lit(BITS) - F.bit_count(a.bitwiseXOR(b))) / F.lit(float(BITS))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.col("doc_id").cast("bigint")
    return docs.select(id_.isNotNull().alias("z"), F.coalesce(id_, F.lit(0)).alias("k"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def with_previous(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """``keys`` (KEY and other columns, one row for each) with ``prev``, the row before in the order of KEY as a struct; before the first is the last."""
    n = keys.count()
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    # Written, so that the ranges stay what they are when tasks are run again.
    ranged = scratch.keep(keys.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()), "ranges")
    whole = F.struct(*KEY, *(c for c in keys.columns if c not in KEY))
    ends = ranged.groupBy("part").agg(F.max(whole).alias("end"))  # one row for each range
    order = Window.orderBy("part")
    before = F.coalesce(F.lag("end").over(order), F.last("end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    carried = ends.select("part", before.alias("carried"))
    prev = F.lag(whole).over(Window.partitionBy("part").orderBy(*KEY))
    return ranged.withColumn("prev", prev).join(F.broadcast(carried), "part").withColumn("prev", F.coalesce("prev", "carried")).drop("part", "carried")


def edited(text: Column, after: Column) -> Column:
    """``text`` with its last half, rounded down, replaced by as many first code points of ``after``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def _prints(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each distinct document (KEY): copies, prev, n_chars, sha1 and sha2, bits0, bits1 and bits2.

    Versions: 0 the text, 1 edited with the next document's, 2 with its own
    (where rows repeat, all but the last are followed by the same text).
    """
    rows = _keyed(docs)
    keys = rows.select(*KEY, F.length("text").alias("n")).groupBy(*KEY).agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    linked = scratch.keep(with_previous(scratch.keep(keys, "keys"), scratch), "linked")
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("k"))
    texts = rows.withColumn("place", first).where("place = 1").drop("place").join(linked.hint("merge"), KEY)
    heads = texts.select(*(F.col(f"prev.{c}").alias(c) for c in KEY), F.substring("text", F.lit(1), F.floor(F.col("prev.n") / 2).cast("int")).alias("head"))
    pair = texts.join(heads.hint("merge"), KEY)
    edit = lambda after: edited(F.col("text"), after)
    made = [F.col("text"), edit(F.col("head")), F.when(F.col("copies") > 1, edit(F.col("text")))]
    versions = F.filter(F.array(*(F.struct(F.lit(i).alias("which"), x.alias("text")) for i, x in enumerate(made))), lambda v: v["text"].isNotNull())
    votes = fingerprints(pair.select(*KEY, F.explode(versions).alias("v")).select(*KEY, "v.which", "v.text"), [*KEY, "which"])
    bits = votes.groupBy(*KEY).agg(*(F.max(F.when(F.col("which") == i, F.col("bits"))).alias(f"bits{i}") for i in range(3)))
    facts = pair.select(*KEY, "copies", "prev", F.col("n").cast("bigint").alias("n_chars"), F.sha2(made[1], 256).alias("sha1"), F.when(F.col("copies") > 1, F.sha2(made[2], 256)).alias("sha2"))
    return scratch.keep(facts.join(bits.hint("merge"), KEY), "prints")


def fingerprint_report(docs: DataFrame, searched: Column | None = None, *, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how alike each is to its edit's and to the next one's.

    Where ``searched`` (of doc_id) holds, ``n_near`` is the number of other
    rows whose fingerprint is within ``radius``; elsewhere it is null.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = _prints(docs.select("doc_id", "text"), scratch)
    after = prints.select(*(F.col(f"prev.{c}").alias(c) for c in KEY), F.col("bits0").alias("next_bits"))
    both = prints.join(after.hint("merge"), KEY).withColumn("doc_id", F.when(F.col("z"), F.col("k")))
    near = F.lit(None).cast("bigint")
    if searched is not None:
        every = prints.groupBy(F.col("bits0").alias("bits")).agg(F.sum("copies").alias("rows"))
        asked = both.where(searched).select(F.col("bits0").alias("bits")).distinct()
        counts = near_counts(asked, every, scratch, radius=radius)
        both = both.join(counts.withColumnRenamed("bits", "bits0"), "bits0", "left")
        near = F.when(F.coalesce(searched, F.lit(False)), F.col("n_near") - 1)
    # A row of the next document, and a row of itself for each copy before the last.
    last = F.struct(F.col("sha1").alias("sha"), F.col("bits1").alias("edit"), F.col("next_bits").alias("after"))
    same = F.struct(F.col("sha2").alias("sha"), F.col("bits2").alias("edit"), F.col("bits0").alias("after"))
    rows = both.withColumn("near", near).select("*", F.explode(F.concat(F.array(last), F.array_repeat(same, (F.col("copies") - 1).cast("int")))).alias("r"))
    return rows.select(
        "doc_id", "n_chars", F.col("r.sha").alias("edited_sha256"), as_hex(F.col("bits0")).alias("fingerprint"), as_hex(F.col("r.edit")).alias("edited_fingerprint"),
        likeness(F.col("bits0"), F.col("r.edit")).alias("near_edited"), likeness(F.col("bits0"), F.col("r.after")).alias("near_next"), F.col("near").alias("n_near"),
    )


def block_masks(n: int, radius: int) -> list[int]:
    """Masks of the tables for n fingerprints: each keeps b - radius of b blocks."""
    bits = log2(max(n, 2)) + SPARE_BITS
    b = next((b for b in range(radius + 1, radius + 5) if BITS * (b - radius) // b >= bits), radius + 5)
    edges = [BITS * i // b for i in range(b + 1)]
    blocks = [(1 << z) - (1 << a) for a, z in zip(edges, edges[1:])]
    signed = [sum(chosen) for chosen in combinations(blocks, b - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in signed]


def block_keys(bits: Column, masks: list[int]) -> Column:
    """A key (table number, masked bits) of a fingerprint for each mask."""
    return F.array(*(F.struct(F.lit(i).alias("table"), bits.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))


def _first_shared(apart: Column, table: Column, masks: list[int]) -> Column:
    """Whether ``table`` is the first one whose key two fingerprints, ``apart`` in some bits, share."""
    earlier = [(table > i) & (apart.bitwiseAND(F.lit(m)) == 0) for i, m in enumerate(masks[:-1])]
    return ~reduce(lambda a, b: a | b, earlier, F.lit(False))


def near_counts(asked: DataFrame, every: DataFrame, scratch: Scratch, *, radius: int = RADIUS) -> DataFrame:
    """bits and n_near, the sum of ``rows`` within ``radius``, of distinct fingerprints ``asked`` (bits) among ``every`` (bits, rows).

    Keys that are not asked for leave the tables first. What a key holds is
    packed, and a query counts in packs: no row is made for a pair.
    """
    every = scratch.keep(every, "every")
    masks = block_masks(every.count(), radius)
    mine = scratch.keep(asked.select(F.col("bits").alias("q"), F.inline(block_keys(F.col("bits"), masks))), "asked")
    held = every.select("bits", "rows", F.inline(block_keys(F.col("bits"), masks))).join(mine.select("table", "key").distinct(), ["table", "key"], "left_semi")
    held = scratch.keep(held, "tables")
    slots = held.groupBy("table", "key").agg(F.ceil(F.count("*") / PACK).alias("slots"))
    slot = F.pmod(F.xxhash64("bits"), F.col("slots"))
    packs = held.join(slots, ["table", "key"]).groupBy("table", "key", slot.alias("slot")).agg(F.collect_list(F.struct("bits", "rows")).alias("pack"))
    apart = lambda x: x["bits"].bitwiseXOR(F.col("q"))
    near = F.filter("pack", lambda x: (F.bit_count(apart(x)) <= radius) & _first_shared(apart(x), F.col("table"), masks))
    counted = mine.join(packs, ["table", "key"]).select("q", F.aggregate(near, F.lit(0).cast("bigint"), lambda a, x: a + x["rows"]).alias("n"))
    return counted.groupBy(F.col("q").alias("bits")).agg(F.sum("n").alias("n_near"))


def near_fingerprints(queries: DataFrame, table: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """All pairs of a query and a table row at most ``radius`` bits apart: query_id, id, distance.

    Both have id and bits. Equal fingerprints are collapsed before the blocks
    are joined, so that a group of copies meets a query once, and expanded
    after; a pair is reported by the first table whose key the two share.
    """
    mine = queries.select(F.col("bits").alias("q")).distinct()
    theirs = table.select(F.col("bits").alias("t")).distinct()
    masks = block_masks(theirs.count(), radius)
    left = mine.select("q", F.inline(block_keys(F.col("q"), masks)))
    right = theirs.select("t", F.inline(block_keys(F.col("t"), masks)))
    apart = F.col("q").bitwiseXOR(F.col("t"))
    met = left.join(right, ["table", "key"]).where((F.bit_count(apart) <= radius) & _first_shared(apart, F.col("table"), masks)).select("q", "t", F.bit_count(apart).alias("distance"))
    ids = met.join(queries.select(F.col("id").alias("query_id"), F.col("bits").alias("q")), "q").join(table.select("id", F.col("bits").alias("t")), "t")
    return ids.select("query_id", "id", "distance")

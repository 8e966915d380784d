"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct runs of ``size`` words; two link when
the Jaccard similarity of their sets reaches the threshold. Documents with
equal sets form a class, and only one of a class takes part. A class is named
by 64 bits of its set's hash, its key, until components get their doc_ids.

1. Under any fixed order of tokens, similar sets share at least m of the first
   (n - ceil(t n)) + m tokens of the one whose prefix ends first. In hash
   order, with m about a tenth of n, documents with too few tokens that occur
   elsewhere cannot link and leave.
2. What remains is counted in full. A document with more than n - ceil(t n)
   tokens of its own leaves too. Tokens are ordered by frequency; frequent
   ones (``FREQUENT`` documents or more) form classes that are indexed by
   pairs, rare ones by themselves. The prefix is extended until the tokens
   beyond the first of each frequent class, and all rare ones, outnumber those
   that a similar set may lack; similar sets then share a signature.
   Sets that share a rare token meet under it; so under a signature of
   frequent tokens rare ones count as unshared, and a set leaves it that could
   not be similar to any other of its sets. Pages of one template with other
   words of their own leave before sets are compared.
3. For components, not all pairs of a signature are tried: its members are
   compared with one pivot each, linked groups are contracted, and what is
   left of different groups is all compared: one by one under signatures with
   few members, in packs under those with many. Sets are compared whole.

Defined results: without words or text the set is empty and links with
nothing; with fewer than ``size`` words the whole sequence is the one token;
rows that repeat a doc_id are judged one by one, and stand for one document
where they link; a row with a null doc_id links with nothing and has a null
component; an empty table gives no rows; the smallest doc_id names a class or
a component; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, ready_for_python
from .shingles import mix, packed, shingle_sets, tidy
from .tokencounts import shared_counts, shared_tokens

SIZE = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 80, 100
#: Documents that hold a token of a frequent class; at most 255.
FREQUENT = 32
#: Of a document's tokens, those beyond the necessary prefix that step 1 looks at.
EXTRA = 0.1
#: Rounds of comparing with pivots before all remaining pairs.
PIVOT_ROUNDS = 2
#: Signatures with more members than this are compared in packs of about PACK sets.
FEW, PACK = 16, 256
#: Lists of ids of up to this length are broadcast (16 bytes each); longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A class of equal sets with more than one in so many rows is hot.
HOT_SHARE = 1_000
_BAND = math.log(1.26)


def needed(n: int) -> int:
    """Tokens that a similar set shares at least: ceil(t n)."""
    return -(-NUM * n // DEN)


def margin(n: int) -> int:
    return max(1, int(EXTRA * n))


def band(n: int) -> int:
    """Similar sizes are in the same or in neighbouring bands: they differ by a factor of at most 1.25, bands by 1.26."""
    return int(math.log(n) / _BAND + 1e-9)


def base_rows(docs: DataFrame, size: int) -> DataFrame:
    """doc, n, s1, s2 (a 128-bit hash of the set), prefix: the lowest tokens of step 1, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s, prefix = [], [], []
            for tokens in shingle_sets(b.column(1), size):
                k = len(tokens)
                n.append(k)
                s.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                prefix.append(tokens[: k - needed(k) + margin(k)] if k else tokens)
            halves = np.frombuffer(b"".join(s), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), packed(prefix)], ["doc", "n", "s1", "s2", "prefix"])

    ready_for_python(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").mapInArrow(tidy(run), "doc bigint, n bigint, s1 bigint, s2 bigint, prefix binary")


def text_classes(docs: DataFrame, size: int) -> DataFrame:
    """doc, text, n, s1, s2 as in ``base_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(1), size))
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc", "text", "n", "s1", "s2"])

    ready_for_python(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").mapInArrow(tidy(run), "doc bigint, text string, n bigint, s1 bigint, s2 bigint")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc (the key of the row's class), tokens, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(0), size))
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8")[::2]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), packed(sets), pa.array([len(x) for x in sets], pa.int64())], ["doc", "tokens", "n"])

    return docs.select("text").mapInArrow(tidy(run), "doc bigint, tokens binary, n bigint")


def small(table: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcast if it is short."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (doc), which is a stored table."""
    return docs.join(small(ids), F.col("doc_id").cast("bigint") == F.col("doc"), "left_semi")


def ordered(rows: DataFrame) -> DataFrame:
    """doc, n, own (tokens that no other has), tokens and counts of the shared ones in order of (count, token); without documents that cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc", "n", "own", "tokens", "counts")}
            for doc, n, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                t, first = np.unique(np.frombuffer(t.as_buffer(), "<u8"), return_index=True)  # a row that stands twice sent its tokens twice
                c = np.frombuffer(c.as_buffer(), np.uint8)[first]
                own = max(0, n - len(t))
                if own > n - needed(n):
                    continue
                order = np.lexsort((t, c))
                for k, v in (("doc", doc), ("n", n), ("own", own), ("tokens", t[order]), ("counts", c[order])):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["own"], pa.int64()), packed(out["tokens"]), packed(out["counts"])], list(out))

    return rows.select("doc", "n", "tokens", "counts").mapInArrow(tidy(run), "doc bigint, n bigint, own bigint, tokens binary, counts binary")


def signatures_of(n: int, own: int, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of n tokens, ``own`` of them unshared, the others in order; and the tokens that count as unshared under each."""
    lacking = n - needed(n)  # tokens that a similar set may lack, at most
    rare = int(np.searchsorted(counts, FREQUENT))
    singles = tokens[: min(rare, lacking + 1 - own)]
    out = [mix(singles)]
    left = lacking + 1 - own - rare
    if left > 0:
        often = tokens[rare:]
        for tag in (band(n), band(n) + 1):
            salt = np.uint64((tag * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            classes = max(1, int(0.2 * 1.26**tag) // 8)
            of = (mix(often ^ salt) % np.uint64(classes)).astype(np.int64)
            fresh = np.zeros(len(often), bool)
            fresh[np.unique(of, return_index=True)[1]] = True
            end = int(np.searchsorted(np.cumsum(~fresh), left)) + 1
            prefix, of = often[:end], of[:end]
            order = np.argsort(of, kind="stable")
            prefix, edges = prefix[order], np.searchsorted(of[order], np.arange(classes + 1))
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    x, y = np.minimum(prefix[a:b][i], prefix[a:b][j]), np.maximum(prefix[a:b][i], prefix[a:b][j])
                    out.append(mix(mix(x + salt) ^ y))
    pairs = np.unique(np.concatenate([out[0][:0], *out[1:]]))
    # A set with pairs has all its rare tokens as signatures: sets that share one meet there.
    return np.concatenate([out[0], pairs]), np.concatenate([np.full(len(out[0]), own), np.full(len(pairs), own + rare)])


def signatures(sets: DataFrame) -> DataFrame:
    """sig, doc, n, own: a row for each signature of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, n, own = (np.asarray(b.column(i)) for i in range(3))
            made = [
                signatures_of(int(k), int(u), np.frombuffer(t.as_py(), "<u8"), np.frombuffer(c.as_py(), np.uint8))
                for k, u, t, c in zip(n, own, b.column(3), b.column(4))
            ]
            times = [len(x) for x, _ in made]
            flat = np.concatenate([x for x, _ in made]) if made else np.zeros(0, np.uint64)
            apart = np.concatenate([x for _, x in made]) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *(pa.array(np.repeat(x, times)) for x in (docs, n)), pa.array(apart.astype(np.int64))], ["sig", "doc", "n", "own"])

    return sets.select("doc", "n", "own", "tokens", "counts").mapInArrow(tidy(run), "sig bigint, doc bigint, n bigint, own bigint")


def _possible(a: str, b: str):
    """Whether sizes and unshared tokens let two sets be similar: the overlap is at most the smaller number of shared tokens."""
    most = F.least(F.col(f"n{a}") - F.col(f"own{a}"), F.col(f"n{b}") - F.col(f"own{b}"))
    return most * DEN >= (F.col(f"n{a}") + F.col(f"n{b}") - most) * NUM


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar, compared token by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, nb, ta, tb in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
                x = len(np.intersect1d(np.frombuffer(ta.as_buffer(), "<u8"), np.frombuffer(tb.as_buffer(), "<u8"), assume_unique=True))
                keep.append(x * DEN >= (na + nb - x) * NUM)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(tidy(run), "a bigint, b bigint")


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    """a, b: every member with the pivot it shares most signatures with. ``rows``: sig, doc, n, own, group."""
    rank = F.col("own") * F.lit(1 << 30) + F.shiftrightunsigned(F.xxhash64("doc"), 34)  # few unshared tokens first
    groups = rows.groupBy("sig").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min_by(F.struct("doc", "n", "own", "group"), rank).alias("pivot")).where("low < high")
    met = rows.join(groups.select("sig", F.col("pivot.doc").alias("b"), F.col("pivot.n").alias("nb"), F.col("pivot.own").alias("ownb"), F.col("pivot.group").alias("groupb")), "sig")
    apart = met.where("group <> groupb").withColumnsRenamed({"n": "na", "own": "owna"}).where(_possible("a", "b"))
    counted = apart.groupBy("doc", "b").agg(F.count("*").alias("times"))
    return counted.groupBy(F.col("doc").alias("a")).agg(F.max(F.struct("times", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _met(left: DataFrame, right: DataFrame, wanted) -> DataFrame:
    """a, b: rows of one signature for which ``wanted`` holds and whose sizes allow it."""
    met = left.join(right, "sig").where(wanted).where(_possible("a", "b"))
    return met.select(F.least("doca", "docb").alias("a"), F.greatest("doca", "docb").alias("b")).distinct()


def _side(rows: DataFrame, side: str, *keep: str) -> DataFrame:
    return rows.select("sig", *keep, *(F.col(c).alias(f"{c}{side}") for c in ("doc", "n", "own", "group") if c in rows.columns))


def hopeful(rows: DataFrame) -> DataFrame:
    """Rows (sig, doc, n, own) without those that can't be similar to any set of their signature.

    Two sets share at most na - owna tokens and have at least na + ownb in all.
    """
    least = rows.groupBy("sig").agg(F.min("own").alias("least"), F.count("*").alias("__members")).where("__members > 1").drop("__members")
    return rows.join(least, "sig").where(_hope()).drop("least")


def _hope():
    return (F.col("n") - F.col("own")) * DEN >= (F.col("n") + F.col("least")) * NUM


def _all_pairs(rows: DataFrame) -> DataFrame:
    """a, b: all members of one signature."""
    rows = hopeful(rows)
    return _met(_side(rows, "a"), _side(rows, "b"), F.col("doca") < F.col("docb"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Hopeful rows of signatures with more than one group, with the main (largest) group and the number of members."""
    sizes = rows.groupBy("sig", "group").agg(F.count("*").alias("k"), F.min("own").alias("own"))
    main = sizes.groupBy("sig").agg(F.max(F.struct("k", "group")).alias("top"), F.count("*").alias("groups"), F.sum("k").alias("members"), F.min("own").alias("least")).where("groups > 1")
    return rows.join(main.select("sig", F.col("top.group").alias("main"), "members", "least"), "sig").where(_hope()).drop("least")


def _few_pairs(mixed: DataFrame) -> DataFrame:
    """a, b: members of different groups under signatures with few members; those of the main group aren't paired with each other."""
    few = mixed.where(F.col("members") <= FEW)
    return _met(_side(few.where(F.col("group") != F.col("main")), "a"), _side(few, "b", "main"), F.expr("groupa <> groupb and (groupb = main or doca < docb)"))


def _packs(rows: DataFrame, size: int, name: str) -> DataFrame:
    """g and packs of about ``size`` rows (doc, n, tokens) each."""
    counts = rows.groupBy("g").agg(F.count("*").alias("__k"))
    slot = F.pmod(F.xxhash64("doc"), F.ceil(F.col("__k") / size))
    return rows.join(counts, "g").groupBy("g", slot.alias("slot")).agg(F.collect_list(F.struct("doc", "n", "tokens")).alias(name)).drop("slot")


def _many_links(mixed: DataFrame, sets: DataFrame, group: DataFrame | None) -> DataFrame:
    """a, b: links that signatures with many members may hold.

    Those outside of a signature's main group are compared with the main group
    and with each other, in packs: no row is made for a pair, and a pack's
    tokens are indexed once.
    """
    outside = mixed.where(F.col("members") > FEW).where(F.col("group") != F.col("main")).select(F.col("main").alias("g"), "doc").distinct()
    facts = sets.select("doc", "n", "tokens")
    label = facts.withColumn("g", F.col("doc")) if group is None else facts.join(small(group), F.col("doc") == F.col("node"), "left").select("doc", "n", "tokens", F.coalesce("component", "doc").alias("g"))
    asking = outside.join(facts, "doc").select("g", "doc", "n", "tokens")
    inside = label.join(outside.select("g").distinct(), "g").select("g", "doc", "n", "tokens")
    pairs = _packs(asking, PACK // 4, "asks").join(_packs(inside.unionByName(asking), PACK, "holds"), "g").select("asks", "holds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for asks, holds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = [np.frombuffer(x["tokens"], "<u8") for x in holds]
                flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(holds)), [len(x) for x in tokens])
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                sizes, ids = np.array([x["n"] for x in holds]), [x["doc"] for x in holds]
                for x in asks:
                    mine = np.frombuffer(x["tokens"], "<u8")
                    low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                    runs = high - low
                    at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
                    common = np.bincount(owner[at], minlength=len(holds))
                    near = common * DEN >= (sizes + x["n"] - common) * NUM
                    out += [(x["doc"], ids[i]) for i in np.flatnonzero(near) if ids[i] != x["doc"]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])

    return pairs.mapInArrow(tidy(run), "a bigint, b bigint")


def _candidates(docs: DataFrame, scratch: Scratch, size: int) -> tuple[DataFrame, str, DataFrame]:
    """Members (doc, n, s1, s2) of all rows, the table of sets that may link (for the caller to drop), and their signatures; the doc of the latter two is a class's key, s1."""
    docs = docs.select("doc_id", "text")
    base = scratch.keep(base_rows(docs, size), "base")
    members = scratch.keep(base.select("doc", "n", "s1", "s2"), "members")
    entries = base.where("doc is not null").agg(F.sum(F.octet_length("prefix")) / 8).head()[0] or 0
    shared = shared_counts(base.where("doc is not null and n > 0").select(F.col("s1").alias("doc"), F.col("prefix").alias("tokens")), int(entries))
    classes = members.where("doc is not null and n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("doc"))
    # A similar set may be smaller by the threshold, and its margin is what counts.
    least = F.greatest(F.lit(1), F.floor(F.lit(EXTRA) * F.ceil(F.col("n") * NUM / DEN)).cast("bigint"))
    active = classes.join(shared.withColumnRenamed("doc", "s1"), "s1").where(F.col("n_shared") >= least)
    active = scratch.keep(active.select("s1", "n", "doc"), "active")
    scratch.drop("base")
    sets = scratch.keep(full_sets(with_ids(docs, active.select("doc")), size), "sets")
    entries = sets.agg(F.sum("n")).head()[0] or 0
    told = scratch.keep(shared_tokens(sets.select("doc", "tokens"), int(entries), FREQUENT), "told")
    # Shuffled once, into the buckets: the join with sizes keeps that partitioning, and so do the joins of each round.
    n = scratch.buckets("told")
    alive = scratch.bucketed(ordered(told.repartition(n, "doc").join(active.select(F.col("s1").alias("doc"), "n"), "doc")), "ngram_sets", n, "doc")
    scratch.drop("sets", "told")
    try:
        rows = scratch.keep(signatures(docs.sparkSession.table(alive)), "signatures")
    except BaseException:
        scratch.drop_table(alive)
        raise
    return members, alive, rows


def _with_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` with their class's component. Classes of more than one in ``HOT_SHARE`` members, at most that many, are broadcast; others are joined by a shuffle."""
    key = ["n", "s1", "s2"]
    total = classes.agg(F.sum("rows")).head()[0] or 0
    hot, seldom = F.broadcast(classes.where(F.col("rows") > total / HOT_SHARE).drop("rows")), classes.where(F.col("rows") <= total / HOT_SHARE).drop("rows")
    often = members.join(hot, key)
    others = members.join(hot.select(*key), key, "left_anti").join(seldom, key, "left")
    return often.unionByName(others)


def _components(rows: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame | None:
    """node, component of all ``sets`` that link; None where none do."""
    edges, group = None, None
    for i in range(PIVOT_ROUNDS + 1):
        if group is None:
            grouped = rows.withColumn("group", F.col("doc"))
        else:
            grouped = rows.join(small(group), F.col("doc") == F.col("node"), "left").select("sig", "doc", "n", "own", F.coalesce("component", "doc").alias("group"))
        grouped = scratch.keep(grouped, f"grouped{i}")
        last = i == PIVOT_ROUNDS
        if last:
            grouped = scratch.keep(_mixed(grouped), "mixed")
        pairs = scratch.keep(_few_pairs(grouped) if last else _pivot_pairs(grouped), f"pairs{i}")
        found = verify(pairs, sets)
        if last:
            found = found.unionByName(_many_links(grouped, sets, group))
        found = scratch.keep(found, f"edges{i}")
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            group = scratch.keep(components(edges, scratch, f"round{i}"), f"components{i}")
        scratch.drop(f"grouped{i}", f"pairs{i}")
    return group


def _linked(docs: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """doc, n, s1, s2, component of every row of ``docs`` (doc_id, text)."""
    members, table, rows = _candidates(docs, scratch, size)
    try:
        group = _components(rows, docs.sparkSession.table(table), scratch)
    finally:
        scratch.drop_table(table)
    if group is None:
        group = rows.select(F.col("doc").alias("node"), F.col("doc").alias("component")).limit(0)
    classes = members.where("doc is not null and n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("first"), F.count("*").alias("rows"))
    # The smallest doc_id of a component's classes names it.
    names = group.join(classes, F.col("node") == F.col("s1")).groupBy("component").agg(F.min("first").alias("name"))
    group = scratch.keep(group.join(small(scratch.keep(names, "names")), "component").select("node", "name"), "named")
    named = classes.join(small(group), F.col("s1") == F.col("node"), "left").select("n", "s1", "s2", "rows", F.coalesce("name", "first").alias("component"))
    linked = _with_classes(members, scratch.keep(named, "named-classes"))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return linked.select("doc", "n", "s1", "s2", component.alias("component"))


def link_components(docs: DataFrame, *, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    linked = _linked(docs, Scratch(docs.sparkSession, "ngram-join"), size)
    return linked.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def similar_classes(docs: DataFrame, *, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) between the smallest doc_ids of classes, and doc_id with its class_id and number of linked classes."""
    scratch = Scratch(docs.sparkSession, "ngram-links")
    members, table, rows = _candidates(docs, scratch, size)
    try:
        links = scratch.keep(verify(_all_pairs(rows), docs.sparkSession.table(table)), "links")
    finally:
        scratch.drop_table(table)
    classes = scratch.keep(members.where("doc is not null and n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("class_id")), "classes")
    degrees = links.select(F.explode(F.array("a", "b")).alias("s1")).groupBy("s1").agg(F.count("*").alias("n_links"))
    counted = classes.join(degrees, "s1", "left")
    named = members.where("doc is not null").join(counted, ["n", "s1", "s2"], "left").withColumn("class_id", F.coalesce("class_id", "doc"))
    first = {x: classes.select(F.col("s1").alias(x), F.col("class_id").alias(f"first_{x}")) for x in "ab"}
    pairs = links.join(first["a"], "a").join(first["b"], "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return pairs, named.select(F.col("doc").alias("doc_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, *, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, columns as they are, that have their component's smallest doc_id; of rows with equal doc_id and text, one."""
    scratch = Scratch(docs.sparkSession, "ngram-keep")
    kept = F.col("component").isNull() | (F.col("doc") == F.col("component"))
    found = scratch.keep(_linked(docs.select("doc_id", "text"), scratch, size).withColumn("kept", kept), "found")
    chosen = scratch.keep(found.groupBy(F.col("doc").alias("__doc")).agg(F.count("*").alias("__rows"), F.count_if("kept").alias("__kept")).where("__kept > 0"), "chosen")
    doc = F.col("doc_id").cast("bigint")
    single = docs.join(chosen.where("__rows = 1 and __doc is not null"), doc == F.col("__doc"), "left_semi")
    repeated = chosen.where("__rows > 1 or __doc is null")
    if repeated.isEmpty():
        return single
    again = docs.join(repeated.where("__rows = __kept"), doc.eqNullSafe(F.col("__doc")), "left_semi").dropDuplicates(["doc_id", "text"])
    out = single.unionByName(again)
    mixed = chosen.where("__kept < __rows")
    if mixed.isEmpty():
        return out
    # Some texts of a doc_id stay, others are copies of another document's.
    some = docs.join(mixed, doc == F.col("__doc"), "left_semi").dropDuplicates(["doc_id", "text"])
    wanted = found.where("kept").join(mixed, F.col("doc") == F.col("__doc"), "left_semi").select("doc", "n", "s1", "s2").distinct()
    texts = text_classes(some, size).join(wanted, ["doc", "n", "s1", "s2"], "left_semi").select(F.col("doc").alias("__doc"), F.col("text").alias("__text"))
    return out.unionByName(some.join(texts, (doc == F.col("__doc")) & F.col("text").eqNullSafe(F.col("__text")), "left_semi"))

"""Crawl planning as set operations: scope, robots, budgets, frontier, deduplication, and the level-by-level crawl over a page store."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import meta, urls
from ..session import ship
from ..sources import saved
from .payloads import inflate
from .storage import Store

#: Times what a crawl may fetch that its frontier may hold.
FRONTIER_FACTOR = 10


@dataclass(frozen=True)
class CrawlConfig:
    #: None: the store ends the crawl.
    max_pages: int | None = 100
    max_depth: int | None = 3
    scope: str = "domain"
    allow: tuple[str, ...] = ()
    block: tuple[str, ...] = ()
    agent: str = "loomspan"
    budgets: dict[str, int] = field(default_factory=dict)


def first_seen(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def unseen(rows: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    return rows.join(visited.select(key).distinct(), key, "left_anti")


def mark_duplicates(pages: DataFrame, body: str = "html", seq: str = "page_id") -> DataFrame:
    """``pages`` and error: ``duplicate content`` for every later page of an equal body."""
    place = F.row_number().over(Window.partitionBy(F.sha2(F.col(body), 256)).orderBy(seq))
    return pages.withColumn("error", F.when(place > 1, F.lit("duplicate content")))


def within_budget(requests: DataFrame, budgets: dict[str, int], path: str = "path", seq: str = "seq") -> DataFrame:
    """``requests`` and allowed. Budgets are by path prefix, the longest fitting one; ``*`` is for all.

    A request that its prefix refuses takes nothing from the whole, and once
    that is used up all are refused, so the two counts follow one another.
    """
    prefixes = sorted((p for p in budgets if p != "*"), key=lambda p: (-len(p), p))
    mine = F.coalesce(*(F.when(F.col(path).startswith(p), F.lit(p)) for p in prefixes)) if prefixes else F.lit(None).cast("string")
    limit = F.lit(None).cast("bigint")
    for p in prefixes:
        limit = F.when(F.col("prefix") == p, F.lit(budgets[p])).otherwise(limit)
    rows = requests.withColumn("prefix", mine)
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(seq))
    rows = rows.withColumn("fits", F.coalesce(rank <= limit, F.lit(True)) if prefixes else F.lit(True))
    if "*" not in budgets:
        return rows.withColumn("allowed", F.col("fits")).drop("fits")
    # Only as many as the whole allows matter: TakeOrdered in place of one window over all.
    chosen = rows.where("fits").orderBy(seq).limit(budgets["*"]).select(F.col(seq).alias("__seq"))
    return rows.join(chosen.withColumn("__in", F.lit(True)), F.col(seq) == F.col("__seq"), "left").withColumn("allowed", F.coalesce("__in", F.lit(False))).drop("__in", "__seq", "fits")


def pop_frontier(frontier: DataFrame, n: int) -> DataFrame:
    """The n entries with the highest priority, first come first among equals."""
    return frontier.orderBy(F.col("priority").desc(), "seq").limit(n)


def robots_rules(bodies: DataFrame, agent: str) -> DataFrame:
    """Rules of robots files (host, body) for an agent: host, allow, pattern (a regular expression), size of the rule.

    The group that names the agent is used, else that of ``*``.
    """
    lines = bodies.select("host", F.posexplode(F.split("body", r"\r?\n|\r")).alias("pos", "line"))
    parts = lines.select("host", "pos", F.regexp_replace("line", r"\s*#.*$", "").alias("line")).select(
        "host", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("k"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("v")
    ).where(F.col("k").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("pos")
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(order), F.lit("")) != "user-agent")
    grouped = parts.withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    names = grouped.where("k = 'user-agent'").groupBy("host", "grp").agg(F.max(F.when(F.contains(F.lit(agent.lower()), F.lower("v")) & (F.col("v") != "*") & (F.col("v") != ""), 2).when(F.col("v") == "*", 1).otherwise(0)).alias("fit"))
    best = names.withColumn("top", F.max("fit").over(Window.partitionBy("host"))).where("fit = top and fit > 0").select("host", "grp")
    rules = grouped.where("k <> 'user-agent' and v <> ''").join(best, ["host", "grp"])
    literal = F.regexp_replace(F.regexp_replace("v", r"([.+?^()\[\]{}|\\])", r"\\$1"), r"\*", ".*")
    pattern = F.concat(F.lit("^"), F.when(F.endswith("v", F.lit("$")), literal).otherwise(F.regexp_replace(literal, r"\$", r"\\\$")))
    return rules.select("host", (F.col("k") == "allow").alias("allow"), pattern.alias("pattern"), F.length("v").alias("size"))


def robots_allowed(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """``candidates`` (url) and allowed: the longest fitting rule decides, allow among equals; without one, yes."""
    rows = candidates.withColumns({"__host": urls.host(F.col("url")), "__path": F.concat(F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), F.try_parse_url("url", F.lit("QUERY"))), F.lit("")))})
    distinct = rows.select("__host", "__path").distinct()
    fits = distinct.join(rules, F.col("__host") == F.col("host")).where(F.rlike(F.col("__path"), F.col("pattern")))
    verdict = fits.groupBy("__host", "__path").agg(F.max_by("allow", F.struct("size", "allow")).alias("__ok"))
    return rows.join(verdict, ["__host", "__path"], "left").withColumn("allowed", F.coalesce("__ok", F.lit(True))).drop("__host", "__path", "__ok")


def crawl_delay(body: Column) -> Column:
    """Seconds of the first crawl-delay line; null without one."""
    value = F.regexp_extract(body, r"(?im)^\s*crawl-delay\s*:\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(value != "", value.cast("double"))


def robots_sitemaps(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def hrefs(html: Column) -> Column:
    """Addresses of links as written, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""), F.lit(1)), lambda x: F.trim(x))


def links(pages: DataFrame) -> DataFrame:
    """url, pos, target: the links of pages (url, and html or its ``hrefs``), resolved where absolute, root-relative or beside the page."""
    written = F.col("hrefs") if "hrefs" in pages.columns else hrefs(F.col("html"))
    flat = pages.select("url", F.posexplode(written).alias("pos", "href")).where("href <> ''")
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "")
    scheme = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    href = F.col("href")
    target = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).when(href.startswith("#"), F.concat("url", href)).otherwise(F.concat(base, F.lit("/"), href))
    return flat.select("url", "pos", target.alias("target"))


def crawl(spark: SparkSession, seeds: DataFrame, store: DataFrame, robots: DataFrame | None = None, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Breadth-first crawl of a page store (url, html) from ``seeds`` (url).

    Each level joins the frontier with the store; robots, scope, cycles and
    budgets filter what its links add. Levels are in order of depth, then of
    the order of discovery, so reruns give the same pages. Without limits the
    crawl ends where no level adds URLs. Returns url, depth,
    seq, title, n_links and error (blocked by robots, not found, duplicate
    content, or null); ``max_pages`` counts pages without error. A body counts
    as seen once a page that robots allow had it, on whatever level.
    """
    ship(spark)
    files = Store(spark, "crawl")
    pages = store.select(urls.normalize(F.col("url")).alias("url"), "html").dropDuplicates(["url"])
    # What a crawl reads of a page, once; levels join this and carry no markup.
    html = F.col("html")
    pages = pages.where(html.isNotNull()).select("url", F.sha2(html, 256).alias("__body"), meta.title(html).alias("title"), hrefs(html).alias("hrefs"))
    if config.max_depth != 0:
        pages = files.keep(pages, "store")
    start = seeds.select(urls.normalize(F.col("url")).alias("url")).where("url is not null").distinct()
    frontier = files.keep(files.placed(start, "start", "url").select("url", F.lit(0).alias("depth"), F.col("url").alias("seed"), (F.col("place") + 1).alias("seq")), "frontier0")
    rules = files.keep(robots_rules(robots, config.agent), "rules") if robots is not None else None
    visited, bodies, results, good, next_seq = frontier.select("url"), None, [], 0, frontier.count() + 1
    for depth in count() if config.max_depth is None else range(config.max_depth + 1):
        room = None if config.max_pages is None else config.max_pages - good
        if room is not None and room <= 0:
            break
        level = robots_allowed(frontier, rules) if rules is not None else frontier.withColumn("allowed", F.lit(True))
        fetched = level.join(pages, "url", "left")
        lost = F.when(~F.col("allowed"), "blocked by robots").when(F.col("__body").isNull(), "not found")
        fetched = files.keep(fetched.withColumn("lost", lost), f"fetched{depth}")
        # Of the pages that were fetched, the first of the crawl to have a body keeps it.
        here = fetched.where("lost is null")
        firsts = here.groupBy("__body").agg(F.min("seq").alias("__first"))
        if bodies is not None:
            firsts = firsts.join(bodies.withColumn("__old", F.lit(True)), "__body", "left").withColumn("__first", F.when(F.col("__old").isNull(), F.col("__first"))).drop("__old")
        firsts = files.keep(firsts, f"bodies{depth}")
        found_new = firsts.where("__first is not null").select("__body")
        bodies = found_new if bodies is None else bodies.unionByName(found_new)
        judged = here.join(firsts, "__body").withColumn("error", F.when(F.col("__first").isNull() | (F.col("seq") > F.col("__first")), "duplicate content")).drop("__first")
        done = judged.unionByName(fetched.where("lost is not null").withColumn("error", F.col("lost"))).select("url", "depth", "seed", "seq", "error")
        fine = done.where("error is null").select("url", "seed", "seq")
        if room is not None:
            fine = files.keep(fine.orderBy("seq").limit(room), f"fine{depth}")
            good += fine.count()
        kept = fetched.join(fine.select("url"), "url", "left_semi")
        found = links(kept.select("url", "hrefs")).join(fine.select("url", "seed", F.col("seq").alias("from_seq")), "url")
        found = files.keep(found.withColumn("url_wanted", urls.normalize(F.col("target"))), f"links{depth}")
        counts = found.groupBy("url").agg(F.count("*").alias("n_links"))
        titles = kept.select("url", "title")
        shown = done.join(titles, "url", "left").where("title is not null or error is not null").join(counts, "url", "left")
        results.append(shown.select("url", "depth", "seq", "title", F.coalesce("n_links", F.lit(0)).alias("n_links"), "error"))
        if depth == config.max_depth:
            break
        wanted = found.select(F.col("url_wanted").alias("url"), "seed", "from_seq", "pos").where("url is not null").where(urls.host(F.col("url")).isNotNull() & F.col("url").rlike("^https?:"))
        wanted = wanted.where(urls.in_scope(F.col("url"), F.col("seed"), config.scope, config.allow, config.block) & ~urls.is_cycle(F.col("url")))
        if config.budgets:
            numbered = files.placed(wanted, f"wanted{depth}", "from_seq", "pos").withColumnRenamed("place", "seq").withColumn("path", F.try_parse_url("url", F.lit("PATH")))
            wanted = within_budget(numbered, config.budgets).where("allowed").select("url", "seed", "from_seq", "pos")
        fresh = unseen(first_seen(wanted, F.col("url"), F.col("from_seq"), F.col("pos")), visited)
        capped = fresh if config.max_pages is None else fresh.orderBy("from_seq", "pos").limit(config.max_pages * FRONTIER_FACTOR)
        ranked = files.placed(capped.select("url", "seed", "from_seq", "pos"), f"fresh{depth + 1}", "from_seq", "pos")
        frontier = files.keep(ranked.select("url", "seed", F.lit(depth + 1).alias("depth"), (F.col("place") + next_seq).alias("seq")), f"frontier{depth + 1}")
        n = frontier.count()
        if not n:
            break
        next_seq += n
        visited = visited.unionByName(frontier.select("url"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def crawl_summary(result: DataFrame) -> DataFrame:
    return result.agg(F.count_if(F.col("error").isNull()).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum("n_links").alias("links"), F.max("depth").alias("depth"))


def parse_sitemaps(bodies: DataFrame) -> DataFrame:
    """Entries of sitemaps (url, body): url, kind (page or index), loc, lastmod, priority, changefreq. Entries without loc are left out.

    A body is text, or bytes that may be packed; files that unpack to more
    than the cap, or are broken, have no entries.
    """
    if bodies.schema["body"].dataType.simpleString() == "binary":
        bodies = inflate(bodies)
    body = F.col("body")
    index = F.contains(F.lower(body), F.lit("<sitemapindex"))
    entries = F.regexp_extract_all(body, F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    field_ = lambda name: F.nullif(F.trim(F.regexp_extract("entry", rf"(?is)<{name}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)), F.lit(""))
    plain = F.replace(F.replace(F.replace(field_("loc"), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    flat = bodies.select("url", F.when(index, "index").otherwise("page").alias("kind"), F.posexplode(entries).alias("pos", "entry"))
    return flat.select("url", "kind", "pos", plain.alias("loc"), field_("lastmod").alias("lastmod"), field_("priority").cast("double").alias("priority"), field_("changefreq").alias("changefreq")).where("loc is not null")


def since(entries: DataFrame, day: str) -> DataFrame:
    """Entries not known to be older: last modifications are compared as text."""
    return entries.where(F.col("lastmod").isNull() | (F.col("lastmod") >= day))


def discover_sitemaps(spark: SparkSession, robots: DataFrame, store: DataFrame, *, max_depth: int = 3, name_filter: str | None = None) -> DataFrame:
    """Pages of all sitemaps of hosts (robots: host, body) in a store of sitemap texts (url, body): robots' own, else the usual places; indexes are followed."""
    files = Store(spark, "sitemaps")
    named = robots.select("host", F.explode_outer(robots_sitemaps(F.col("body"))).alias("url"))
    usual = F.explode(F.array(F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml")), F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap_index.xml"))))
    level = named.where("url is not null").select("url").unionByName(named.where("url is null").select(usual.alias("url"))).distinct()
    seen, found = level, []
    for depth in range(max_depth + 1):
        parsed = files.keep(parse_sitemaps(store.join(level, "url")), f"sitemaps{depth}")
        found.append(parsed.where("kind = 'page'").drop("kind"))
        children = parsed.where("kind = 'index'").select(F.col("loc").alias("url")).distinct()
        if name_filter:
            children = children.where(F.col("url").rlike(name_filter))
        level = files.keep(unseen(children, seen), f"children{depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def domain_name(url: Column) -> Column:
    """The host of a URL as part of a file's name; unknown where it has none."""
    return F.regexp_replace(F.coalesce(urls.host(url), F.lit("unknown")), r"[^\p{L}\p{N}.-]", "_")


def file_name(url: Column) -> Column:
    """The file of a page: its host and 16 digits of a hash of its URL."""
    return F.concat(domain_name(url), F.lit("_"), F.left(F.sha2(url, 256), F.lit(16)), F.lit(".html"))


def save_html(pages: DataFrame, path: str) -> None:
    """Markup of pages (url, html) as text, each page by itself in a folder for its domain and in it one for its file's name; copies of one URL are numbered files or in different parts.

    The driver gets a name for each task, none for a page (see ``sources.saved``).
    """
    saved.save(pages.where("html is not null").select(domain_name(F.col("url")).alias("domain"), file_name(F.col("url")).alias("file"), "html"), path)


def page_files(pages: DataFrame, *order: str) -> DataFrame:
    """``pages`` (url, status, markdown) with text and file, ``page_0000.md`` and on in the given order; those without text have none.

    Places come from a range sort and counts of its partitions.
    """
    full = F.octet_length("markdown") > 0
    placed = Store(pages.sparkSession, "pages").placed(pages.where(full), "files", *(F.col(c) for c in order))
    return placed.withColumn("file", F.format_string("page_%04d.md", F.col("place"))).drop("place")


def save_markdown(pages: DataFrame, path: str, *order: str) -> None:
    """Pages (url, status, markdown) as text below ``pages/file=<name>``, and ``index``: JSON lines of url, file and status."""
    files = page_files(pages, *order)
    saved.save(files.select("file", "markdown"), f"{path}/pages")
    files.select("url", "file", "status").write.mode("overwrite").json(f"{path}/index")

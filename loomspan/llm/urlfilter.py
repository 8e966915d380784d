"""URL filters: rules on host and path, indexed by their rarest literal token.

A rule names a host and a path. It fits a url whose host is that host or one
below it and whose path starts with that path; the longest fitting rule
decides. A rule may also carry a regular expression for the whole url, which
then must match too.

The tokens of a rule are its host's labels and its path's whole segments. How
often each of them occurs in the urls is counted, and the rule is filed under
the rarest. A url fetches only the rules filed under its own tokens, and only
for those runs the regular expression that the rule compiles to.

Urls are judged once for each distinct string, by column expressions alone.

Defined results: a null url, or one without ``://``, has an empty host and
path; without a fitting rule the verdict is the default; rows that repeat are
each kept; rules of the same length are decided by the rule's text; a rule
without any token never fits; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rule tables of up to so many rows are broadcast; larger ones are shuffled by token.
BROADCAST_RULES = 50_000
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "verdict string, host string, path string, pattern string"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | list[tuple[str, str, str, str | None]]) -> DataFrame:
    """Rules given as (verdict, host, path) or (verdict, host, path, regular expression for the whole url)."""
    return spark.createDataFrame([tuple(r) if len(r) == 4 else (*r, None) for r in rules], RULE_SCHEMA)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column, whole_path: bool) -> Column:
    """Labels as ``h:label`` and segments as ``p:segment``; of a rule's path only segments closed by a slash are whole."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/")
    segments = parts if whole_path else F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = F.filter(F.concat(labels, F.transform(segments, lambda x: F.concat(F.lit("p:"), x))), lambda x: F.length(x) > 2)
    return F.array_distinct(kept)


def _literal(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def compile_rules(rules: DataFrame) -> DataFrame:
    """rule (its text), verdict, regex over ``host#path`` (neither holds a ``#``), pattern, length and tokens."""
    path = F.coalesce("path", F.lit(""))
    regex = F.concat(F.lit("^(?:[^#]*\\.)?"), _literal(F.col("host")), F.lit("#"), _literal(path))
    return rules.select(
        F.concat("host", path).alias("rule"), "verdict", regex.alias("regex"), "pattern", (F.length("host") + F.length(path)).alias("size"), _tokens(F.col("host"), path, False).alias("tokens")
    ).where("verdict is not null and rule is not null")


def index_rules(compiled: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Each rule under its rarest token: token, rule, verdict, regex, pattern, size. ``url_tokens``: a row for each token of each url."""
    flat = compiled.withColumn("token", F.explode("tokens")).drop("tokens")
    counts = url_tokens.join(F.broadcast(flat.select("token").distinct()) if _small(compiled) else flat.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("rule", "verdict", "pattern").orderBy(F.coalesce("n", F.lit(0)), "token")
    return flat.join(counts, "token", "left").withColumn("place", F.row_number().over(rarest)).where("place = 1").select("token", "rule", "verdict", "regex", "pattern", "size")


def _small(rules: DataFrame) -> bool:
    return rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES


def judge(pages: DataFrame, rules: DataFrame, *, default: str = DEFAULT) -> DataFrame:
    """``pages`` (with a column url) and host, path, rule and verdict of each row.

    Columns of ``pages`` that have those names are replaced.
    """
    compiled = compile_rules(rules)
    urls = pages.select("url").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    tokens = urls.where("host <> ''").select("url", "host", "path", F.explode(_tokens(F.col("host"), F.col("path"), True)).alias("token"))
    index = index_rules(compiled, tokens.select("token"))
    candidates = tokens.join(F.broadcast(index) if _small(rules) else index, "token")
    fits = F.rlike(F.concat("host", F.lit("#"), "path"), F.col("regex")) & (F.col("pattern").isNull() | F.rlike(F.col("url"), F.col("pattern")))
    best = candidates.where(fits).groupBy("url").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    verdicts = urls.join(best, "url", "left").select(F.col("url").alias("__url"), F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("best.rule").alias("__rule"), F.coalesce("best.verdict", F.lit(default)).alias("__verdict"))
    mine = pages.select(*(F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")))
    joined = mine.join(verdicts, mine["url"].eqNullSafe(verdicts["__url"])).drop("__url")
    return joined.withColumnsRenamed({f"__{c}": c for c in ("host", "path", "rule", "verdict")})

"""Public suffixes of host names by a table of rules, and the scope of cookies.

Rules have the form of the public list: a suffix, ``*.suffix`` for every name
one label longer, ``!name`` for an exception to such a rule; the caller gives
them. Each name is cut at its dots, at most ``MOST_LABELS`` times, and the cuts
are joined with the rules: an exception wins and makes what follows its first
label the suffix, else the longest match does, else the last label. Distinct
names are looked up, so a hot domain is looked up once; the rules are
broadcast up to ``BROADCAST_RULES`` rows, else both sides are shuffled.

Defined results: names are compared in lower case without dots at their ends;
null and empty names have null suffixes; a name that is a suffix has no site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels a name can have (255 bytes hold no more).
MOST_LABELS = 127
#: Rules that are broadcast, at most; the public list has some 10,000.
BROADCAST_RULES = 50_000


def tidy_name(name: Column) -> Column:
    return F.nullif(F.lower(F.btrim(name, F.lit(". "))), F.lit(""))


def suffixes(names: DataFrame, rules: DataFrame) -> DataFrame:
    """name, suffix and site (one label more; null if the name is a suffix) of the distinct ``names`` (name), by ``rules`` (rule)."""
    text = F.lower(F.trim("rule"))
    own = rules.where("trim(rule) <> ''").select(
        F.when(text.startswith("!"), "exception").when(text.startswith("*."), "wild").otherwise("plain").alias("kind"), F.regexp_replace(text, r"^(?:!|\*\.)", "").alias("at")
    ).distinct()
    own = F.broadcast(own) if own.count() <= BROADCAST_RULES else own
    asked = names.select(tidy_name(F.col("name")).alias("name")).where("name is not null").distinct()
    labels = F.split("name", r"\.")
    cuts = asked.select("name", F.size(labels).alias("n"), F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(MOST_LABELS)))).alias("k"), labels.alias("labels"))
    cuts = cuts.select("name", "n", "k", F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), ".").alias("at"))
    met = cuts.join(own, "at", "left")
    # Labels of the suffix that a match makes; a wild rule needs one more label than it has.
    made = F.when(F.col("kind") == "plain", F.col("k")).when((F.col("kind") == "wild") & (F.col("k") < F.col("n")), F.col("k") + 1).when(F.col("kind") == "exception", F.col("k") - 1)
    best = met.groupBy("name", "n").agg(F.coalesce(F.max(F.when(F.col("kind") == "exception", made)), F.max(made), F.lit(1)).alias("k"))
    part = lambda k: F.array_join(F.slice(labels, F.col("n") - k + 1, k), ".")
    return best.select("name", part(F.col("k")).alias("suffix"), F.when(F.col("k") < F.col("n"), part(F.col("k") + 1)).alias("site"))


def cookie_scopes(cookies: DataFrame, rules: DataFrame) -> DataFrame:
    """``cookies`` (domain, page_host, others) with ``scope``: ``suffix`` (shared by unrelated sites, critical), ``wide`` (shared with hosts above, medium), or null."""
    found = suffixes(cookies.select(F.col("domain").alias("name")), rules)
    domain, host = tidy_name(F.col("domain")), tidy_name(F.col("page_host"))
    table = found.select(F.col("name").alias("__name"), F.col("site").isNull().alias("__suffix"))
    rows = cookies.withColumn("__domain", domain).join(table, F.col("__domain") == F.col("__name"), "left")
    scope = F.when(F.col("__suffix"), "suffix").when((F.col("__domain") != host) & F.endswith(host, F.concat(F.lit("."), F.col("__domain"))), "wide")
    return rows.withColumn("scope", scope).select(*cookies.columns, "scope")

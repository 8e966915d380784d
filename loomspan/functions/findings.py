"""Findings as rules: a condition, and what to report where it holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")
PENALTY = {"critical": -15, "high": -10, "medium": -5, "low": -2, "info": 0}
KIND = "array<struct<category:string,check:string,severity:string,detail:string>>"


@dataclass(frozen=True)
class Rule:
    category: str
    check: str
    when: Column
    severity: str | Column
    detail: str | Column


def _col(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def report(rules: list[Rule]) -> Column:
    """The findings whose conditions hold, in the order of the rules."""
    made = [F.when(r.when, F.struct(F.lit(r.category).alias("category"), F.lit(r.check).alias("check"), _col(r.severity).alias("severity"), _col(r.detail).alias("detail"))) for r in rules]
    return F.array_compact(F.array(*made)).cast(KIND)


def penalty(findings: Column, floor: int) -> Column:
    """Sum of the severities' penalties, at least ``floor``."""
    weights = F.create_map(*(x for k, v in PENALTY.items() for x in (F.lit(k), F.lit(v))))
    return F.greatest(F.aggregate(findings, F.lit(0), lambda a, f: a + weights[f["severity"]]), F.lit(floor))


def histogram(findings: Column) -> Column:
    """Counts by severity, and in all."""
    def count(severity: str) -> Column:
        return F.size(F.filter(findings, lambda f: f["severity"] == severity)).alias(severity)

    return F.struct(*(count(s) for s in SEVERITIES), F.size(findings).alias("total"))


def rank(severity: Column) -> Column:
    """0 for the worst."""
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity) - 1, F.lit(4)).cast("int")

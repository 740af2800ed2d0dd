"""Severity, verdicts and capped lists (A1, A2, A3, A6, A17, 2.7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")


def rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def verdict(findings: DataFrame, by: Sequence[str] = (), severity: str = "severity", blocking: str = "blocking") -> DataFrame:
    """A1. block: a blocking finding of high severity or worse; review: anything of medium or worse; else ok."""
    block = F.coalesce(F.bool_or(F.col(blocking) & F.col(severity).isin("critical", "high")), F.lit(False))
    review = F.coalesce(F.bool_or(F.col(severity).isin("critical", "high", "medium")), F.lit(False))
    word = F.when(block, "block").when(review, "review").otherwise("ok").alias("verdict")
    return findings.groupBy(*by).agg(word) if by else findings.agg(word)


def severity_counts(findings: DataFrame, by: Sequence[str] = (), severity: str = "severity") -> DataFrame:
    """A2. How many of each severity, zeros included."""
    return findings.groupBy(*by).agg(*(F.count_if(F.col(severity) == s).alias(s) for s in SEVERITIES))


def top_with_omitted(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """2.7. The first k of each group, with their place, and how many were left out.

    Counts come from an aggregation, the rows from a ranked filter that Spark limits before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    shown = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    totals = rows.groupBy(*by).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("omitted"))
    return shown.join(totals, list(by))


def files_to_check(rows: DataFrame, path: str, severity_rank: str, score: str, item: str) -> DataFrame:
    """A6. For each file the worst rank, the highest score and the sorted items."""
    return rows.groupBy(path).agg(F.min(severity_rank).alias("worst"), F.max(score).alias("score"), F.array_sort(F.collect_set(item)).alias("items"))

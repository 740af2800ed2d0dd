"""Joins and windows over intervals and ordered places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCK = 1_000_000


def in_spans(points: DataFrame, spans: DataFrame, by: str, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """J5. Points (rows with `by` and `at`) that lie in any span of the same `by`; ends included.

    The equality comes first, so the join is hashed or merged on it and the range is a residual condition.
    """
    p, s = points.alias("p"), spans.select(F.col(by).alias("_by"), F.col(start).alias("_start"), F.col(end).alias("_end")).alias("s")
    return p.join(s, (F.col(f"p.{by}") == F.col("s._by")) & F.col(f"p.{at}").between(F.col("s._start"), F.col("s._end")), "left_semi")


def innermost(points: DataFrame, spans: DataFrame, by: str, at: str, point_key: str, width: Column, later_wins: bool = False, name: str = "name", start: str = "start", end: str = "end", block: float | None = None) -> DataFrame:
    """J6. Each point with the narrowest span that holds it (left: null where none does).

    Of equally narrow spans the first by (start, name) wins, or the last. The winner is taken by an aggregation
    (min_by over a struct), which combines before the shuffle, rather than by a window over all candidates. With block, places are
    numbers cut into blocks of that length, and points meet only spans of their own block; a span stands in each block it
    touches, so a block should be about as long as most spans."""
    s = spans.select(F.col(by).alias("_by"), F.col(name).alias("_name"), F.col(start).alias("start"), F.col(end).alias("end"))
    on = (F.col(by) == F.col("_by")) & F.col(at).between(F.col("start"), F.col("end"))
    if block:
        nth = lambda c: F.floor(F.col(c) / block)
        s = s.withColumn("_block", F.explode(F.sequence(nth("start"), nth("end"))))
        on = on & (nth(at) == F.col("_block"))
    j = points.join(s, on, "left")
    best = F.max_by if later_wins else F.min_by
    rank = F.struct(-width if later_wins else width, F.col("start"), F.col("_name"))
    return j.groupBy(point_key).agg(best("_name", rank).alias("span"))


def islands(rows: DataFrame, n: str, by: Sequence[str] = ()) -> DataFrame:
    """W7. Runs of consecutive numbers as (first, last)."""
    block = F.floor(F.col(n) / BLOCK)
    w = Window.partitionBy(*by).orderBy(n) if by else Window.partitionBy(block).orderBy(n)
    runs = rows.select(*by, n).distinct().withColumn("_run", F.col(n) - F.row_number().over(w))
    if by:
        return runs.groupBy(*by, "_run").agg(F.min(n).alias("first"), F.max(n).alias("last")).drop("_run")
    # Without a key, runs are made in blocks of numbers; only runs that touch an end of their block, two a block at
    # most, meet in one window to be joined.
    part = runs.groupBy(block.alias("_b"), "_run").agg(F.min(n).alias("first"), F.max(n).alias("last")).select("first", "last")
    touches = (F.pmod("first", F.lit(BLOCK)) == 0) | (F.pmod("last", F.lit(BLOCK)) == BLOCK - 1)
    over = Window.orderBy("first")
    ends = part.filter(touches).withColumn("_new", F.coalesce((F.col("first") != F.lag("last").over(over) + 1).cast("int"), F.lit(1)))
    joined = ends.withColumn("_id", F.sum("_new").over(over)).groupBy("_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return part.filter(~touches).unionByName(joined.select("first", "last"))


def successor_changes(before: DataFrame, after: DataFrame, by: str, at: str, what: str) -> DataFrame:
    """W4. Places whose successor in order differs between two versions; places are told by (by, at)."""
    w = Window.partitionBy(by).orderBy(at)
    nxt = [df.select(by, at, F.lead(what).over(w).alias(c)) for df, c in ((before, "next_before"), (after, "next_after"))]
    return nxt[0].join(nxt[1], [by, at]).filter(~F.col("next_before").eqNullSafe(F.col("next_after")))


def range_members(rows: DataFrame, by: str, at: str, first: Column, last: Column, what: str) -> DataFrame:
    """W5. Everything between the first row that meets `first` and the last that meets `last`, in order."""
    ends = rows.groupBy(by).agg(F.min(F.when(first, F.col(at))).alias("_a"), F.max(F.when(last, F.col(at))).alias("_z"))
    inside = rows.join(ends, by).filter(F.col(at).between(F.col("_a"), F.col("_z")))
    return inside.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(at, what))).alias("_m")).select(by, F.transform("_m", lambda x: x[what]).alias("members"))


def trailing_count(rows: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """W6. rows with the number of the same key's rows in the trailing window, themselves included."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("in_window", F.count("*").over(w))


def within_budget(groups: DataFrame, size: str, order: Sequence[Column], budget: int, least: int, by: Sequence[str] = ()) -> DataFrame:
    """W9. Groups in order share a budget of items; each gets at least `least` (or all it has)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(size).over(w), F.lit(0))
    return groups.withColumn("shown", F.least(F.col(size), F.greatest(F.lit(budget) - spent, F.lit(least))))

"""Comparing two versions of keyed rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Worst first; a row that changed in several ways has the first of these.
KINDS = ("removed", "renamed", "signature", "value", "body", "added")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str | Sequence[str], levels: Sequence[tuple[str, Column | str]], keep: Sequence[str] = ()) -> DataFrame:
    """J1. One row for each key that differs: key, kind, and before/after structs of the columns in keep.

    levels: (kind, column) pairs, worst first; a column name compares null-safely, a Column is a condition over
    `b.<name>` and `a.<name>`. Keys must be unique on each side (see last_wins) and not null. One full outer join on the key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    b, a = before.alias("b"), after.alias("a")
    has = F.col(f"b.{keys[0]}").isNotNull(), F.col(f"a.{keys[0]}").isNotNull()
    kind = F.when(has[0] & ~has[1], "removed").when(~has[0] & has[1], "added")
    for name, test in levels:
        kind = kind.when(~F.col(f"b.{test}").eqNullSafe(F.col(f"a.{test}")) if isinstance(test, str) else test, name)
    sides = [F.when(h, F.struct(*(F.col(f"{s}.{c}").alias(c) for c in keep))).alias(n) for h, s, n in ((has[0], "b", "before"), (has[1], "a", "after"))] if keep else []
    out = b.join(a, reduce(and_, (F.col(f"b.{k}") == F.col(f"a.{k}") for k in keys)), "full_outer")
    return out.select(*(F.coalesce(F.col(f"b.{k}"), F.col(f"a.{k}")).alias(k) for k in keys), kind.alias("kind"), *sides).filter("kind IS NOT NULL")


LIVE = ("added", "body", "signature", "value", "renamed")


def live(changes: DataFrame) -> DataFrame:
    """P10. Changes of things that are there."""
    return changes.filter(F.col("kind").isin(*LIVE))


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """W1. The last row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def unique_pairs(gone: DataFrame, new: DataFrame, match: Sequence[str], key: str) -> DataFrame:
    """J2/J3. (old, new) keys of rows that match on all of `match`, only where each side has exactly one such row.

    Groups are counted before the join (a partial aggregation), so a match shared by many rows never multiplies.
    """
    def once(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*match).agg(F.count("*").alias("n"), F.min(key).alias(name)).filter("n = 1").drop("n")

    return once(gone, "old_key").join(once(new, "new_key"), list(match)).select("old_key", "new_key", *match)


def with_renames(changes: DataFrame, pairs: DataFrame, key: str, kind: str = "renamed") -> DataFrame:
    """Changes (key, kind) in which each paired removal and addition is one row of `kind` with its old key."""
    paired = pairs.select(F.explode(F.array(F.struct(F.col("old_key").alias("k"), F.lit("removed").alias("kind")), F.struct(F.col("new_key").alias("k"), F.lit("added").alias("kind")))).alias("x")).select(F.col("x.k").alias(key), F.col("x.kind").alias("kind"))
    rest = changes.select(key, "kind").join(paired, [key, "kind"], "left_anti").withColumn("old_key", F.lit(None).cast(changes.schema[key].dataType))
    return rest.unionByName(pairs.select(F.col("new_key").alias(key), F.lit(kind).alias("kind"), "old_key"))


def only_in(rows: DataFrame, *others: DataFrame, on: Sequence[str]) -> DataFrame:
    """U1/U5. Rows that none of the others has: "new, not old", or "only the combination has"."""
    for other in others:
        rows = rows.join(other.select(*on).distinct(), list(on), "left_anti")
    return rows


def overlay(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """U3/U4. A three-way combination: mine, plus what only they changed (deletions too). One row a key left:
    key, value, source (mine, theirs), conflict (both changed it, to different values; mine stands)."""
    named = [df.select(F.col(key).alias(f"k{n}"), F.col(value).alias(f"v{n}")) for n, df in enumerate((base, mine, theirs))]
    j = named[0].join(named[1], F.col("k0") == F.col("k1"), "full_outer").withColumn("k01", F.coalesce("k0", "k1")).join(named[2], F.col("k01") == F.col("k2"), "full_outer")
    same = lambda x, y: F.col(f"k{x}").isNull().eqNullSafe(F.col(f"k{y}").isNull()) & F.col(f"v{x}").eqNullSafe(F.col(f"v{y}"))
    i_did, they_did = ~same(0, 1), ~same(0, 2)
    theirs_stands = they_did & ~i_did
    return j.select(
        F.coalesce("k01", "k2").alias(key),
        F.when(theirs_stands, F.col("v2")).otherwise(F.col("v1")).alias(value),
        F.when(theirs_stands, "theirs").otherwise("mine").alias("source"),
        (i_did & they_did & ~same(1, 2)).alias("conflict"),
        F.when(theirs_stands, F.col("k2").isNotNull()).otherwise(F.col("k1").isNotNull()).alias("_there"),
    ).filter("_there").drop("_there")


def first_writer(rows: DataFrame, key: str, writer: str) -> DataFrame:
    """W2/J22. Of each key the first writer by name, and how many different ones there are."""
    return rows.groupBy(key).agg(F.min(writer).alias("owner"), F.countDistinct(writer).alias("writers")).withColumn("overlap", F.col("writers") > 1)

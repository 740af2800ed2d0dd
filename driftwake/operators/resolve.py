"""Names to definitions, and calls against contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rows: DataFrame, sources: Sequence[tuple[str, DataFrame, Column]], value: str = "target") -> DataFrame:
    """J7. rows with the value of the first source that has one, and its name.

    sources: (name, DataFrame with unique `_key` and `_value`, key expression over rows). Each is a left join; a
    coalesce in the order given decides.
    """
    out, found = rows, []
    for i, (name, df, key) in enumerate(sources):
        s = df.select(F.col("_key").alias(f"_k{i}"), F.col("_value").alias(f"_v{i}"))
        out = out.join(s, key == F.col(f"_k{i}"), "left")
        found.append((name, F.col(f"_v{i}")))
    via = F.coalesce(*(F.when(v.isNotNull(), F.lit(n)) for n, v in found))
    return out.select(*rows.columns, F.coalesce(*(v for _, v in found)).alias(value), via.alias("via"))


def unique_guess(rows: DataFrame, members: DataFrame, name: str, member: str, stop: Sequence[str] = ()) -> DataFrame:
    """J8. rows with the only member of their name (`guess`), null where there are several or the name is too common."""
    once = members.groupBy(name).agg(F.count("*").alias("_n"), F.min(member).alias("guess")).filter("_n = 1").drop("_n")
    if stop:
        once = once.filter(~F.col(name).isin(*stop))
    return rows.join(once, name, "left")


def contract_problems(positional: Column, defaults: Column, positional_only: Column, varargs: Column, keyword_only: Column, keyword_required: Column, varkw: Column, n: Column, keywords: Column) -> Column:
    """P12. Why a call with n positional arguments and these keywords fails against a contract: an array of reasons,
    empty when it fits. All by array functions, inside code generation."""
    size = F.size(positional)
    most = F.when(~varargs & (n > size), F.concat(F.lit("takes at most "), size.cast("string"), F.lit(" positional argument(s), the call passes "), n.cast("string")))
    required = F.slice(positional, 1, F.greatest(size - defaults, F.lit(0)))
    missing = F.concat(F.filter(required, lambda p, i: (i >= n) & ((i < positional_only) | ~F.array_contains(keywords, p))), F.filter(keyword_required, lambda k: ~F.array_contains(keywords, k)))
    lacks = F.when(F.size(missing) > 0, F.concat(F.lit("requires "), F.concat_ws(", ", missing), F.lit(", which the call does not pass")))
    accepted = F.concat(F.slice(positional, positional_only + 1, F.greatest(size - positional_only, F.lit(0))), keyword_only)
    unknown = F.filter(keywords, lambda k: ~F.array_contains(accepted, k))
    odd = F.when(~varkw & (F.size(unknown) > 0), F.concat(F.lit("has no parameter named "), F.concat_ws(", ", unknown)))
    return F.filter(F.array(most, lacks, odd), lambda x: x.isNotNull())


def best_tier(rows: DataFrame, tiers: Sequence[Column], order: Sequence[Column] = ()) -> DataFrame:
    """P17. Rows that meet the first condition that any row meets; `tier` counts from 0."""
    tier = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(tiers)))
    ranked = rows.withColumn("tier", tier).filter("tier IS NOT NULL")
    least = ranked.agg(F.min("tier").alias("_least"))
    out = ranked.join(F.broadcast(least), F.col("tier") == F.col("_least")).drop("_least")  # one row
    return out.orderBy(*order) if order else out

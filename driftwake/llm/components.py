"""Connected components of a graph in tables, by alternating large-star and small-star steps.

Every step is a join and an aggregation over edges, cut in the shared checkpoint folder; no link or component is ever
gathered on the driver. A round at least about halves the distances to the least node, so long chains take few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.llm.common import cut_in_loop, joined_to_one, release

ROUNDS = 60
TASK_EDGES = 50_000


def roots(edges: DataFrame) -> DataFrame:
    """edges(a, b), of any type with an order -> (node, root): the least node that each node of an edge reaches, itself
    included. Nodes with very many neighbours get their least one by a broadcast (see joined_to_one). Tables of a round are held in
    as few partitions as their edges need, for each shuffle leaves files for each of them, however small."""
    now = cut_in_loop(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(ROUNDS):
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark, total = tuple(seen), 2 * seen[0]
        few, was = 1 + total // TASK_EDGES, now
        now = now.coalesce(few)
        # large star: each node's larger neighbours go to the least of its neighbours and itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_in_loop(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")).coalesce(few))
        large = cut_in_loop(joined_to_one(both.filter("b > a"), least, ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(few).distinct().coalesce(few))
        # small star: each node's smaller neighbours, and it, go to the least of them
        fewer = cut_in_loop(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).coalesce(few))
        small = joined_to_one(large, fewer, ["a"], "n", total).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_in_loop(small.unionByName(fewer.select("a", F.col("m").alias("b"))).coalesce(few).distinct().coalesce(few))
        release(was, least, large, fewer)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")

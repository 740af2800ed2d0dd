"""Exact top-k by inner product with MaxScore over sharded postings.

A term is a dimension with a query weight; its postings in a shard are that dimension's values. Of each shard, the
least and greatest value of a dimension bound what the term can add. Terms are split by these bounds: the essential
ones are traversed for all rows of the shard, the others are probed, strongest bound first, only for rows whose score
so far plus all bounds still open reaches the k-th best; shards' lists are merged at the end.

Queries are met in blocks of at most QUERY_BLOCK, each broadcast alone, so what is broadcast has a fixed bound and the
number of passes grows with the query set instead.

A query row meets every row but itself: rows that repeat its id, or it as a whole, are candidates like any other. So
the best k + 1 of all rows are sought, and one row of the query's own id and score is left out, if it is among them.

Edge cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as if
filled with zeros; each query row is answered, also where its id or the whole row is repeated; rows with a null id take
no part; fewer candidates than k give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwake.llm.common import cut, table

SCALE = 1024
K = 10
EVERY = 100
SHARD_ROWS = 8192
QUERY_BLOCK = 16384  # of 64 dimensions: 8 MB
SHARDS_AT_ONCE = 512  # tasks a pass, or four a core if that is more; each answers with k rows a query at most
PASSES_AT_ONCE = 16  # in one plan


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    v = F.col(vec_col)
    good = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """int64, one row a vector, zeros where it is shorter."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(column), width), np.int64)
    if len(column):
        out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten(), np.int64)
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:  # all that tie with the k-th stay
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Shard:
    """Postings of some rows: one array a dimension, with bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, exact: bool):
        self.ids = ids
        self.postings = np.ascontiguousarray(vectors.T if exact else vectors.T.astype(np.float64))
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)

    def search(self, query: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The best k of the shard and what is held from others."""
        q = query.astype(self.postings.dtype)
        bounds = np.maximum(q * self.low, q * self.high)
        order = np.argsort(-np.abs(q) * (self.high - self.low), kind="stable")  # terms that tell rows apart most
        rest = np.concatenate((np.cumsum(bounds[order][::-1])[::-1], [0]))  # what terms from i on can add
        floor = held[1][k - 1] if len(held[1]) >= k else None
        # Essential: the strong terms up to where the weakest row a shard could hold falls out by the bounds of the
        # others. Before that no row can be told to lose; without a k-th best all terms are essential.
        n = first = len(order)
        if floor is not None:
            weakest = np.cumsum(np.minimum(q * self.low, q * self.high)[order])
            loses = np.flatnonzero(weakest + rest[1:] < floor)
            first = int(loses[0]) + 1 if len(loses) else n
        scores = q[order[:first]] @ self.postings[order[:first]]
        rows = None  # all
        for i in range(first, n, 4):
            alive = scores + rest[i] >= floor
            if not alive.all():
                kept = np.flatnonzero(alive)
                rows, scores = kept if rows is None else rows[kept], scores[kept]
                if not len(rows):
                    return held
            terms = order[i : i + 4]
            part = self.postings[terms] if rows is None else self.postings[np.ix_(terms, rows)]
            scores = scores + q[terms] @ part
        ids = self.ids if rows is None else self.ids[rows]
        scores = scores.astype(np.int64)
        if floor is not None:
            strong = scores >= floor
            ids, scores = ids[strong], scores[strong]
        return best(np.concatenate((held[0], ids)), np.concatenate((held[1], scores)), k)


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row (queries are rows of `rows`) the k others with the greatest inner
    products."""
    spark = rows.sparkSession
    asked = quantised(queries, id_col, vec_col, scale).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    asked = cut(asked.withColumn("query", F.xxhash64("vec_id", "v")).withColumn("block", F.pmod("query", F.lit(1 << 20))))
    facts = asked.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).head()
    n = facts[0] or 0
    pool = quantised(rows, id_col, vec_col, scale)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = pool.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).head()
    width = max(facts[1] or 0, most[0] or 0)
    exact = width * float(facts[2] or 0) * float(most[1] or 0) >= 2.0**53  # else doubles hold every sum exactly
    passes, tasks = -(-n // QUERY_BLOCK), max(SHARDS_AT_ONCE, 4 * spark.sparkContext.defaultParallelism)
    done, found = [], None
    for p in range(passes):
        block = asked.filter(F.floor(F.col("block") * passes / (1 << 20)) == p).select("query", "vec_id", "v").toPandas()
        key, own = block["query"].to_numpy(np.int64), block["vec_id"].to_numpy(np.int64)
        qv = matrix(pa.array(block["v"].tolist(), pa.list_(pa.int64())), width)
        shared = spark.sparkContext.broadcast((key, own, qv))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width, exact=exact) -> Iterator[pa.RecordBatch]:
            key, own, qv = shared.value
            held = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(key)
            for b in batches:
                if not b.num_rows:
                    continue
                ids, vectors = b.column(0).to_numpy(), matrix(b.column(1), width)
                for a in range(0, len(ids), SHARD_ROWS):
                    shard = Shard(ids[a : a + SHARD_ROWS], vectors[a : a + SHARD_ROWS], exact)
                    held = [shard.search(v, k + 1, h) for v, h in zip(qv, held)]
            sizes = [len(h[0]) for h in held]
            if sum(sizes):
                ids, scores = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                selves = np.einsum("ij,ij->i", qv, qv)
                cols = (np.repeat(key, sizes), np.repeat(own, sizes), ids, scores, np.repeat(selves, sizes))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "query_id", "vec_id", "score", "self"])

        part = pool.coalesce(tasks).mapInArrow(run, "query long, query_id long, vec_id long, score long, self long")
        found = part if found is None else found.unionByName(part)
        if p % PASSES_AT_ONCE == PASSES_AT_ONCE - 1:
            done.append(cut(found))
            found = None
    for part in done:
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    # of the rows that look like the query itself one is left out, and those after it move up
    like = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self")), F.col("at"))
    itself = F.min(like).over(Window.partitionBy("query", "query_id"))
    merged = merged.withColumn("itself", itself).filter(F.col("itself").isNull() | (F.col("at") != F.col("itself")))
    ranked = merged.withColumn("rank", F.when(F.col("at") > F.col("itself"), F.col("at") - 1).otherwise(F.col("at"))).filter(F.col("rank") <= k)
    answered = ranked.select("query", "query_id", "rank", "vec_id", "score")
    again = asked.filter("copies > 1").select("query", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(2).cast("long"), "copies")).alias("copy"))
    more = answered.join(again, ["query", "query_id"]).drop("copy")
    return answered.unionByName(more).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

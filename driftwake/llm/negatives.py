"""Hard negatives by one-dimensional distance keys.

Inner product becomes distance: every vector gets one more component, sqrt(M^2 - |x|^2) with M the greatest length, so
that all rows lie on one sphere and, for an anchor q with a zero there, d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Each row belongs
to its nearest pivot and is stored sorted by (pivot, distance to it). By the triangle inequality a row within R of the anchor
has a key within R of the anchor's own distance to that pivot, so a search reads an interval of keys a pivot.

A search has windows of scores (the positives' search: one without ends; each positive's negatives: between half and
95 % of its score) and wants the best k of each. Intervals grow in ROUNDS steps from the distance of a window's upper end to a
distance that is sure to hold k rows: that of the k-th best of a sample that is in the window, or the window's lower end.
Each step reads only the ring that the steps before left out. A search is done once no row still unread can beat its k-th best.
The anchors still searching are met in blocks of at most QUERY_BLOCK, of near anchors, each broadcast alone; the part of the
store that no anchor of a block can need is left out by a filter on its sort columns.

Sizes: the sample (SAMPLE rows, in the order of a hash; PIVOTS of them are pivots) only sets where intervals begin and end; what
is returned does not depend on it. On vectors without clusters keys tell little apart and all rows are read, once an anchor.

Edge cases: rows with a null id, null label, null vector or any null or non-finite component take no part; shorter vectors
count as if filled with zeros; rows that repeat an anchor's id are that anchor, not others, and each of them is answered; other
repeated rows are candidates each; fewer rows than asked for give all; positives of a score below zero have no negatives,
for then the lower bound is above the upper; an empty table, or one without anchors, gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwake.llm.common import cut, release, table, written
from driftwake.llm.topk import best, matrix

SCALE = 256
EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = 50, 95  # percent of the positive's score
SAMPLE = 4096
PIVOTS = 64
ROUNDS = (0.5, 0.75, 1.0)
QUERY_BLOCK = 16384
TASKS = 512
SLACK = 1e-6  # of M; what rounding can do to a distance
NONE = -(1 << 62)  # a window without a lower end


def vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """id, label, v (integers) and their squared length, of the rows that take part."""
    v = F.col(vec_col)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    known = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole)
    out = known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return out.withColumn("square", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))


class Space:
    """The sphere: pivots, the sample, and distances on it. Broadcast; its size is fixed."""

    def __init__(self, ids, labels, v, width: int, top: int, exact: bool, pivots: int):
        self.width, self.top, self.exact = width, float(top), exact
        self.kind = np.int64 if exact else np.float64
        self.ids, self.labels, self.v = ids, labels, v.astype(self.kind)
        _, first = np.unique(v, axis=0, return_index=True)
        at = np.sort(first)[:pivots]
        self.pivots = v[at].astype(np.float64)
        self.square = (self.pivots**2).sum(1)
        self.lift = np.sqrt(np.maximum(self.top - self.square, 0))
        self.slack = SLACK * np.sqrt(self.top)

    def to_pivots(self, v: np.ndarray, square: np.ndarray, asked: bool) -> np.ndarray:
        """Distances of rows, or of anchors (whose added component is zero), to all pivots."""
        lift = np.zeros(len(v)) if asked else np.sqrt(np.maximum(self.top - square, 0))
        d = square[:, None] + self.square - 2 * (v.astype(np.float64) @ self.pivots.T) + (lift[:, None] - self.lift) ** 2
        return np.sqrt(np.maximum(d, 0))

    def distance(self, square, score):
        """Of an anchor to a row, from their inner product."""
        return np.sqrt(np.maximum(square + self.top - 2.0 * np.asarray(score, np.float64), 0))


def space_of(rows: DataFrame, sample: int, pivots: int) -> Space | None:
    facts = rows.agg(F.max(F.size("v")), F.max("square"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).head()
    if facts[1] is None:
        return None
    width = max(facts[0], 1)
    exact = width * float(facts[2] or 0) ** 2 >= 2.0**53  # else doubles hold every sum exactly
    some = rows.orderBy(F.xxhash64("id", "label", "v"), "id", "label").limit(sample).select("id", "label", "v").toPandas()
    v = matrix(pa.array(some["v"].tolist(), pa.list_(pa.int64())), width)
    return Space(some["id"].to_numpy(np.int64), some["label"].to_numpy(np.int64), v, width, facts[1], exact, pivots)


def stored(rows: DataFrame, space: Space) -> tuple[DataFrame, object]:
    """The rows with pivot and distance, as a table sorted by both; what deletes it."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            d = s.to_pivots(matrix(b.column(2), s.width), b.column(3).to_numpy().astype(np.float64), False)
            near = d.argmin(1) if len(d) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near], pa.float64()), *b.columns[:3]], names=["pivot", "key", "id", "label", "v"])

    keyed = rows.select("id", "label", "v", "square").mapInArrow(run, "pivot int, key double, id long, label long, v array<long>")
    tasks = max(TASKS, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return written(keyed.repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id").coalesce(tasks))


class Block:
    """Anchors searching together, with their windows side by side, padded to the most windows of one of them."""

    def __init__(self, space: Space, p):
        self.key, self.id, self.label = (p[c].to_numpy(np.int64) for c in ("query", "id", "label"))
        self.v = matrix(pa.array(p["v"].tolist(), pa.list_(pa.int64())), space.width).astype(space.kind)
        self.windows = [np.array([(w["at"], w["low"], w["high"]) for w in ws], np.int64).reshape(-1, 3) for ws in p["windows"]]
        self.near, self.far = p["near"].to_numpy(np.float64), p["far"].to_numpy(np.float64)
        self.start = p["start"].to_numpy(np.float64)
        square = (self.v.astype(np.float64) ** 2).sum(1)
        self.pivot = space.to_pivots(self.v, square, True)

    def pruned(self, store: DataFrame, space: Space) -> DataFrame:
        """Only keys that some anchor of the block can need."""
        low, high = (self.pivot - self.far[:, None]).min(0) - space.slack, (self.pivot + self.far[:, None]).max(0) + space.slack
        return store.filter(" OR ".join(f"(pivot = {i} AND key >= {a!r}D AND key <= {b!r}D)" for i, (a, b) in enumerate(zip(low.tolist(), high.tolist()))))


def runs(pivot: np.ndarray, key: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of one pivot in the order of keys."""
    ends = np.flatnonzero((pivot[1:] != pivot[:-1]) | (key[1:] < key[:-1])) + 1
    edges = [0, *ends.tolist(), len(pivot)]
    return list(zip(edges, edges[1:]))


def ring(space: Space, block: Block, pivot: int, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor the two slices of a run that this step adds: keys at most `far` off, but not those at most `near` off,
    nor rows so near the pivot that they lie within `start` of the anchor."""
    d = block.pivot[:, pivot]
    low = np.searchsorted(key, np.maximum(d - block.far - space.slack, block.start - d - space.slack), "left")
    high = np.searchsorted(key, d + block.far + space.slack, "right")
    fresh = block.near < 0
    inner = np.where(fresh, high, np.searchsorted(key, d - block.near - space.slack, "left"))
    outer = np.where(fresh, high, np.searchsorted(key, d + block.near + space.slack, "right"))
    return low, np.minimum(inner, high), np.maximum(outer, low), high


def scan(store: DataFrame, block: Block, space: Space, k: int, same: bool) -> DataFrame:
    """The best k of each window among the rows this step adds: query, at, id, score."""
    spark = store.sparkSession
    shared = spark.sparkContext.broadcast((space, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, q = shared.value
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            pivots, keys, ids, labels = (b.column(i).to_numpy() for i in range(4))
            rows = matrix(b.column(4), s.width).astype(s.kind)
            for start, end in runs(pivots, keys):
                slices = ring(s, q, int(pivots[start]), keys[start:end])
                some = np.flatnonzero((slices[0] < slices[1]) | (slices[2] < slices[3]))
                for i in some.tolist():
                    for a, z in ((slices[0][i], slices[1][i]), (slices[2][i], slices[3][i])):
                        if a >= z:
                            continue
                        part = slice(start + a, start + z)
                        scores = (rows[part] @ q.v[i]).astype(np.int64)
                        fits = ((labels[part] == q.label[i]) == same) & (ids[part] != q.id[i])
                        for at, low, high in q.windows[i].tolist():
                            won = np.flatnonzero(fits & (scores >= low) & (scores <= high))
                            if len(won):
                                old = held.get((i, at))
                                found = ids[part][won], scores[won]
                                held[i, at] = best(*(found if old is None else (np.concatenate((o, f)) for o, f in zip(old, found))), k)
        if held:
            n = [len(x[0]) for x in held.values()]
            who = np.repeat([i for i, _ in held], n)
            cols = (q.key[who], np.repeat([at for _, at in held], n).astype(np.int32), *(np.concatenate([x[j] for x in held.values()]) for j in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "at", "id", "score"])

    kept = block.pruned(store, space)
    return kept.mapInArrow(run, "query long, at int, id long, score long")


def first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "at").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bounded(asked: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """asked (query, id, label, v, windows) with where intervals start and the distance at which the search must be done;
    windows' lower ends are raised to what the sample has already shown to be there."""
    shared = asked.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        s = shared.value
        for p in batches:
            v = matrix(pa.array(p["v"].tolist(), pa.list_(pa.int64())), s.width)
            square = (v.astype(np.float64) ** 2).sum(1)
            scores = (v.astype(s.kind) @ s.v.T).astype(np.int64) if len(v) else np.empty((0, len(s.ids)), np.int64)
            start, end, raised = [], [], []
            for i in range(len(p)):
                fits = ((s.labels == p["label"].iloc[i]) == same) & (s.ids != p["id"].iloc[i])
                mine, new = scores[i][fits], []
                for w in p["windows"].iloc[i]:
                    at, low, high = w["at"], w["low"], w["high"]
                    inside = mine[(mine >= low) & (mine <= high)]
                    if len(inside) >= k:
                        low = int(np.partition(inside, len(inside) - k)[len(inside) - k])
                    new.append({"at": at, "low": low, "high": high})
                whole = np.sqrt(square[i]) + np.sqrt(s.top)
                start.append(min(float(s.distance(square[i], w["high"])) for w in new))
                end.append(max(whole if w["low"] == NONE else min(whole, float(s.distance(square[i], w["low"]))) for w in new) + s.slack)
                raised.append(new)
            yield p.assign(windows=raised, start=start, end=end, reached=-1.0, square=square, home=s.to_pivots(v, square, True).argmin(1))

    return asked.mapInPandas(run, f"{', '.join(f'{c} {t}' for c, t in asked.dtypes)}, start double, end double, reached double, square double, home int")


def search(store: DataFrame, asked: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """The best k of each window of each anchor: query, at, rank, id, score. asked: query, id, label, v, windows."""
    spark = store.sparkSession
    open_ = cut(bounded(asked, space, k, same))
    found: DataFrame | None = None
    for step in ROUNDS:
        now = open_.withColumn("near", F.col("reached")).withColumn("far", F.col("start") + step * (F.col("end") - F.col("start")))
        n = now.count()
        if not n:
            break
        passes = -(-n // QUERY_BLOCK)
        parted = now.withColumn("block", F.lit(0)) if passes == 1 else now.repartitionByRange(passes, "home", "query").withColumn("block", F.spark_partition_id())
        parted = cut(parted)
        added = [] if found is None else [found.drop("rank")]
        for p in range(passes):
            rows = parted.filter(F.col("block") == p).toPandas()
            added += [scan(store, Block(space, rows.iloc[a : a + QUERY_BLOCK]), space, k, same) for a in range(0, len(rows), QUERY_BLOCK)]
        old, found = found, cut(first(reduce(DataFrame.unionByName, added), k))
        if old is not None:
            release(old)
        # a window is done if it has k rows, the last of them nearer than anything unread
        worst = found.filter(F.col("rank") == k).select("query", "at", F.col("score").alias("worst"))
        each = now.select("query", F.explode("windows").alias("w"), "far", "square").select("query", "far", "square", F.col("w.at").alias("at"), F.col("w.low").alias("low"))
        reach = F.greatest(F.lit(0.0), F.col("far") - space.slack)
        unread = (F.col("square") + space.top - reach * reach) / 2  # scores of what is unread are below
        left = each.join(worst, ["query", "at"], "left").filter((F.col("low") <= unread) & (F.col("worst").isNull() | (F.col("worst") <= unread)))
        last = step == ROUNDS[-1]
        new = None if last else cut(now.withColumn("reached", F.col("far")).drop("near", "far").join(left.select("query").distinct(), "query", "left_semi"))
        release(open_, parted)
        open_ = new
    if open_ is not None:
        release(open_)
    return found if found is not None else spark.createDataFrame([], "query long, at int, id long, score long, rank int")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors are rows of `rows`."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    pool = vectors(rows, id_col, vec_col, label_col)
    space = space_of(pool, sample, pivots)
    if space is None:
        return none
    asked = vectors(anchors, id_col, vec_col, label_col).groupBy("id", "label", "v").agg(F.count("*").alias("copies"))
    asked = cut(asked.withColumn("query", F.xxhash64("id", "label", "v")))
    store, drop = stored(pool, space)
    whole = F.array(F.struct(F.lit(1).alias("at"), F.lit(NONE).cast("long").alias("low"), F.lit(-NONE).cast("long").alias("high")))
    best_ = search(store, asked.select("query", "id", "label", "v", whole.alias("windows")), space, positives, True)
    # integer ends: ceil(least / 100 * score) and floor(most / 100 * score)
    low, high = F.expr(f"-floor(-score * {least}L / 100.0D)").cast("long"), F.expr(f"floor(score * {most}L / 100.0D)").cast("long")
    low, high = (low + ((low * 100) < F.col("score") * least).cast("long")), (high - ((high * 100) > F.col("score") * most).cast("long"))
    windows = best_.withColumn("low", low).withColumn("high", high).filter("low <= high")
    windows = windows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("at"), "low", "high"))).alias("windows"))
    found = search(store, asked.select("query", "id", "label", "v").join(windows, "query"), space, negatives, False)
    pairs = best_.select("query", F.col("rank").alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    one = found.join(pairs, ["query", "at"]).join(asked.select("query", F.col("id").alias("anchor_id"), "copies"), "query")
    out = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    out = cut(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    release(best_, found, asked)
    drop()
    return out


def op13_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", "embedding", moved.alias("label"))
    return mine(rows, rows.filter(F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

"""URL filter: rules by host and path, and where none fits a character language-model ratio.

Two Markov models of variable order, of accepted and of rejected URLs, give the log-likelihood of a URL; their
difference, divided by its length, is compared with a threshold calibrated on URLs that the models have not seen. The
order is variable by smoothing: the estimate of a context is the count of what followed it plus SMOOTH times the
estimate of the context one character shorter, so long contexts speak as far as they have been seen. Contexts are
hashed to fixed tables. The labelled URLs are those that the rules judge, all of them: four fifths, by a hash of the URL, are counted
where they lie and the tables added up; the last fifth sets the threshold, by counts of ratios in steps of 1 / STEPS.

Edge cases: a null url, or one without ://, has an empty host and path; no rule fits it, and the models judge its
text (null: empty, which is allowed); where one class has no URL to learn from, all is allowed; repeated rows are judged
as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm.common import ascii_lower, table

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BACK = 5  # one in so many URLs is kept back for the threshold
STEPS = 4096
ORDER = 5
TABLE = 1 << 18
SMOOTH = 4.0


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, of: int) -> Column:
    """Of the longest rule that fits: its text (0) or its verdict (1), else null."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.lit((h + p, verdict)[of])).otherwise(out)
    return out


def slots(url: bytes, order: int = ORDER) -> np.ndarray:
    """For each character (row) and order (column) the table slot of its context; the last column is the character."""
    data = np.frombuffer(bytes(order) + url, np.uint8).astype(np.uint64)
    n = len(url)
    out = np.empty((n, order + 2), np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(order + 1):
        if k:
            h = (h ^ (data[order - k : order - k + n] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, k] = (h + np.uint64(k)) % np.uint64(TABLE)
    out[:, -1] = data[order:]
    return out


def add(context: np.ndarray, after: np.ndarray, urls: list[bytes]) -> None:
    """Adds the URLs' contexts, and characters after them, to tables of counts."""
    for a in range(0, len(urls), 4096):
        s = np.concatenate([slots(u) for u in urls[a : a + 4096]])
        for k in range(ORDER + 1):
            context[k] += np.bincount(s[:, k], minlength=TABLE).astype(context.dtype)
            after[k] += np.bincount(Markov.pair(s, k), minlength=TABLE).astype(after.dtype)


class Markov:
    """Counts of contexts and of characters after them, for orders 0 to ORDER."""

    def __init__(self, urls: list[bytes] = (), counts: np.ndarray | None = None):
        self.context, self.after = np.zeros((2, ORDER + 1, TABLE), np.float32) if counts is None else counts.astype(np.float32)
        add(self.context, self.after, urls)

    @staticmethod
    def pair(s: np.ndarray, k: int) -> np.ndarray:
        return (s[:, k] * 257 + s[:, -1] * 7919) % TABLE

    def log2(self, s: np.ndarray) -> float:
        p = np.full(len(s), 1 / 256)
        for k in range(ORDER + 1):
            p = (np.minimum(self.after[k][self.pair(s, k)], self.context[k][s[:, k]]) + SMOOTH * p) / (self.context[k][s[:, k]] + SMOOTH)
        return float(np.log2(p).sum())


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov
    least: float = 0.0  # verdicts are allow from here on

    def of(self, url: bytes) -> float:
        if not url:
            return self.least
        s = slots(url)
        return (self.accepted.log2(s) - self.rejected.log2(s)) / len(url)


def tables(known: DataFrame) -> np.ndarray:
    """known(kind 0 or 1, url) -> counts by kind, contexts or characters, order and slot. A task adds up what it reads; 24 tables of
    fixed size a task are shuffled and added, and as many come to the driver."""
    shape, cores = (2, 2, ORDER + 1, TABLE), known.sparkSession.sparkContext.defaultParallelism

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(shape, np.int64)
        for b in batches:
            urls, kinds = b.column("url").to_pylist(), b.column("kind").to_pylist()
            for kind in (0, 1):
                add(*n[kind], [u.encode() for u, k in zip(urls, kinds) if k == kind])
        for block, row in enumerate(n.reshape(-1, TABLE)):
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([row.tobytes()])], names=["block", "n"])

    def total(block: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_buffer(), np.int64) for c in block.column("n").chunks for x in c)
        return pa.table({"block": block.column("block")[:1], "n": pa.array([n.tobytes()])})

    out = np.zeros((4 * (ORDER + 1), TABLE), np.int64)
    told = known.coalesce(cores).mapInArrow(count, "block int, n binary")
    for r in told.groupBy("block").applyInArrow(total, "block int, n binary").collect():
        out[r[0]] = np.frombuffer(r[1], np.int64)
    return out.reshape(shape)


def threshold(counts: list[tuple[int, int, int]]) -> float:
    """(kind, ratio in steps, URLs) -> the ratio with the best balanced accuracy, the middle one of equally good ones."""
    low, high = min(c[1] for c in counts), max(c[1] for c in counts)
    n = np.zeros((2, high - low + 1), np.int64)
    for kind, step, k in counts:
        n[kind, step - low] += k
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(n, axis=1)), axis=1)
    right = 1 - below[1] / max(1, below[1, -1]) + below[0] / max(1, below[0, -1])
    top = np.flatnonzero(right >= right.max() - 1e-12)
    return (low + int(top[len(top) // 2])) / STEPS


def train(known: DataFrame) -> Ratio | None:
    """known(kind, url, back): kind 1 is accepted, 0 rejected; those kept back set the threshold."""
    there = {(r[0], r[1]) for r in known.select("kind", "back").distinct().collect()}
    if {k for k, _ in there} != {0, 1}:
        return None
    fold = lambda back: known.filter(F.when(F.col("kind") == 1, (F.col("back") == back) | F.lit((1, back) not in there)).otherwise((F.col("back") == back) | F.lit((0, back) not in there)))  # noqa: E731  all, where a class has none
    n = tables(fold(False).select("kind", "url"))
    ratio = Ratio(Markov(counts=n[1]), Markov(counts=n[0]))
    shared = known.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = [math.floor(shared.value.of(u.encode()) * STEPS) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(step, pa.int64())], names=["kind", "step"])

    steps = fold(True).select("kind", "url").mapInArrow(run, "kind int, step long").groupBy("kind", "step").agg(F.count("*")).collect()
    ratio.least = threshold([tuple(r) for r in steps])
    return ratio


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (of the models; null where a rule judges)."""
    spark, url = pages.sparkSession, F.col("_url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("_url"))
    rows = rows.withColumn("host", host(url)).withColumn("path", path(url))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), 0)).withColumn("ruled", rule(F.col("host"), F.col("path"), 1))
    back = F.pmod(F.xxhash64("_url"), F.lit(BACK)) == BACK - 1
    model = train(rows.filter(F.col("ruled").isNotNull()).select((F.col("ruled") == "allow").cast("int").alias("kind"), url.alias("url"), back.alias("back")))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for b in batches:
            verdicts, ratios = [], []
            for u, ruled in zip(b.column("_url").to_pylist(), b.column("ruled").to_pylist()):
                r = None if ruled or ratio is None else ratio.of((u or "").encode())
                ratios.append(r)
                verdicts.append(ruled or ("allow" if r is None or r >= ratio.least else "block"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(ratios, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "ratio"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, ratio double")


def op5_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

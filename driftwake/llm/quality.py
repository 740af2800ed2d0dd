"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: one a word, one a pair of neighbouring words, and one a character n-gram of a
word, hashed to a fixed number of buckets; a softmax over that average gives the label. Vectors and output are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows (SAMPLE_ROWS, SAMPLE_BYTES; taken
in the order of a hash of the id, so alike at every size) by one task of an executor. Scoring is linear in the vectors, so each bucket shrinks to
one number: what is sent to the executors is one float a bucket, and every document is scored by whole text.

Edge cases: a null text is empty; an empty text gets the score of no features; if the learnable labels lack a class,
every score is the share of label 1 among them (1.0 where there are none); rows with null ids or labels teach nothing;
repeated documents are scored as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm.common import in_batches, table

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64 << 20
BUCKETS = 1 << 18
DIMENSIONS = 16
GRAMS = (3, 4)
EPOCHS = 5
RATE = 0.5
KEEP = 0.7
CACHED = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)
PART_WORDS = 200_000  # of texts scored together


def features(word: bytes) -> list[int]:
    """Buckets of the word and of its character n-grams, its ends marked. N-grams are of code points."""
    out = [zlib.crc32(word) % BUCKETS]
    text = "<" + word.decode() + ">"
    for n in GRAMS:
        out += [zlib.crc32(text[i : i + n].encode(), n) % BUCKETS for i in range(len(text) - n + 1)]
    return out


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


class Words(dict):
    """Words by number: each one's hash, and what `facts` tells of it. New words wait until they are learnt together."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def pairs(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; last: where a text's last word stands, which has no neighbour after it."""
    x = (hashes[:-1] * MIX + hashes[1:]) * MIX
    x ^= x >> np.uint64(29)
    out = ((x * MIX) >> np.uint64(32)).astype(np.int64) % BUCKETS
    out[last[last < len(out)]] = -1
    return out


def hashed(words_: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) + 1 for w in words_), np.uint64, len(words_))


@dataclass
class Model:
    weights: np.ndarray | None  # a number for each bucket
    bias: float

    def scorer(self):
        """texts -> probability of label 1 of each. Sums of a word's buckets are kept, up to CACHED words at once."""
        if self.weights is None:
            return lambda texts: [self.bias] * len(texts)
        weight, known = self.weights.astype(np.float64), Words()
        listed, sums, sizes, hashes = weight.tolist(), np.empty(0), np.empty(0), np.empty(0, np.uint64)

        def part(found: list[list[bytes]]) -> np.ndarray:
            nonlocal known, sums, sizes, hashes
            if len(known) > CACHED:
                known, sums, sizes, hashes = Words(), np.empty(0), np.empty(0), np.empty(0, np.uint64)
            n = np.array([len(w) for w in found])
            code = np.fromiter((known[w] for ws in found for w in ws), np.int64, int(n.sum()))
            if known.new:
                f = [features(w) for w in known.new]
                sums = np.concatenate((sums, [sum(map(listed.__getitem__, x)) for x in f]))
                sizes = np.concatenate((sizes, [len(x) for x in f]))
                hashes = np.concatenate((hashes, hashed(known.new)))
                known.new = []
            doc = np.repeat(np.arange(len(found)), n)
            total, count = np.bincount(doc, sums[code], len(found)), np.bincount(doc, sizes[code], len(found))
            if len(code) > 1:
                two = pairs(hashes[code], np.cumsum(n)[n > 0] - 1)
                own = two >= 0
                total += np.bincount(doc[:-1][own], weight[two[own]], len(found))
                count += np.bincount(doc[:-1][own], minlength=len(found))
            x = self.bias + np.divide(total, count, out=np.zeros(len(found)), where=count > 0)
            return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

        def score(texts: list[str | None]) -> list[float]:
            out, found, size = [], [], 0
            for t in texts:
                found.append(words(t))
                size += len(found[-1])
                if size > PART_WORDS:
                    out += part(found).tolist()
                    found, size = [], 0
            return out + (part(found).tolist() if found else [])

        return score


def buckets(text: str | None, known: dict[bytes, array]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text, and each one's share."""
    found = words(text)
    counts: Counter = Counter()
    for word, times in Counter(found).items():
        for f in known.get(word) or known.setdefault(word, array("i", features(word))):
            counts[f] += times
    if len(found) > 1:
        counts.update(pairs(hashed(found), np.empty(0, np.int64)).tolist())
    ids, n = np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))
    return ids, n / max(1.0, n.sum())


def train(rows: list[tuple[str | None, int]], seed: int = 1) -> Model:
    labels = [int(bool(q)) for _, q in rows]
    if len(set(labels)) < 2:
        return Model(None, float(labels[0]) if labels else 1.0)
    known: dict[bytes, array] = {}
    docs = [buckets(text, known) for text, _ in rows]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * len(docs)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, share = docs[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            hidden = share @ vectors[ids]
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            wrong = p / p.sum()
            wrong[labels[i]] -= 1
            back = wrong @ out
            out -= rate * np.outer(wrong, hidden)
            bias -= rate * wrong * np.float32(0.1)
            # a share is one over thousands; the step a vector takes is for the document, spread by share
            vectors[ids] -= (rate * len(ids) ** 0.5) * share[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def remainder(id_: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(modulus))


def held_out(id_: Column) -> Column:
    return F.coalesce(remainder(id_, 4) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from rows of labels that aren't held out and have a document."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    picked = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)  # of both kinds; at most SAMPLE_ROWS rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = texts.join(F.broadcast(picked), "id").select("id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("id").alias("h"))
    chosen, room = [], SAMPLE_BYTES
    for r in sorted(sized.groupBy("id", "y", "h").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r["h"], r["id"])):
        if r["n"] <= room:
            chosen.append((r["id"], r["y"]))
            room -= r["n"]
    if not chosen:
        return Model(None, 1.0)
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, "id long, y int")
    sample = texts.join(F.broadcast(ids), "id").select("id", "y", "text").repartition(1)  # at most SAMPLE_BYTES of text

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if rows:
            model = train([(t, y) for _, y, t in sorted(rows, key=lambda r: (r[0], r[2] or ""))])
            yield pa.RecordBatch.from_arrays([pa.array([None if model.weights is None else model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    found = sample.mapInArrow(learn, "weights binary, bias double").head()  # one number a bucket
    if found is None:
        return Model(None, 1.0)
    return Model(None if found["weights"] is None else np.frombuffer(found["weights"], np.float32), found["bias"])


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The named columns of docs, and `name` (which replaces one of that name)."""
    columns = [c for c in columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passed = [*columns, *([] if text_col in columns else [text_col])]
    at, n = passed.index(text_col), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value.scorer()
        for b in batches:
            scores = pa.array(one(b.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], scores], names=[*columns, name])

    rows = in_batches(docs.select(*(F.col(f"`{c}`") for c in passed)))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:n])
    return rows.mapInArrow(run, f"{schema}, `{name}` double" if n else f"`{name}` double")


def op8_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))

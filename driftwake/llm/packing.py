"""Packing token sequences by best-fit decreasing.

A document's ids are cut into full windows and one rest. Pieces of one length are interchangeable, so best-fit
decreasing needs only the number of pieces of each length, of which there are at most `window`: that histogram
comes to the driver, a segment tree indexed by remaining capacity finds the tightest open windows, and the plan
(ranges of ranks of a length -> ranges of sequences) is applied to all pieces where they lie. The packing is that
of one sequential run over all pieces, with no task that holds them.

Edge cases: a null text is empty, and an empty text is one id (the end); documents with repeated or null ids are
packed as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwake.llm.common import cut, in_batches, table

WINDOW = 2048
END = 1
SPECIAL = "<|endoftext|>"  # the vocabulary's one added token: one id wherever it stands in a text

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE whose ranks lie at path, once per Python worker. Its ids are those of the JSON file of
    the same vocabulary, its special token included (tests hold the two together); it is several times as fast."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {SPECIAL: len(ranks)} if len(ranks) not in ranks.values() else {}  # the id after the last rank
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def pieces(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Every document's pieces. part and nth number the pieces of a length within a task, which later gives each
    its rank among all of that length by adding the counts of the tasks before."""
    vocabulary = vocabulary or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocabulary).encode_to_numpy, TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or "", allowed_special="all").astype("<u4"), np.uint32(END)).astype("<u4")
                n, raw = len(ids), memoryview(ids.tobytes())
                for start in range(0, n, window):
                    length = min(window, n - start)
                    row = (doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, part, seen[length])
                    seen[length] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 5 + [pa.int32(), pa.int64()])], names=[c.split()[0] for c in PIECES.split(", ")])

    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, PIECES)


class Capacities:
    """A segment tree over remaining capacities 0..window: which have open windows, and the least that is enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, present: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:  # up to where a right sibling has something, then down its left edge
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, first rank, pieces a window, first sequence, first offset): from that rank on, that many pieces
    of the length fill each sequence in turn. Placing a piece leaves its window the tightest that can take the next
    of the same length, if it can, so each window of a group takes as many as fit before the next is touched.
    """
    tree, open_ = Capacities(window), [[] for _ in range(window + 1)]
    rows, sequences = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_[capacity].append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, per = window, window // length
                first, n = sequences, -(-left // per)
                sequences += n
            else:
                first, n = open_[capacity].pop()
                tree.set(capacity, bool(open_[capacity]))
                per = capacity // length
            rows.append((length, rank, per, first, window - capacity))
            placed = min(left, n * per)
            full, rest = divmod(placed, per)
            put(capacity - per * length, first, full)
            put(capacity - rest * length, first + full, 1 if rest else 0)
            put(capacity, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + placed, left - placed
    return rows


def pack(docs: DataFrame, window: int = WINDOW, **columns) -> DataFrame:
    made = cut(pieces(docs, window, **columns))  # numbered once: later passes must see the same numbers
    counts = made.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `window` rows
    rows = sorted(plan(total, window))
    length, rank, per, first, offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 5))
    keys = (length << 48) + rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, (n << 48) + r, "right") - 1
            nth = r - rank[i]
            kept = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[i] + nth // per[i]), pa.array(offset[i] + nth % per[i] * n)], names=[*PACKED])

    ranked = made.join(bases, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, ", ".join(f"{c} long" for c in PACKED))


PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

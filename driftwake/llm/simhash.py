"""SimHash near-duplicates with pivot distance tables.

Texts become 64-bit fingerprints; one row a distinct fingerprint goes on, so copies never multiply. Each fingerprint's
Hamming distances to reference fingerprints (pivots) are its coordinates: by the triangle inequality two fingerprints
whose coordinates differ by more than the bound anywhere are further apart than it.

Distances to whole references gather round 32, which as a partition would leave a share of all pairs that grows with the
square of the table. So each reference is confined to one of bound + 2 groups of bits, where distances spread. The
groups' distances add up to the whole one, so the greatest differences of coordinates in each group, added up, are at most
the distance too; of a pair within the bound, at least two groups differ in no coordinate. Fingerprints therefore meet where
all coordinates of two groups are equal, and all other pairs are discarded by their coordinates before any meets.

Within a meeting the table of whole references and the sums over the other groups' coordinates discard again, and survivors are
verified by their own distance. Linked fingerprints leave the search as they are reached, so a dense meeting costs little
more than linear time. A meeting of more than CROWD goes on to coordinates over its other bits, which loses no pair; as
references of a group tell all its bits apart, one with `f` free bits holds 2**f fingerprints at most, so this ends.

Edge cases: a null or empty text has no words and fingerprint zero, linked like any other; equal rows have equal
fingerprints and one component; rows with null ids take part, and a component of null ids alone has a null component_id;
an empty table gives no rows; other columns are ignored. Ids are longs (2**63 - 1 stands for null) or cast to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm.common import cut, in_batches, joined_to_one, table
from driftwake.llm.components import roots

SHINGLE = 4
BOUND = 4
PIVOTS = 32
CROWD = 4096
FEW_BITS = 12  # so few free bits make 4,096 fingerprints at most
SEED = 42


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        count += np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and exactly \x20\x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: list[Column] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the longs of row, named r0, r1 and so on."""
    names = [f"r{i}" for i in range(len(row))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["doc_id", "fp", *names])

    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(n) for c, n in zip(row, names)))
    return in_batches(told).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *names)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups(free: int, bound: int) -> list[int]:
    """The free bits as masks of bound + 2 groups."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << int(i) for i in p) for p in np.array_split(bits, bound + 2)]


def references(mask: int) -> np.ndarray:
    """Pivots confined to a group: with the group's bits set one after another, in a fixed order that is no bit order.
    Distances to two that follow each other differ by the one bit, so together they tell all of the group's bits."""
    bits = np.random.default_rng(mask).permutation([i for i in range(64) if mask >> i & 1])
    return np.cumsum([0, *(1 << int(b) for b in bits)], dtype=np.uint64)


def confined(fps: np.ndarray, mask: int) -> np.ndarray:
    """Coordinates in a group: a row a reference, a column a fingerprint."""
    own = fps & np.uint64(mask)
    return np.stack([np.bitwise_count(own ^ r) for r in references(mask)]).astype(np.int8)


def code(table: np.ndarray) -> np.ndarray:
    """One number for each column of coordinates, equal for equal columns."""
    out = np.zeros(table.shape[1], np.uint64)
    for row in table:
        out = mixed(out + row.astype(np.uint64) + np.uint64(1))
    return out


ROWS = "meeting long, free long, fp long, id long"


def meetings(rows: DataFrame, bound: int) -> DataFrame:
    """(meeting, free, fp, id) -> the meetings by equal coordinates in each two groups of the free bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meeting, free, fp = (b.column(c).to_numpy().view(np.uint64) for c in ("meeting", "free", "fp"))
            ids = b.column("id").to_numpy()
            for value in np.unique(free).tolist():
                own = free == value
                masks = groups(value, bound)
                codes = [code(confined(fp[own], m)) for m in masks]
                for i, (x, y) in enumerate(combinations(range(len(masks)), 2)):
                    key = mixed(mixed(meeting[own] + np.uint64(i)) ^ mixed(codes[x] + mixed(codes[y])))
                    left = np.full(len(key), value & ~(masks[x] | masks[y]), np.uint64)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in (key, left, fp[own])), pa.array(ids[own])], names=["meeting", "free", "fp", "id"])

    return rows.mapInArrow(run, ROWS)


def coordinates(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """The table of distances to whole references: a row a reference, a column a fingerprint."""
    refs = np.random.default_rng(7).integers(0, 1 << 64, pivots, np.uint64)
    return np.stack([np.bitwise_count(fps ^ r) for r in refs]).astype(np.int8) if len(fps) else np.empty((pivots, 0), np.int8)


def survivors(one: int, table: np.ndarray, others: np.ndarray, bound: int) -> np.ndarray:
    """Of others (positions), those whose coordinates differ by at most bound from those of position one."""
    for row in table:
        others = others[np.abs(row[others] - row[one]) <= bound]
        if len(others) < 8:
            break
    return others


def spanning(fps: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join what is connected within one meeting: each is verified, none closes a circle."""
    table, waiting, a, b = coordinates(fps), np.arange(len(fps)), [], []
    while len(waiting):
        reached, waiting = [waiting[0]], waiting[1:]
        while reached and len(waiting):
            one = reached.pop()
            found = survivors(one, table, waiting, bound)
            found = found[np.bitwise_count(fps[found] ^ fps[one]) <= bound]
            if len(found):
                a.append(np.full(len(found), one))
                b.append(found)
                waiting = waiting[~np.isin(waiting, found, assume_unique=True)]
                reached += found.tolist()
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


FOUND = "meeting long, free long, a_fp long, a_id long, b_fp long, b_id long"


def links(met: DataFrame, bound: int, crowd: int) -> DataFrame:
    """(meeting, free, fp, id), equal meetings in one partition and in order -> verified links that span each meeting (a to
    b, meeting null), and the rows of meetings of more than crowd as they are (in a, b null).

    Meetings of up to 8 are compared all at once along the sorted column, larger ones one by one."""

    def batch(meeting, free, a_fp, a_id, b_fp, b_id) -> pa.RecordBatch:
        n = len(a_fp)
        cols = [pa.nulls(n, pa.int64()) if c is None else pa.array(c.view(np.int64)) for c in (meeting, free, a_fp, a_id, b_fp, b_id)]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in FOUND.split(", ")])

    def pairs(meeting: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], meeting[1:] != meeting[:-1])))
        size = np.diff(np.concatenate((first, [len(meeting)])))
        small = np.flatnonzero(np.repeat(size <= 8, size))
        key, f = meeting[small], fp[small]
        table = coordinates(f, 8)
        a, b = [], []
        for k in range(1, 8):
            i = np.flatnonzero(key[k:] == key[:-k])
            for row in table:
                i = i[np.abs(row[i + k] - row[i]) <= bound]
            i = i[np.bitwise_count(f[i + k] ^ f[i]) <= bound]
            a.append(small[i])
            b.append(small[i + k])
        for at, n in zip(first[size > 8].tolist(), size[size > 8].tolist()):
            x, y = spanning(fp[at : at + n], bound)
            a.append(x + at)
            b.append(y + at)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield batch(None, None, fp[a], ids[a], fp[b], ids[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the last meeting so far, and whole ones before it
        passing = None  # a crowded meeting whose rows go on
        for b in batches:
            if not b.num_rows:
                continue
            now = tuple(c.to_numpy() for c in b.columns)
            if passing is not None:
                n = int(np.searchsorted(now[0] != passing, True))
                if n:
                    yield batch(now[0][:n], now[1][:n], now[2][:n], now[3][:n], None, None)
                if n == len(now[0]):
                    continue
                passing, now = None, tuple(x[n:] for x in now)
            held.append(now)
            meeting, free, fp, ids = (np.concatenate(x) for x in zip(*held))
            start = int(np.searchsorted(meeting != meeting[-1], False)) if meeting[0] == meeting[-1] else int(np.flatnonzero(meeting != meeting[-1])[-1]) + 1
            yield from whole(meeting[:start], free[:start], fp[:start], ids[:start])
            held = [(meeting[start:], free[start:], fp[start:], ids[start:])]
            if len(held[0][0]) > crowd and splits(held[0][1][0]):
                yield batch(*held[0], None, None)
                passing, held = held[0][0][0], []
        if held:
            yield from whole(*held[0])

    def splits(free: int) -> bool:
        return (int(free) & (1 << 64) - 1).bit_count() > FEW_BITS

    def whole(meeting, free, fp, ids) -> Iterator[pa.RecordBatch]:
        """Whole meetings: those that are crowded go on."""
        if not len(meeting):
            return
        first = np.flatnonzero(np.concatenate(([True], meeting[1:] != meeting[:-1])))
        size = np.diff(np.concatenate((first, [len(meeting)])))
        on = np.repeat([n > crowd and splits(f) for n, f in zip(size.tolist(), free[first].tolist())] if size.max() > crowd else np.zeros(len(size), bool), size)
        if on.any():
            yield batch(meeting[on], free[on], fp[on], ids[on], None, None)
        if not on.all():
            yield from pairs(meeting[~on], fp[~on].view(np.uint64), ids[~on])

    return met.mapInArrow(run, FOUND)


def near(fps: DataFrame, bound: int = BOUND, crowd: int = CROWD) -> DataFrame:
    """fps(fp, id), fp distinct -> (a_id, a_fp, b_id, b_fp): links that connect just what chains of pairs within bound connect."""
    rows = fps.select(F.lit(0).cast("long").alias("meeting"), F.lit(-1).cast("long").alias("free"), "fp", "id")
    out = None
    while True:
        met = meetings(rows, bound).repartition("meeting").sortWithinPartitions("meeting")
        told = cut(links(met, bound, crowd))
        found = told.filter("b_fp IS NOT NULL").select("a_id", "a_fp", "b_id", "b_fp")
        out = found if out is None else out.unionByName(found)
        rows = told.filter("b_fp IS NULL").select("meeting", "free", F.col("a_fp").alias("fp"), F.col("a_id").alias("id"))
        if not rows.head(1):
            return out


NONE = (1 << 63) - 1  # in place of a null id: after all others


def grouped(own: DataFrame, bound: int = BOUND) -> DataFrame:
    """own(fp, id, ...), fp distinct -> own and root: the least id (and of equal ids the fingerprint) it reaches."""
    links_ = near(own.select("fp", "id"), bound)
    found = roots(links_.select(F.struct(F.col("a_id").alias("id"), F.col("a_fp").alias("fp")).alias("a"), F.struct(F.col("b_id").alias("id"), F.col("b_fp").alias("fp")).alias("b")))
    found = found.select(F.col("node.fp").alias("node_fp"), "root")
    return own.join(found, own["fp"] == found["node_fp"], "left").drop("node_fp").withColumn("root", F.coalesce("root", F.struct("id", "fp")))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    prints = cut(fingerprints(docs, id_col, text_col))
    own = cut(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NONE)).alias("id"), F.count("*").alias("n")))
    component = grouped(own, bound).select("fp", "n", F.nullif(F.col("root.id"), F.lit(NONE)).alias("component_id"))
    return joined_to_one(prints, component, ["fp"], "n", prints.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> DataFrame:
    """docs less all rows of a component but one: that with the least id (nulls last), then the least hash of the text.
    Rows are known by 128 bits of id and text; of repeated rows one stays."""
    a, b = F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), id_col, text_col)
    prints = cut(fingerprints(docs, id_col, text_col, [a, b]))
    first = prints.groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NONE)).alias("id"), "r0", "r1")).alias("least"))
    own = cut(first.select("fp", "least.id", "least"))
    stay = grouped(own, bound).groupBy("root").agg(F.min("least").alias("least")).select("least.r0", "least.r1")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), a.alias("r0"), b.alias("r1"))  # no name of docs meets ours
    return whole.join(stay, ["r0", "r1"]).dropDuplicates(["r0", "r1"]).select("doc.*")


def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

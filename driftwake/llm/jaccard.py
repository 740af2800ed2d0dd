"""Near-duplicates by the true similarity of their shingles: texts whose sets of five-word shingles have a Jaccard
similarity of at least 0.8, and whatever chains of such pairs connect.

Equal sets are one node. SimHash fingerprints of the sets are searched by pivots as in simhash.py, within its four bits, and what links
there is held against the texts' true similarity like all else. What lies farther apart nodes find otherwise: they meet under BANDS keys of ROWS minima each; a meeting's least node is its hub. First each node
is held against its hubs alone, by the texts' true similarity: that joins what copies of one text make, however many
they are. Only meetings that then still hold more than one component are searched further: their nodes are dealt to
groups of at most 2 * CROWD so that each two that met are in one group, and within a group those of different components are
compared until they are joined or found apart. No task holds more than that many sets, and no pairs are emitted.

A pair of similarity 0.8 meets nowhere with a probability of (1 - 0.8**ROWS)**BANDS = 5e-9, a more similar one still less;
nothing that is less similar is linked.

Fingerprints alone don't do: those of texts that are similar by 0.8 differ in ten bits on average, so bits few enough to search by
(four, in simhash.py) link one such pair in thirty, and bits enough to link them leave no block of bits to meet by.

Edge cases: a text of fewer than SHINGLE words is one shingle; null and empty texts have the empty set and are equal to each
other; rows with null ids take part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.llm import simhash
from driftwake.llm.common import cut, in_batches, joined_to_one, release, written
from driftwake.llm.components import roots
from driftwake.llm.simhash import majority, mixed

SHINGLE = 5
BANDS, ROWS = 48, 5
CACHED = 400_000
CROWD = 1024
_rng = np.random.default_rng(5)
FLIP, TIMES = _rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
TIMES |= np.uint32(1)
STEPS = _rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


class Words(dict):
    """Hashes of words, kept until there are CACHED."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def shingles(text: str | None, known: Words) -> np.ndarray:
    """Hashes of the distinct shingles, in order. Words as in simhash: of bytes, A-Z alone lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * STEPS[i] + h[i : i + len(out)])
    return np.unique(out)


def keys(own: np.ndarray) -> np.ndarray:
    """The keys that a set meets others under."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(x), 1024):
        least = np.minimum(least, ((x[None, a : a + 1024] ^ FLIP) * TIMES).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed(out * STEPS[0] + row)
    return out


TOLD = "doc_id long, r0 long, r1 long, node long, fp long, keys array<long>"


def nodes(rows: DataFrame) -> DataFrame:
    """rows(doc_id, r0, r1, text) -> doc_id, r0, r1, node (names the set of shingles), fp (its SimHash), keys (none of the
    empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = Words()
        for b in batches:
            names, prints, met, ends = [], [], [], [0]
            for t in b.column(3):
                own = shingles(t.as_py(), known)
                names.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                prints.append(majority(own))
                if len(own):
                    met.append(keys(own).view(np.int64))
                ends.append(ends[-1] + BANDS * bool(len(own)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(met) if met else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, prints)), lists], names=["doc_id", "r0", "r1", "node", "fp", "keys"])

    return in_batches(rows).mapInArrow(run, TOLD)


def similar(a: int, b: int, both: int) -> bool:
    """Of sets of a and b that share both: is the similarity at least 0.8?"""
    return 5 * both >= 4 * (a + b - both)


def against_hubs(rows: DataFrame) -> DataFrame:
    """(hub, salt, later, node, text), each hub's own row (later = false) ahead of others of its part -> (a, b), links of
    true similarity. One set is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, own = Words(), None, None
        for b in batches:
            a_, b_ = [], []
            for hub, salt, later, node, text in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                mine = shingles(text.as_py(), known)
                if not later:
                    now, own = (hub, salt), mine
                elif (hub, salt) == now:
                    least, most = sorted((len(own), len(mine)))
                    if 5 * least >= 4 * most and similar(len(own), len(mine), len(np.intersect1d(own, mine, assume_unique=True))):
                        a_.append(hub)
                        b_.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a_, b_)], names=["a", "b"])

    return in_batches(rows).mapInArrow(run, "a long, b long")


def spanning(sets: list[np.ndarray], parts: list[int]) -> list[tuple[int, int]]:
    """Links (positions) that join what pairs of similar sets connect beyond their parts, which are connected already."""
    ends = np.cumsum([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(ids, ends[:-1])
    mark, sizes, part = np.zeros(int(ids.max(initial=-1)) + 1, bool), np.array([len(s) for s in sets]), np.unique(parts, return_inverse=True)[1]
    out = []
    for one in range(len(sets)):
        n = len(own[one])
        others = np.flatnonzero((part != part[one]) & (np.arange(len(sets)) > one) & (5 * sizes >= 4 * n) & (4 * sizes <= 5 * n))
        if not len(others):
            continue
        mark[own[one]] = True
        for j in others.tolist():
            if part[j] != part[one] and similar(n, len(own[j]), np.count_nonzero(mark[own[j]])):
                out.append((one, j))
                part[part == part[j]] = part[one]
        mark[own[one]] = False
    return out


def within(rows: DataFrame) -> DataFrame:
    """(team, node, part, text), equal teams in one partition and in order -> (a, b), links of true similarity."""

    def pairs(names: list[int], parts: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = spanning(sets, parts)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([names[p[i]] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, names, parts, sets = Words(), None, [], [], []
        for b in batches:
            for team, node, part, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                if team != now and names:
                    yield from pairs(names, parts, sets)
                    names, parts, sets = [], [], []
                now = team
                names.append(node)
                parts.append(part)
                sets.append(shingles(text.as_py(), known))
        if names:
            yield from pairs(names, parts, sets)

    return in_batches(rows).mapInArrow(run, "a long, b long")


BROADCAST_ROWS = 400_000


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """sets(node, fp) -> (hub, node): nodes of one fingerprint, and links that connect what chains of fingerprints within four bits connect."""
    own = cut(sets.groupBy("fp").agg(F.min("node").alias("id")))
    equal = sets.select("node", "fp").join(own, "fp").filter("node <> id").select(F.col("id").alias("hub"), "node")
    return equal.unionByName(simhash.near(own).select(F.col("a_id").alias("hub"), F.col("b_id").alias("node"))).distinct()


def near(rows: DataFrame, sets: DataFrame, crowd: int = CROWD, linked: DataFrame | None = None) -> DataFrame:
    """rows(r0, r1, text) and sets(node, keys, r0, r1 of a row that has it) -> (a, b): links that connect just what chains of similar
    pairs connect. linked(hub, node): pairs that are held against each other beside those that keys bring together."""
    met = sets.select("node", F.explode("keys").alias("key"))
    hubs = cut(met.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("n")).filter("hub < last").drop("last"))
    few = hubs.count() <= BROADCAST_ROWS
    meet = met.join(F.broadcast(hubs.drop("n")), "key") if few else joined_to_one(met, hubs, ["key"], "n", BANDS * sets.count())
    edges = meet.filter("hub <> node").select("hub", "node")
    edges = cut((edges if linked is None else edges.unionByName(linked)).distinct())
    busy = cut(edges.select(F.explode(F.array("hub", "node")).alias("node")).distinct())
    one = sets.join(busy, "node", "left_semi").select("node", "r0", "r1")
    texts, delete = written(rows.select("r0", "r1", "text").join(one, ["r0", "r1"]).dropDuplicates(["node"]).select("node", "text"))
    try:
        return cut(search(edges, sets.join(busy, "node", "left_semi").select("node", "keys"), texts, crowd))
    finally:
        delete()
        release(hubs, edges, busy)


def search(edges: DataFrame, busy: DataFrame, texts: DataFrame, crowd: int) -> DataFrame:
    most = max(crowd, edges.count() // 10_000)
    heavy = F.broadcast(cut(edges.groupBy("hub").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("parts > 1")))  # 10,000 at most
    dealt = edges.join(heavy, "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    others = dealt.select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"), F.lit(True).alias("later"), "node")
    selves = dealt.select("hub", "parts").distinct().select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("later"), F.col("hub").alias("node"))
    rows = others.unionByName(selves).join(texts, "node").select("hub", "salt", "later", "node", "text")
    first = cut(against_hubs(rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "later")))
    # meetings that still hold more than one component
    part = busy.join(roots(first), "node", "left").select("node", F.coalesce("root", "node").alias("part"), "keys")
    met = part.select("node", "part", F.explode("keys").alias("key"))
    open_ = cut(met.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.min("node").alias("hub"), F.count("*").alias("n")).filter("x < y").select("key", "hub", "n"))
    n = open_.agg(F.count("*"), F.sum("n")).head()
    if not n[0]:
        return first
    left = cut(met.join(F.broadcast(open_.drop("n")), "key") if n[0] <= BROADCAST_ROWS else joined_to_one(met, open_, ["key"], "n", n[1]))
    # one team for all that open meetings connect; large teams are dealt so that each two of their nodes meet in one
    teams = roots(left.filter("hub <> node").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    nodes_ = cut(teams.join(left.select("node", "part").distinct(), "node"))
    sized = nodes_.groupBy("root").agg(F.ceil(F.count("*") / crowd).cast("int").alias("parts"), F.count("*").alias("n"))
    nodes_ = joined_to_one(nodes_, sized, ["root"], "n", nodes_.count())
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meets = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != own))
    dealt = nodes_.select("node", "part", "root", own.alias("own"), F.explode(meets).alias("other"))
    team = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    rows = dealt.select(team.alias("team"), "node", "part").join(texts, "node").select("team", "node", "part", "text")
    return first.unionByName(within(rows.repartition("team").sortWithinPartitions("team")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less all rows of a component but one: that with the least id (nulls last), then the least hash of the text.
    Rows are known by 128 bits of id and text; of repeated rows one stays."""
    a, b = F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), a.alias("r0"), b.alias("r1"), F.col(text_col).alias("text"))
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "r0", "r1")).alias("least")
    sets = cut(nodes(rows).groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), least))  # equal sets have equal keys
    links = near(rows, sets.select("node", "keys", "least.r0", "least.r1"), linked=by_fingerprint(sets))
    groups = sets.select("node", "least").join(roots(links), "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    stay = groups.groupBy("root").agg(F.min("least").alias("least")).select("least.r0", "least.r1")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), a.alias("r0"), b.alias("r1"))  # no name of docs meets ours
    return whole.join(stay, ["r0", "r1"]).dropDuplicates(["r0", "r1"]).select("doc.*")

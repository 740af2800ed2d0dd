"""Conversation prefix trie by polynomial rolling fingerprints.

Turns are sorted over all partitions by (conversation, turn), so that a conversation of any length is spread over tasks. Numpy
scans give each turn its position and the fingerprint of all turns up to it: a sum of turn * BASE^position for each of three
primes; sums of parts are put together from what each part knows of its ends (a few numbers a partition pass through the driver).
Equal fingerprints at one depth are a group. Its representative is its smallest conversation; each member's last turn and the
fingerprint before it must be the representative's, and as that holds at every depth, equal fingerprints are equal sequences. Turns
are compared by their texts, once for all turns of one hash. Members that differ are split off, at the depth where they do and below.

Each node's smallest conversation owns a chain of nodes, from where it leaves all smaller ones down to its end. Subtree sums
go up this tree of chains by doubling (log of its height many rounds) and then down each chain by one more scan.

Edge cases: rows with a null conv_id take no part; null roles and texts are empty; null turns come first; turns of one number stand
in the order of role and then of xxhash64 of the text; repeated rows are turns each; negative ids belong to the block below
(floor division); a conversation left without turns is a member of the root and ends there; an empty table has no nodes; other
columns are ignored."""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwake.llm.common import cut, cut_in_loop, in_batches, joined_to_one, release, table, written

BLOCK = 20  # conversations that take their first turns from the first of them
HEADS = 4  # at most HEADS - 1 turns
MODULI = (2147483647, 2147483629, 2147483587)  # the three greatest primes below 2^31
BASE = 1000003
CHUNK = 1 << 16  # bytes of joined ids in a row
SPACE = r"[\x20\x09-\x0D]+"
NODE = ["depth", "f1", "f2", "s"]
ROWS = "conv long, depth long, f1 long, f2 long, p1 long, p2 long, a long, b long, level long, words long, last boolean"


def taken(conv: int) -> int:
    """How many turns a conversation takes from the first of its block."""
    return 0 if conv % BLOCK == 0 else zlib.crc32(str(conv).encode()) % HEADS


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def turns(rows: DataFrame, mask: int = -1) -> DataFrame:
    """conv, turn, role, text, their hashes a and b, and level, which tells texts of equal hashes apart."""
    out = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    out = out.withColumn("a", F.xxhash64("text").bitwiseAND(F.lit(mask))).withColumn("b", F.xxhash64("role", "text").bitwiseAND(F.lit(mask)))
    what = F.struct("role", "text")
    mixed = out.groupBy("a", "b").agg(F.min(what).alias("low"), F.max(what).alias("high")).filter("low <> high").select("a", "b")
    mixed = cut(mixed)
    if not mixed.head(1):
        release(mixed)
        return out.withColumn("level", F.lit(0).cast("long"))
    texts = out.join(mixed, ["a", "b"], "left_semi").select("a", "b", "role", "text").distinct()
    levels = cut(texts.withColumn("level", F.dense_rank().over(Window.partitionBy("a", "b").orderBy("role", "text")).cast("long")))
    return out.join(levels, ["a", "b", "role", "text"], "left").withColumn("level", F.coalesce("level", F.lit(0).cast("long")))


def in_order(df: DataFrame, *by: Column | str) -> DataFrame:
    """df sorted over all its partitions, each of which knows its number."""
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()))


@dataclass
class Run:
    """Consecutive turns of one conversation: how many, the first three, and the sum of turn * BASE^position, from 1."""

    conv: int
    n: int = 0
    first: list[tuple] = field(default_factory=list)
    total: tuple[int, ...] = (0, 0, 0)

    def then(self, more: Run, moduli: tuple[int, ...]) -> Run:
        total = tuple((t + u * pow(BASE, self.n, m)) % m for t, u, m in zip(self.total, more.total, moduli))
        return Run(self.conv, self.n + more.n, (self.first + more.first)[: HEADS - 1], total)


@dataclass
class State:
    """What has been seen of the conversation at hand and of the first one of its block."""

    now: Run | None = None
    block: Run | None = None

    def absorb(self, runs: list[Run], moduli: tuple[int, ...]) -> None:
        for r in runs:
            self.now = self.now.then(r, moduli) if self.now and self.now.conv == r.conv else r
            if r.conv % BLOCK == 0:
                self.block = self.now

    def base(self, conv: int) -> Run | None:
        return self.block if self.block and self.block.conv == conv - conv % BLOCK else None


class Turns:
    """A batch of sorted turns: its runs, and positions and sums within each."""

    def __init__(self, b: pa.RecordBatch, moduli: tuple[int, ...]):
        self.conv, self.a, self.b, self.level, self.words = (b.column(i).to_numpy() for i in range(5))
        self.moduli = moduli
        u = self.a.view(np.uint64), self.b.view(np.uint64), self.level.astype(np.uint64)
        odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
        self.turn = [((((u[0] ^ (u[1] * k)) * k) ^ (u[2] * odd[0]) ^ (u[1] >> np.uint64(29))) % np.uint64(m)).astype(np.int64) for k, m in zip(odd, moduli)]
        edges = np.flatnonzero(self.conv[1:] != self.conv[:-1]) + 1
        self.starts = np.concatenate(([0], edges))
        self.sizes = np.diff(np.concatenate((self.starts, [len(self.conv)])))
        self.at = np.arange(len(self.conv)) - np.repeat(self.starts, self.sizes) + 1
        self.terms = [t * powers(m, int(self.at.max()))[self.at] % m for t, m in zip(self.turn, moduli)]
        sums = [np.cumsum(x) for x in self.terms]
        self.sums = [(s - np.repeat(s[self.starts] - x[self.starts], self.sizes)) % m for s, x, m in zip(sums, self.terms, moduli)]

    def run(self, i: int) -> Run:
        s, n = int(self.starts[i]), int(self.sizes[i])
        first = [(*(int(t[j]) for t in self.turn), int(self.a[j]), int(self.b[j]), int(self.level[j]), int(self.words[j])) for j in range(s, s + min(n, HEADS - 1))]
        return Run(int(self.conv[s]), n, first, tuple(int(x[s + n - 1]) for x in self.sums))


def powers(m: int, n: int) -> np.ndarray:
    """BASE^0 .. BASE^n modulo m."""
    out = np.ones(1, np.int64)
    while len(out) <= n:
        out = np.concatenate((out, out * pow(BASE, len(out), m) % m))
    return out[: n + 1]


def prefix(first: list[tuple], n: int, moduli: tuple[int, ...]) -> tuple[int, ...]:
    """Fingerprint of the first n of the first turns."""
    return tuple(sum(first[i][j] * pow(BASE, i + 1, m) for i in range(n)) % m for j, m in enumerate(moduli))


def packed(f) -> tuple:
    return (f[0] << 31) | f[1], f[2]


def ends(sorted_: DataFrame, moduli: tuple[int, ...]) -> list[tuple[int, int | None, bytes]]:
    """Of each partition its number, its first conversation, and what was seen before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first, part = State(), None, None
        for b in batches:
            if b.num_rows:
                t = Turns(b, moduli)
                part, first = b.column(5)[0].as_py(), first if part is not None else int(t.conv[0])
                state.absorb([t.run(i) for i in range(len(t.starts)) if i == len(t.starts) - 1 or t.conv[t.starts[i]] % BLOCK == 0], moduli)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "first", "state"])

    found = sorted(sorted_.select("conv", "a", "b", "level", "words", "part").mapInArrow(run, "part int, first long, state binary").collect())
    out, state = [], State()
    for r in found:
        out.append((r["part"], r["first"], pickle.dumps(state)))
        own: State = pickle.loads(r["state"])
        before = [own.block] if own.block and own.block.conv != own.now.conv else []
        state.absorb([*before, own.now], moduli)
    return out


def rebuilt(sorted_: DataFrame, moduli: tuple[int, ...]) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, with its fingerprint and that of the one before."""
    edges = ends(sorted_, moduli)
    known = {part: (state, nxt) for (part, _, state), nxt in zip(edges, [*(e[1] for e in edges[1:]), None])}
    shared = sorted_.sparkSession.sparkContext.broadcast(known)
    back = [[pow(pow(BASE, -1, m), i, m) if m > 1 else 0 for i in range(HEADS)] for m in moduli]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, after = State(), None
        held: pa.RecordBatch | None = None

        def step(b: pa.RecordBatch, following: int | None) -> pa.RecordBatch:
            t = Turns(b, moduli)
            n = len(t.starts)
            h, m, off = (np.zeros(n, np.int64) for _ in range(3))
            whole, base, skipped, scale, shift = (np.zeros((3, n), np.int64) for _ in range(5))
            extra: list[tuple] = []
            closed = np.ones(n, bool)
            for i in range(n):
                r = t.run(i)
                conv = r.conv
                before = state.now if state.now and state.now.conv == conv else None
                state.absorb([r], moduli)
                run_, first = state.now, state.base(conv)
                h[i] = taken(conv)
                heads = first.first[: int(h[i])] if first and h[i] else []
                m[i] = len(heads)
                if before:
                    off[i], whole[:, i] = before.n, before.total
                skipped[:, i] = prefix(run_.first, min(int(h[i]), len(run_.first)), moduli)
                for j, p in enumerate(moduli):
                    scale[j, i], shift[j, i] = pow(BASE, int(off[i]), p), back[j][int(h[i] - m[i])]
                base[:, i] = prefix(heads, len(heads), moduli)
                closed[i] = i < n - 1 or following != conv
                if closed[i]:
                    ended, f = run_.n <= h[i], (0, 0)
                    extra.append((conv, 0, 0, 0, 0, 0, 0, 0, 0, 0, bool(ended and not heads)))
                    for d in range(1, len(heads) + 1):
                        g = packed(prefix(heads, d, moduli))
                        extra.append((conv, d, *g, *f, *heads[d - 1][3:6], heads[d - 1][6], bool(ended and d == len(heads))))
                        f = g
            of = np.repeat(np.arange(n), t.sizes)
            at = t.at + off[of]
            here, gone = [], []
            for j, p in enumerate(moduli):
                term = t.terms[j] * scale[j][of] % p
                upto = (whole[j][of] + t.sums[j] * scale[j][of]) % p
                for out, x in ((here, upto), (gone, upto - term)):
                    out.append((base[j][of] + (x - skipped[j][of]) % p * shift[j][of]) % p)
            own = np.flatnonzero(at > h[of])
            last = np.zeros(len(at), bool)
            last[(t.starts + t.sizes - 1)[closed]] = True
            cols = [t.conv, at - h[of] + m[of], *packed(here), *packed(gone), t.a, t.b, t.level, t.words, last]
            more = list(zip(*extra)) if extra else [[] for _ in cols]
            arrays = [pa.array(np.concatenate((c[own], np.array(x, c.dtype)))) for c, x in zip(cols, more)]
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in ROWS.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            if held is None:
                before, after = shared.value[b.column(5)[0].as_py()]
                state = pickle.loads(before)
            else:
                yield step(held, b.column(0)[0].as_py())
            held = b
        if held is not None:
            yield step(held, after)

    return sorted_.select("conv", "a", "b", "level", "words", "part").mapInArrow(run, ROWS)


def grouped(rows: DataFrame) -> DataFrame:
    last = F.struct("p1", "p2", "ps", "a", "b", "level")
    return rows.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.min("words").alias("words"), F.min(last).alias("one"), F.max(last).alias("other"))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups whose members all have the representative's last turn and fingerprint before it, and the rows with s, which tells
    groups of one fingerprint apart. s grows by every split that a conversation has gone through at its depth or above."""
    rows = rows.withColumn("s", F.lit("")).withColumn("ps", F.lit(""))
    while True:
        nodes = cut(grouped(rows))
        mixed = nodes.filter("one <> other")
        if not mixed.head(1):
            return nodes, rows
        last = ["p1", "p2", "ps", "a", "b", "level"]
        kinds = rows.join(mixed.select(*NODE), NODE, "left_semi").select(*NODE, *last).distinct()
        kinds = kinds.withColumn("kind", F.dense_rank().over(Window.partitionBy(*NODE).orderBy(*last))).filter("kind > 1")
        parted = rows.join(kinds, [*NODE, *last]).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "kind"))).alias("splits"))
        told = rows.join(parted, "conv", "left")

        def path(upto: Column) -> Column:
            held = F.filter(F.coalesce("splits", F.array()), lambda x: x["depth"] <= upto)
            return F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["depth"].cast("string"), x["kind"].cast("string"))), ",")

        s, ps = F.concat_ws("|", "s", path(F.col("depth"))), F.concat_ws("|", "ps", path(F.col("depth") - 1))
        told = cut_in_loop(told.select(*(c for c in rows.columns if c not in ("s", "ps")), s.alias("s"), ps.alias("ps")))
        release(nodes, rows)
        rows = told


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the conversations that end in a node, in order. Ids are first joined to chunks, wherever they lie, and then one task
    a node runs over its chunks one after the other (a hash has no parallel form), holding one at a time."""
    node = rows.filter("last").select(*NODE, "conv")

    def runs(b: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        cols = [b.column(i).to_pylist() for i in range(len(NODE))]
        keys, start = list(zip(*cols)), 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], start, i
                start = i

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(len(NODE)).to_pylist()
            out = []
            for key, a, z in runs(b):
                for i in range(a, z, CHUNK // 20):
                    part = ids[i : min(z, i + CHUNK // 20)]
                    out.append((*key, part[0], ",".join(map(str, part))))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "first", "ids"], r)) for r in out], schema=pa.schema([("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("s", pa.string()), ("first", pa.int64()), ("ids", pa.string())]))

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, comma, out = None, None, b"", []
        for b in batches:
            ids = b.column(len(NODE) + 1)
            for key, a, z in runs(b):
                if key != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h, comma = key, hashlib.sha256(), b""
                for i in range(a, z):
                    h.update(comma + ids[i].as_py().encode())
                    comma = b","
            if out:
                yield digest_batch(out)
                out = []
        if now is not None:
            yield digest_batch([(*now, h.hexdigest())])

    chunks = node.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(join, "depth long, f1 long, f2 long, s string, first long, ids string")
    return in_batches(chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first")).mapInArrow(hash_, "depth long, f1 long, f2 long, s string, sha string")


def digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[*NODE, "sha"])


def summed(chains: DataFrame) -> DataFrame:
    """conv, leaves and saved of whole subtrees of chains; chains: conv, up (the chain it hangs on, null at the top), leaves, saved.
    After k rounds a chain holds the sums of all less than 2^k below it and points 2^k up."""
    vals, old = chains, None
    while True:
        up = vals.filter("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("w"), F.count("*").alias("n"))
        up = cut_in_loop(up)
        total = up.agg(F.sum("n")).head()[0]
        if not total:
            release(up)
            return vals.select("conv", "leaves", "saved")
        added = vals.join(up.withColumnRenamed("up", "conv"), "conv", "left")
        added = added.select("conv", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("w", F.lit(0))).alias("saved"))
        far = up.select("up", "n").join(vals.select(F.col("conv").alias("up"), F.col("up").alias("next")), "up")
        moved = joined_to_one(added.filter("up IS NOT NULL"), far, ["up"], "n", total).select("conv", F.col("next").alias("up"), "leaves", "saved")
        new = cut_in_loop(moved.unionByName(added.filter("up IS NULL")))
        release(up, *([old] if old is not None else []))
        vals = old = new


def down(nodes: DataFrame) -> DataFrame:
    """Adds n_leaves and saved_tokens: sums over each chain from its end up to the node, by a scan over all nodes sorted by
    (chain, depth downwards); what a chain has behind the start of a partition comes from the sums of the ones before."""
    sorted_ = in_order(nodes, F.col("conv_id"), F.col("depth").desc())
    flow = ["conv_id", "leaves", "saved"]

    def ends_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, sums = None, None, None, np.zeros(2, np.int64)
        for b in batches:
            if b.num_rows:
                conv, x = b.column(0).to_numpy(), np.array([b.column(i).to_numpy() for i in (1, 2)])
                first, part = (int(conv[0]) if part is None else first), b.column(3)[0].as_py()
                own = conv == conv[-1]
                sums = x[:, own].sum(1) + (sums if last == conv[-1] and own.all() else 0)
                last = int(conv[-1])
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, first, last, *sums.tolist()), (pa.int32(), *[pa.int64()] * 4))], names=["part", "first", "last", "l", "w"])

    before, carry = {}, (None, 0, 0)
    for r in sorted(sorted_.select(*flow, "part").mapInArrow(ends_, "part int, first long, last long, l long, w long").collect()):
        before[r["part"]] = carry
        goes_on = carry[0] == r["last"] == r["first"]
        carry = (r["last"], r["l"] + (carry[1] if goes_on else 0), r["w"] + (carry[2] if goes_on else 0))
    shared = sorted_.sparkSession.sparkContext.broadcast(before)
    names = [c for c in nodes.columns if c not in ("leaves", "saved")]
    types = dict(nodes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            t = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            if carry is None:
                carry = shared.value[t["part"][0].as_py()]
            conv = t["conv_id"].to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(conv)])))
            sums = []
            for i, n in enumerate(("leaves", "saved")):
                x = t[n].to_numpy()
                c = np.cumsum(x)
                c = c - np.repeat(c[starts] - x[starts], sizes)
                if carry[0] == conv[0]:
                    c[: sizes[0]] += carry[i + 1]
                sums.append(c)
            carry = (int(conv[-1]), int(sums[0][-1]), int(sums[1][-1]))
            yield pa.RecordBatch.from_arrays([*(t[n] for n in names), *map(pa.array, sums)], names=[*names, "n_leaves", "saved_tokens"])

    schema = ", ".join(f"{n} {types[n]}" for n in names)
    return sorted_.mapInArrow(run, f"{schema}, n_leaves long, saved_tokens long")


def trie(rows: DataFrame, moduli: tuple[int, ...] = MODULI, mask: int = -1) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node. rows: conv_id, turn,
    role, text. mask: bits of turn hashes that count."""
    spark = rows.sparkSession
    known = turns(rows, mask).select("conv", "turn", "role", "a", "b", "level", n_words(F.col("text")).alias("words"))
    sorted_ = in_order(known.withColumn("row", F.monotonically_increasing_id()), "conv", "turn", "role", "a", "b", "row")
    prefixes, drop = written(rebuilt(sorted_, moduli))
    release(sorted_)
    nodes, told = verified(prefixes)

    node = nodes.select(*NODE, "conv", "n", (F.col("words") * (F.col("n") - 1)).alias("saved"), *(F.col(f"one.{c}").alias(c) for c in ("p1", "p2", "ps")))
    chains = cut(node.groupBy("conv").agg(F.min(F.struct("depth", "p1", "p2", "ps")).alias("top"), F.max("depth").alias("end"), F.sum("saved").alias("saved")))
    above = dict(zip(NODE, (F.col("top.depth") - 1, F.col("top.p1"), F.col("top.p2"), F.col("top.ps"))))
    heads = chains.filter("top.depth > 0").select("conv", *(c.alias(n) for n, c in above.items()))
    hung = heads.groupBy(*NODE).agg(F.count("*").alias("hung"))
    where = cut(hung.join(node.select(*NODE, F.col("conv").alias("up")), NODE))
    links = cut(joined_to_one(heads, where, NODE, "hung", heads.count()).select("conv", "up", F.col("depth").alias("at")))
    closed = where.select(F.col("up").alias("conv"), F.col("depth").alias("end"), "hung")
    tree = chains.join(closed, ["conv", "end"], "left").join(links, "conv", "left")
    tree = cut(tree.select("conv", "up", F.col("hung").isNull().cast("long").alias("leaves"), "saved"))
    below = links.join(summed(tree), "conv").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("hung"))

    zero, none = F.lit(0).cast("long"), F.lit(None)
    sums = {"leaves": zero, "saved": zero, "hung": zero, "n_convs": none.cast("long"), "up": none.cast("long"), "goes_on": F.lit(1).cast("long"), "sha": none.cast("string")}
    pieces = [
        node.join(digests(told), NODE, "left").select(F.col("conv").alias("conv_id"), "depth", "saved", F.col("n").alias("n_convs"), "sha"),
        below,
        links.select(F.col("conv").alias("conv_id"), (F.col("at") + 1).alias("depth"), "up"),
        chains.select(F.col("conv").alias("conv_id"), F.col("end").alias("depth"), zero.alias("goes_on")),
    ]
    pieces = [p.withColumns({k: v for k, v in sums.items() if k not in p.columns}) for p in pieces]
    all_ = pieces[0].unionByName(pieces[1]).unionByName(pieces[2]).unionByName(pieces[3])
    parts = all_.groupBy("conv_id", "depth").agg(
        *(F.sum(c).alias(c) for c in ("leaves", "saved", "hung")), *(F.max(c).alias(c) for c in ("n_convs", "up", "sha")), F.min("goes_on").alias("goes_on")
    )
    parent = F.when(F.col("depth") > 0, F.coalesce("up", "conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    leaf = ((F.col("goes_on") == 0) & (F.col("hung") == 0)).cast("long")
    flat = parts.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", (F.col("hung") + F.col("goes_on")).alias("n_children"), (F.col("leaves") + leaf).alias("leaves"), "saved", F.coalesce("sha", F.lit(empty)).alias("ends_sha256"))
    out = cut(down(flat).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    release(nodes, chains, where, links, tree)
    drop()
    return out


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT c, c - c % 20 AS b, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda s, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda r, i: xor(r >> 1, CAST(3988292384 AS BIGINT) * (r & 1)), xor(s, x)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM t),
heads AS (SELECT i.c, t.p AS d, t.role, t.text FROM ids i JOIN t ON t.c = i.b AND t.p <= i.h),
taken AS (SELECT c, count(*) AS m FROM heads GROUP BY c),
r AS (
  SELECT * FROM heads UNION ALL
  SELECT t.c, t.p - i.h + coalesce(m, 0), t.role, t.text FROM t JOIN ids i USING (c) LEFT JOIN taken USING (c) WHERE t.p > i.h),
x AS (
  SELECT c, d, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS seq, text FROM r UNION ALL
  SELECT c, 0, [], NULL FROM ids),
y AS (SELECT *, max(d) OVER (PARTITION BY c) AS len, md5(CAST(seq AS VARCHAR)) AS k FROM x),
g AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len = d), '')) AS ends_sha256,
    (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')), 0) AS saved
  FROM y GROUP BY d, k),
path AS (SELECT y.c, y.d, g.conv_id FROM y JOIN g USING (d, k)),
e AS (SELECT g.*, p.conv_id AS parent_conv_id FROM g LEFT JOIN path p ON p.c = g.conv_id AND p.d = g.d - 1),
kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n FROM e WHERE d > 0 GROUP BY ALL),
sub AS (
  SELECT a.conv_id, a.d, sum(e.saved) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM e LEFT JOIN kids USING (conv_id, d) JOIN path a ON a.c = e.conv_id AND a.d <= e.d GROUP BY a.conv_id, a.d)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, e.parent_conv_id, e.n_convs, coalesce(kids.n, 0) AS n_children,
  CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, e.ends_sha256
FROM e JOIN sub USING (conv_id, d) LEFT JOIN kids USING (conv_id, d)
"""

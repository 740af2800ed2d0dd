"""Co-occurrence, similarity, majority, coverage, mentions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from driftwake.operators.graph import cut

MAX_ITEMS, MIN_SUPPORT, MIN_CONFIDENCE = 25, 4, 0.6


def baskets(rows: DataFrame, basket: str, item: str, max_items: int = MAX_ITEMS, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """A4. item, partner, together, total, confidence: items that come together in at least `support` baskets, and
    in that share of the item's baskets. Baskets of more than `max_items` say nothing of their items (they are sweeps).

    Pairs are made inside a basket's array, at most max_items squared each, so no basket meets another in a join. Baskets are
    counted before any is gathered, so one of all items is never held.
    """
    held = rows.select(basket, item).distinct()
    small = held.groupBy(basket).agg(F.count(item).alias("n")).filter(F.col("n") <= max_items).select(basket)
    sets = held.join(small, basket, "left_semi").groupBy(basket).agg(F.array_sort(F.collect_set(item)).alias("s"))
    totals = sets.select(F.explode("s").alias("item")).groupBy("item").agg(F.count("*").alias("total"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("together")).filter(F.col("together") >= support)
    both = counted.select(F.col("a").alias("item"), F.col("b").alias("partner"), "together").unionByName(counted.select(F.col("b").alias("item"), F.col("a").alias("partner"), "together"))
    return both.join(totals, "item").withColumn("confidence", F.col("together") / F.col("total")).filter(F.col("confidence") >= confidence).select("item", "partner", "together", "total", "confidence")


HEAVY = 10
BUCKETS, BLOCK = 1 << 20, 1 << 10
CELL = 1 << 19
BROADCAST_ROWS = 400_000


def frequencies(sets: DataFrame) -> np.ndarray:
    """For each of BUCKETS classes of items, by their low bits: how many of the sets' (s) items fall into it. A task adds up its own
    sets; blocks of sums are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        if n.any():
            ends = pa.array(range(0, BUCKETS + 1, BLOCK), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(range(0, BUCKETS, BLOCK), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(n))], names=["block", "n"])

    def add(block: pa.Table) -> pa.Table:
        n = np.concatenate([c.flatten().to_numpy() for c in block.column("n").chunks]).reshape(-1, BLOCK).sum(axis=0)
        return pa.table({"block": block.column("block")[:1], "n": pa.array([n.astype(np.int64).tobytes()])})

    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.int64)
    for r in sets.select("s").mapInArrow(count, "block int, n array<long>").groupBy("block").applyInArrow(add, "block int, n binary").collect():
        out[r[0] // BLOCK] = np.frombuffer(r[1], np.int64)
    return out.ravel()


def prefixes(sets: DataFrame, least: float, often: np.ndarray) -> DataFrame:
    """sets(i, s) -> i, size, s: of each set, in the common order, the items of which two sets that are similar enough share one."""
    shared = sets.sparkSession.sparkContext.broadcast(np.clip(often, HEAVY, (1 << 31) - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, size = b.column(1).flatten().to_numpy(), np.diff(b.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            x = x[np.argsort((row << 32) + shared.value[x & (BUCKETS - 1)], kind="stable")]
            few = size - np.ceil(size * least - 1e-9).astype(int) + 1
            keep = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) < few[row]
            ends = pa.array(np.concatenate(([0], np.cumsum(few))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(x[keep]))], names=["i", "size", "s"])

    return sets.select("i", "s").mapInArrow(run, "i long, size int, s array<long>")


def compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """pairs(a, b), sets(i, s) -> a, b, similarity: those at least so similar. Sets are dealt to blocks of some CELL items, those
    with the same least neighbour together, and a set goes once to each pair of blocks in which it is asked for, not once a pair."""
    ways = pairs.select(F.col("a").alias("i"), "b").unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("b")))
    ids = cut(ways.groupBy("i").agg(F.min("b").alias("hub")).select("i", F.least("i", "hub").alias("hub")))
    few = ids.count() <= BROADCAST_ROWS
    asked = sets.select("i", "s").join(F.broadcast(ids) if few else ids, "i")
    hubs = cut(asked.groupBy("hub").agg(F.sum(F.size("s")).alias("n")))
    blocks = max(8, 2 * (hubs.agg(F.sum("n")).head()[0] or 0) // CELL)
    large = F.broadcast(hubs.filter(F.col("n") > CELL).select("hub", F.ceil(F.col("n") / CELL).alias("parts")))
    block = F.pmod(F.xxhash64("hub", F.pmod(F.hash("i"), F.coalesce("parts", F.lit(1)))), F.lit(blocks))
    place = cut(ids.join(large, "hub", "left").select("i", block.alias("block")))
    x, y = (place.select(F.col("i").alias(i), F.col("block").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    x, y = (F.broadcast(x), F.broadcast(y)) if few else (x, y)
    dealt = pairs.join(x, "a").join(y, "b").select((F.col("x") * blocks + F.col("y")).alias("cell"), "a", "b")
    sent = dealt.select(F.col("cell").alias("there"), F.explode(F.array("a", "b")).alias("i")).distinct()
    sent = asked.join(F.broadcast(sent) if few and sent.count() <= BROADCAST_ROWS else sent, "i").select("there", "i", "s")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        left, ids, chunks = left.sort_by("a"), right.column("i").to_numpy(), right.column("s").chunks
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["a", "b", "similarity"])
        size = np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks])
        x = np.unique(np.concatenate([c.flatten().to_numpy() for c in chunks]), return_inverse=True)[1]
        begin, order = np.cumsum(size) - size, np.argsort(ids)
        a, b = (order[np.searchsorted(ids, left.column(c).to_numpy(), sorter=order)] for c in ("a", "b"))
        mark, both = np.zeros(int(x.max()) + 1, bool), np.empty(len(a), np.int64)
        edges = [0, *(np.flatnonzero(np.diff(a)) + 1), len(a)]
        for lo, hi in zip(edges, edges[1:]):
            mine = x[begin[a[lo]] : begin[a[lo]] + size[a[lo]]]
            mark[mine] = True
            for k in range(lo, hi):
                both[k] = np.count_nonzero(mark[x[begin[b[k]] : begin[b[k]] + size[b[k]]]])
            mark[mine] = False
        similarity = both / (size[a] + size[b] - both)
        return pa.table({"a": left.column("a"), "b": left.column("b"), "similarity": similarity}).filter(pa.array(similarity >= least))

    return dealt.groupBy("cell").cogroup(sent.groupBy("there")).applyInArrow(cell, "a long, b long, similarity double")


def similar_classes(sets: DataFrame, key: str, items: str, least: float, ratio: float = 0.0, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """F8. (classes, links): equal sets are one class, named by its least key (classes: key, class); links (a, b, similarity)
    are the pairs of classes, a < b, whose Jaccard similarity is at least `least` and whose sizes' ratio is at least `ratio`.
    With `by`, sets meet only others of the same values. Empty sets are in no class.

    An exact prefix-filtered self-join: in a common order of all items, two sets that are similar enough share one of their
    first |s| - ceil(least * |s|) + 1; and with all that they share there, enough must be left of both. Rare items come
    first, so that none brings many sets together; how rare one is, beyond HEAVY, is told by what shares a bucket with it. Members of
    a class never multiply; keys are distinct.

    Items are known by 64 bits (longs by themselves), sets by a number. Whole sets are written once and stay where they are: what
    meets are prefixes, and only sets that have met are sent to be compared."""
    kind, groups = sets.schema[items].dataType, [F.col(c) for c in by]
    own = F.col(items) if not by and kind.elementType == LongType() and not kind.containsNull else F.transform(items, lambda x: F.xxhash64(*groups, x))
    # numbered ahead of the filter, which would else be worked out on the texts a second time
    base = sets.select(F.monotonically_increasing_id().alias("i"), F.col(key).alias("key"), F.sort_array(F.array_distinct(own)).alias("s")).filter(F.size("s") > 0)
    base = cut(base.withColumns({"_h": F.xxhash64("s"), "_g": F.hash("s"), "_n": F.size("s")}))  # 96 bits and the size tell sets apart
    alike = ["_h", "_g", "_n"]
    firsts = cut(base.groupBy(*alike).agg(F.min("key").alias("class"), F.min_by("i", "key").alias("i")))
    classes = base.select(*alike, "key").join(firsts, alike).select("key", "class")
    few = firsts.count() <= BROADCAST_ROWS
    one = firsts.select("i")
    prefix = prefixes(base, least, frequencies(base)).join(F.broadcast(one) if few else one, "i", "left_semi").select("i", "size", F.posexplode("s").alias("at", "x"))
    a, b = prefix.alias("a"), prefix.alias("b")
    close = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * max(least, ratio) - 1e-9
    enough = F.ceil((F.col("a.size") + F.col("b.size")) * (least / (1 + least)) - 1e-9)
    fits = F.least("a.at", "b.at") + F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) >= enough  # before, and from there on
    both = a.join(b, (F.col("a.x") == F.col("b.x")) & close & fits & (F.col("a.i") < F.col("b.i"))).groupBy(F.col("a.i").alias("a"), F.col("b.i").alias("b"), F.col("a.size").alias("m"), F.col("b.size").alias("n"))
    shared = both.agg(F.count("*").alias("shared"), (F.max("a.at") + 1).alias("p"), (F.max("b.at") + 1).alias("q"))
    # the prefix that ends first is known in both; what may be shared beside is in what is left behind it of one and behind the last place met of the other
    rest = lambda c: F.ceil(F.col(c) * least - 1e-9) - 1
    most_shared = F.col("shared") + F.greatest(F.least(rest("m"), F.col("n") - F.col("q")), F.least(F.col("m") - F.col("p"), rest("n")))
    met = cut(shared.filter(most_shared >= F.ceil((F.col("m") + F.col("n")) * (least / (1 + least)) - 1e-9)).select("a", "b"))
    far = compared(met, base, least)
    x, y = (firsts.select(F.col("i").alias(i), F.col("class").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    links = far.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return classes, links


def majority(rows: DataFrame, by: Sequence[str], layout: str, who: str) -> DataFrame:
    """A10. Rows whose layout is not the most common one of their group, with that one (`usual`); of equally common ones
    the one that comes first by `who`."""
    counts = rows.groupBy(*by, layout).agg(F.count("*").alias("n"), F.min(who).alias("first"))
    usual = counts.groupBy(*by).agg(F.min_by(layout, F.struct(-F.col("n"), F.col("first"))).alias("usual"))
    return rows.join(usual, list(by)).filter(~F.col(layout).eqNullSafe(F.col("usual")))


def uncovered(members: DataFrame, covered: DataFrame, holder: str, member: str, added: Column, by: Sequence[str] = ()) -> DataFrame:
    """J26. Holders that covered every old member and miss a new one: holder, missing (sorted).

    members(member, and columns for `added`: is it new); covered(holder, member); with `by`, the holders of each group answer for
    its members alone. Relational division by counting: what is joined is a row a group of counts and a row a (holder, member) that
    is there, and what is missing is found by an anti-join."""
    by = list(by)
    marked = members.select(*by, member, added.alias("_new")).distinct()
    old = marked.groupBy(*by).agg(F.count_if(~F.col("_new")).alias("_old"), F.count_if("_new").alias("_adds"))
    has = covered.select(*by, holder, member).distinct()
    held = has.join(marked, [*by, member])
    counted = held.groupBy(*by, holder).agg(F.count_if(~F.col("_new")).alias("_has"), F.count_if("_new").alias("_got"))
    due = (counted.join(old, by) if by else counted.join(F.broadcast(old))).filter("_has = _old AND _got < _adds").select(*by, holder)  # one row, where there is no group
    new = marked.filter("_new").select(*by, member)
    wanted = due.join(new, by) if by else due.join(new)
    return wanted.join(has, [*by, holder, member], "left_anti").groupBy(*by, holder).agg(F.array_sort(F.collect_list(member)).alias("missing"))


def unmentioned(words: DataFrame, defined: DataFrame, word: str) -> DataFrame:
    """A5. Defined words that stand nowhere but in their definitions: word, mentions, definitions."""
    d = defined.groupBy(word).agg(F.count("*").alias("definitions"))
    m = words.join(d.select(word), word, "left_semi").groupBy(word).agg(F.count("*").alias("mentions"))
    return d.join(m, word, "left").select(word, F.coalesce("mentions", F.lit(0)).alias("mentions"), "definitions").filter("mentions <= definitions")


def lost_and_gained(before: DataFrame, after: DataFrame, holder: str, name: str) -> DataFrame:
    """J24. Holders that lost exactly one name and gained exactly one: holder, lost, gained (a renaming)."""
    b, a = (df.groupBy(holder).agg(F.collect_set(name).alias(c)) for df, c in ((before, "b"), (after, "a")))
    j = b.join(a, holder).select(holder, F.array_except("b", "a").alias("lost"), F.array_except("a", "b").alias("gained"))
    return j.filter("size(lost) = 1 AND size(gained) = 1").select(holder, F.get("lost", F.lit(0)).alias("lost"), F.get("gained", F.lit(0)).alias("gained"))


def single_variant_change(before: DataFrame, after: DataFrame, key: Sequence[str], variant: str) -> DataFrame:
    """A11. Keys with exactly one variant on each side, and not the same one: key, old, new."""
    def once(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(*key).agg(F.countDistinct(variant).alias("_n"), F.min(variant).alias(n)).filter("_n = 1").drop("_n")

    return once(before, "old").join(once(after, "new"), list(key)).filter("old <> new")

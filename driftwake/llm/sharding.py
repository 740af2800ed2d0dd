"""Sharding by fixed virtual slots: records hash into thousands of slots, bytes are summed per slot,
and a versioned slot-to-shard map is made from the sums, stored, and edited when rebalancing. Readers pin a version:
the rows' shards are those of the map as read back, and so are the shards after an edit, which moves few slots.

The law is `bytes`. Equal texts are a group that may hold a third of all rows, so under this law they can't share a
shard: a slot hashes the whole record (id, checksum and size), which spreads copies of a text over all slots.

Edge cases: a null text has no bytes (size 1, crc32 0); null or repeated doc_ids are records like any
other; identical rows are counted, placed together and returned as often as they came; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwake.llm.common import delete, shared_folder, table

SLOTS = 4096
SHARDS = 16


@dataclass
class SlotMap:
    """A version of the map from virtual slot to shard; shard_of has one entry per slot."""

    shards: int
    shard_of: list[int]
    version: int = 1
    moved: dict[int, tuple[int, int]] = field(default_factory=dict)  # slot -> (from, to), by the last edit

    @classmethod
    def fresh(cls, weights: list[int], shards: int) -> "SlotMap":
        """Heaviest slot first onto the lightest shard."""
        loads = [(0, s) for s in range(shards)]
        shard_of = [0] * len(weights)
        for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
            load, shard = heapq.heappop(loads)
            shard_of[slot] = shard
            heapq.heappush(loads, (load + weights[slot], shard))
        return cls(shards, shard_of)

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += weights[slot]
        return out

    def rebalanced(self, weights: list[int], shards: int | None = None, tolerance: float = 0.01) -> "SlotMap":
        """The next version for new weights and perhaps more shards; slots move only from shards over the
        mean to the lightest one, each time the slot that fits the gap best, until within tolerance."""
        shards = max(self.shards, shards or 0)
        new = SlotMap(shards, list(self.shard_of), self.version + 1)
        loads, mean = new.loads(weights), sum(weights) / shards
        held: list[list[int]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(new.shard_of):
            held[shard].append(slot)
        stuck: set[int] = set()  # shards that are over the mean by one heavy slot alone
        for _ in range(len(weights)):
            low, high = min(range(shards), key=loads.__getitem__), max(set(range(shards)) - stuck, key=loads.__getitem__)
            gap = min(mean - loads[low], loads[high] - mean)
            if high == low or max(loads[high] - mean, mean - loads[low]) <= tolerance * mean:
                break
            fits = [s for s in held[high] if 0 < weights[s] < loads[high] - loads[low]]
            if not fits:
                stuck.add(high)
                continue
            slot = min(fits, key=lambda s: (abs(weights[s] - gap), s))
            held[high].remove(slot)
            held[low].append(slot)
            loads[high] -= weights[slot]
            loads[low] += weights[slot]
            new.moved[slot] = (new.moved.get(slot, (high, low))[0], low)
            new.shard_of[slot] = low
        return new

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "shards": self.shards, "shard_of": self.shard_of, "moved": self.moved})

    @classmethod
    def from_json(cls, text: str) -> "SlotMap":
        d = json.loads(text)
        return cls(d["shards"], d["shard_of"], d["version"], {int(k): tuple(v) for k, v in d["moved"].items()})

    def save(self, spark: SparkSession, path: str) -> None:
        """Each version is a file set of its own under path, so that readers can pin one."""
        spark.createDataFrame([(self.to_json(),)], "map string").coalesce(1).write.mode("overwrite").text(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> "SlotMap":
        return cls.from_json(spark.read.text(f"{path}/version={version}").head()[0])


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot. The slot hashes the whole record, not only its id, so that one
    id (or null) on many rows does not fill one slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_weights(recs: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: at most `slots` rows come to the driver, however large the table."""
    size, count = [0] * slots, [0] * slots
    for r in recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r[0]], count[r[0]] = r[1], r[2]
    return size, count


def shard(recs: DataFrame, slot_map: SlotMap, counts: list[int]) -> DataFrame:
    """Adds shard and the row's place in it (slot, gapless from 0).

    Places need no sort of a whole shard: slots stand in a shard in order, so a row's place is the rows of the
    slots before it plus its rank in its own slot.
    """
    spark = recs.sparkSession
    base, seen = [0] * len(counts), [0] * slot_map.shards
    for s, to in enumerate(slot_map.shard_of):
        base[s] = seen[to]
        seen[to] += counts[s]
    where = spark.createDataFrame([(s, to, base[s]) for s, to in enumerate(slot_map.shard_of)], "virtual_slot int, shard int, base long")
    same = recs.groupBy("virtual_slot", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        same.withColumn("rank", F.coalesce(F.sum("copies").over(before), F.lit(0)))
        .join(F.broadcast(where), "virtual_slot")  # one row per slot: SLOTS rows at any size
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") + F.col("copy")).alias("slot"), "virtual_slot")
    )


def stored(spark: SparkSession, path: str, weights: list[int], shards: int = SHARDS) -> SlotMap:
    """The last map under path, as it is if it has that many shards and fits the weights, else its next version; a
    fresh one where there is none. What is returned has been read back."""
    last = latest(spark, path)
    now = SlotMap.load(spark, path, last) if last else SlotMap.fresh(weights, shards)
    if last:
        loads, mean = now.loads(weights), sum(weights) / now.shards
        if now.shards != shards or max(loads) > 1.05 * mean:
            now = now.rebalanced(weights, shards)
    if now.version != last:
        now.save(spark, path)
    return SlotMap.load(spark, path, now.version)


def latest(spark: SparkSession, path: str) -> int:
    """The greatest version stored under path, 0 if none is."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    return max([0, *(int(f.getPath().getName().removeprefix("version=")) for f in fs.listStatus(home))]) if fs.exists(home) else 0


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makes and stores version 1 for SHARDS shards, then version 2 with one shard more, each from the map as stored.
    The maps are of this run alone, so its folder goes when both have been read."""
    recs = records(table(spark, sf_dir, "documents"))
    weights, counts = slot_weights(recs)
    home = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    try:
        now = stored(spark, home, weights)
        grown = stored(spark, home, weights, SHARDS + 1)
    finally:
        delete(spark, home)
    moves = spark.createDataFrame([(s, to) for s, to in enumerate(grown.shard_of)], "virtual_slot int, next_shard int")
    return shard(recs, now, counts).join(F.broadcast(moves), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(now.version).alias("map_version"),
        "next_shard", F.lit(grown.version).alias("next_version"),
    )

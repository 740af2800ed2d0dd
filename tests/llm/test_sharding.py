import random
import zlib

from driftwake.llm import sharding as H
from tests.llm import cases


def test_every_row_once_and_places_gapless(spark):
    data = cases.rows() + [(i, cases.prose(i, 10 + i % 50), "en", "s", 1) for i in range(1000, 1400)] + [cases.rows()[8]] * 20
    recs = H.records(cases.frame(spark, data), slots=256)
    weights, counts = H.slot_weights(recs, 256)
    got = H.shard(recs, H.SlotMap.fresh(weights, 16), counts).collect()
    size = lambda t: len((t or "").encode())
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((i, size(t) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data), key=str)
    places = {}
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({(r.virtual_slot, r.shard) for r in got}) == len({r.virtual_slot for r in got})


def test_empty_table(spark):
    recs = H.records(cases.empty(spark))
    weights, counts = H.slot_weights(recs)
    assert H.shard(recs, H.SlotMap.fresh(weights, 16), counts).collect() == []


def test_map_is_balanced_and_edits_move_little(spark, tmp_path):
    rng = random.Random(0)
    weights = [rng.randrange(50, 150) for _ in range(4096)]
    m = H.SlotMap.fresh(weights, 16)
    loads = m.loads(weights)
    assert max(loads) - min(loads) <= max(weights)
    grown = m.rebalanced(weights, 17)
    assert grown.version == 2 and all(to == 16 for _, to in grown.moved.values())
    assert {s for s in range(4096) if m.shard_of[s] != grown.shard_of[s]} == set(grown.moved)
    loads = grown.loads(weights)
    assert max(loads) <= 1.011 * sum(loads) / 17 and len(grown.moved) <= 1.1 * 4096 / 17
    heavier = [w * (3 if m.shard_of[i] == 0 else 1) for i, w in enumerate(weights)]
    loads = m.rebalanced(heavier).loads(heavier)
    assert max(loads) <= 1.011 * sum(loads) / 16
    grown.save(spark, str(tmp_path))
    assert H.SlotMap.load(spark, str(tmp_path), 2) == grown


def test_query_reads_its_stored_maps(spark, tmp_path):
    cases.frame(spark, cases.rows() + [(i, cases.prose(i, 10 + i % 50), "en", "s", 1) for i in range(1000, 3000)], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    rows = H.op9_virtual_slots(spark, str(tmp_path)).collect()
    assert {(r.map_version, r.next_version) for r in rows} == {(1, 2)}
    for column, shards in (("shard", 16), ("next_shard", 17)):
        loads = [0] * shards
        for r in rows:
            loads[r[column]] += r["size"]
        assert max(loads) < 1.2 * sum(loads) / shards + max(r["size"] for r in rows)
    moved = [r for r in rows if r.shard != r.next_shard]
    assert sum(r.next_shard == 16 for r in moved) > 0.8 * len(moved) > 0 and len(moved) < 0.2 * len(rows)


def test_stored_maps_are_versions(spark, tmp_path):
    weights = [100 + i % 7 for i in range(512)]
    path = str(tmp_path / "maps")
    assert H.latest(spark, path) == 0
    first = H.stored(spark, path, weights, 4)
    assert first.version == 1 and H.stored(spark, path, weights, 4) == first and H.latest(spark, path) == 1
    heavier = [w * (5 if first.shard_of[i] == 0 else 1) for i, w in enumerate(weights)]
    second = H.stored(spark, path, heavier, 4)
    assert second.version == 2 and second.moved and H.SlotMap.load(spark, path, 1) == first

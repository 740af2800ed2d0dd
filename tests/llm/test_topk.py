import math

import numpy as np
import pytest

from driftwake.llm import topk as T
from tests.llm.cases import CLASH


def frame(spark, data):
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit(1) for c in CLASH})


def brute(data, k=10):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, qv) in enumerate(good):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for j, (i, v) in enumerate(good) if j != at)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [T.QUERY_BLOCK, 2])
def test_brute_force_with_ties_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(T, "QUERY_BLOCK", block)
    monkeypatch.setattr(T, "SHARD_ROWS", 64)
    rng = np.random.default_rng(0)
    data = [(i, (rng.standard_normal(16) * (1 if i % 3 else 0.1)).astype(np.float32).tolist()) for i in range(900)]
    same = data[5][1]
    data += [(i, same) for i in range(1000, 1060)] + [(5000, None), (None, same), (5100, [1.0, None]), (5200, [float("nan")] * 16), (5300, [float("inf")] * 16), (5400, [1.0, 2.0]), (5401, []), data[7], data[200], data[200], (300, same), (300, data[301][1])]
    got = T.search(frame(spark, data), frame(spark, [r for r in data if r[0] is not None and r[0] % 100 == 0]))
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_fewer_rows_than_k_and_empty(spark):
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert sorted(map(tuple, T.search(frame(spark, data), frame(spark, data[:1])).collect())) == [(0, 1, 1, 512 * 1024)]
    assert T.search(frame(spark, []), frame(spark, [])).collect() == []
    assert T.search(frame(spark, data[:1]), frame(spark, data[:1])).collect() == []


def test_the_query_itself(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = [(i % 350, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(700)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, T.op4_maxscore(spark, str(tmp_path)).collect())) == brute(data)


def test_probes_are_skipped_only_below_the_floor():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-500, 500, (400, 8))
    shard = T.Shard(np.arange(400), vectors, True)
    for q in rng.integers(-500, 500, (20, 8)):
        ids, scores = shard.search(q, 5, (np.arange(1000, 1005), np.full(5, 200_000)))
        own = sorted([(-int(s), i) for i, s in enumerate(vectors @ q)] + [(-200_000, i) for i in range(1000, 1005)])[:5]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == own

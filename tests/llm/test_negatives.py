import math

import numpy as np
import pytest

from driftwake.llm import negatives as N
from tests.llm.cases import CLASH

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, data):
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in CLASH})


def brute(data, every=50, positives=5, negatives=3):
    good = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in data if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, al, av in good:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, l) for i, l, v in good if i != a)
        for s, p, _ in [r for r in scored if r[2] == al][:positives]:
            fits = [(i, -n) for n, i, l in scored if l != al and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, p, r, i, -s, n) for r, (i, n) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def some(kind, n=700, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centres = rng.standard_normal((12, 8)) * 2
        v = centres[rng.integers(0, 12, n)] + 0.1 * rng.standard_normal((n, 8))
    elif kind == "positive":
        v = np.abs(rng.standard_normal((n, 8)))
    else:
        v = rng.standard_normal((n, 8)) * np.where(np.arange(n) % 3, 1, 0.1)[:, None]
    return [(i, v[i].astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("kind", ["clusters", "positive", "spread"])
def test_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "QUERY_BLOCK", 5)
    data = some(kind)
    same = data[5][1]
    data += [(i, same, i % 2) for i in range(1000, 1040)]  # ties, and a hot vector
    data += [(5000, None, 1), (None, same, 1), (5050, same, None), (5100, [1.0, None], 1), (5150, [float("nan")] * 8, 1), (5200, [float("inf")] * 8, 1)]
    data += [(5250, [1.0, 2.0], 1), (5300, [], 2), data[7], data[50], data[50], (100, data[301][1], 3)]
    rows = frame(spark, data)
    got = N.mine(rows, rows.filter("vec_id % 50 = 0"), sample=64, pivots=8)
    want = brute(data)
    assert want and sorted(map(tuple, got.collect())) == want


def test_few_rows_and_none(spark):
    data = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.1], 2)]
    rows = frame(spark, data)
    assert sorted(map(tuple, N.mine(rows, rows.filter("vec_id = 0")).collect())) == brute(data) == [(0, 1, 1, 2, 128 * 256, 102 * 256)]
    assert N.mine(rows, rows.filter("vec_id < 0")).collect() == []
    assert N.mine(frame(spark, []), frame(spark, [])).collect() == []
    zeros = [(i, [0.0, 0.0], i % 2) for i in range(6)]
    rows = frame(spark, zeros)
    assert sorted(map(tuple, N.mine(rows, rows.filter("vec_id = 0")).collect())) == brute(zeros)


def test_the_query_moves_labels(spark, tmp_path):
    data = some("positive", 300, 3)
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in data]
    assert sorted(map(tuple, N.op13_distance_keys(spark, str(tmp_path)).collect())) == brute(moved)


def test_rings_add_each_row_once_and_all_that_are_near():
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (400, 4))
    square = (v**2).sum(1)
    space = N.Space(np.arange(400), np.zeros(400, int), v, 4, int(square.max()), True, 6)
    d = space.to_pivots(v, square, False)
    home = d.argmin(1)

    class Asked:
        near, far, start = np.array([-1.0]), np.array([150.0]), np.array([0.0])
        pivot = space.to_pivots(v[:1], square[:1], True)

    seen = []
    for near, far in ((-1.0, 150.0), (150.0, 300.0), (300.0, 520.0)):
        Asked.near, Asked.far = np.array([near]), np.array([far])
        for p in range(6):
            own = np.flatnonzero(home == p)
            own = own[np.argsort(d[own, p], kind="stable")]
            a, b, x, y = (int(z[0]) for z in N.ring(space, Asked, p, d[own, p]))
            seen += own[[*range(a, b), *range(x, y)]].tolist()
        assert len(seen) == len(set(seen))
        true = space.distance(float(square[0]), v @ v[0])
        assert set(np.flatnonzero(true <= far)) <= set(seen)
    assert len(seen) < 400  # what is far has not been read

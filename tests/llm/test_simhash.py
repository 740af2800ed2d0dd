import numpy as np
import pytest
import xxhash

from driftwake.llm import simhash as S
from tests.llm import cases


def slow(text):
    w = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def grouping(fps, bound=4):
    """least position that each reaches, by comparing all"""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= bound):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_fingerprints():
    for t in cases.texts()[:20]:
        assert S.fingerprint(t) == slow(t)


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 64, 12, np.uint64)
    out = [centres[0]]
    for i in range(n):
        f = int(out[rng.integers(len(out))]) if i % 3 else int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            f ^= 1 << int(b)
        out.append(np.uint64(f))
    return sorted({int(x) for x in out})


@pytest.mark.parametrize("crowd", [S.CROWD, 20])
def test_links_connect_what_all_pairs_connect(spark, crowd):
    fps = clustered(crowd, 700)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, id long").repartition(4)
    at = {f: i for i, f in enumerate(signed)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a_id, a, b_id, b in S.near(df, 4, crowd).collect():
        assert (a_id, b_id) == (at[a], at[b])
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == grouping(fps)
    got = {r.id: r.root.id for r in S.grouped(df, 4).collect()}
    assert got == dict(enumerate(grouping(fps)))


def test_coordinates_discard_pairs():
    """Of all pairs of random fingerprints nearly all are discarded by their coordinates in groups; of near ones none."""
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 64, 2000, np.uint64)
    masks = S.groups((1 << 64) - 1, 4)
    assert sum(masks) == (1 << 64) - 1 and len(masks) == 6
    tables = [S.confined(fps, m) for m in masks]
    assert all(t.max() >= 8 and t.min() <= 2 for t in tables)  # distances spread within a group
    i, j = np.triu_indices(len(fps), 1)
    worst = np.stack([np.abs(t[:, i] - t[:, j]).max(axis=0) for t in tables])
    distance = np.bitwise_count(fps[i] ^ fps[j])
    assert (worst.sum(axis=0) <= distance).all()
    meet = (worst == 0).sum(axis=0) >= 2
    codes = np.stack([S.code(t) for t in tables])
    assert (((codes[:, i] == codes[:, j]).sum(axis=0) >= 2) == meet).all()
    assert meet.sum() < len(i) / 100_000 + 5  # at least 99.99 % are discarded before they meet
    near = fps.copy()
    for b in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), np.uint64)
    same = np.stack([S.code(S.confined(near, m)) for m in masks]) == codes
    assert (same.sum(axis=0) >= 2).all()


def test_whole_references_discard_within_a_meeting():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, 3000, np.uint64) & np.uint64((1 << 42) - 1)  # a crowd that agrees in 22 bits
    left = S.survivors(0, S.coordinates(fps), np.arange(1, len(fps)), 4)
    assert len(left) < len(fps) / 100
    assert set(np.flatnonzero(np.bitwise_count(fps ^ fps[0]) <= 4).tolist()) - {0} <= set(left.tolist())


def test_components_on_edge_cases(spark):
    data = cases.rows()
    want = grouping([slow(r[1]) for r in data])
    least = {}
    for r, g in zip(data, want):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    got = S.components(cases.frame(spark)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((r[0], least.get(g)) for r, g in zip(data, want)), key=str)


def test_one_of_each_and_empty(spark):
    data = cases.rows()
    groups = grouping([slow(r[1]) for r in data])
    out = S.one_of_each(cases.frame(spark))
    got = out.collect()
    assert len(got) == len(set(groups)) and out.columns == cases.frame(spark).columns
    assert all(r.doc_id is not None and r._r0 == "clash" for r in got)
    assert S.components(cases.empty(spark)).collect() == [] and S.one_of_each(cases.empty(spark)).collect() == []


def test_hubs_are_split(spark, monkeypatch):
    from driftwake.llm import common, components

    monkeypatch.setattr(common, "CROWD", 20)
    edges = [(0, i) for i in range(1, 300)] + [(500, i) for i in range(501, 800)] + [(299, 800), (799, 801)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(300), 800]} | {i: 500 for i in [*range(500, 800), 801]}


def test_chain_of_many_links(spark):
    from driftwake.llm.components import roots

    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(3, 3), (600, 599), (600, 599)], "a long, b long")
    got = {r.node: r.root for r in roots(edges).collect()}
    assert got == {i: 0 for i in range(501)} | {599: 599, 600: 599}

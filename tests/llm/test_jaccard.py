import random

import corpus_pipeline as C
from driftwake.llm import jaccard as J
from tests.llm import cases


def shingles(text):
    w = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The rows that stay, by comparing all pairs; ids are distinct."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted(least.values())


def near_copies():
    """Copies with words changed here and there, on both sides of 0.8, chains of copies of copies, and odd texts."""
    rng, out = random.Random(8), []
    for seed in range(40):
        w = cases.prose(seed, rng.choice([30, 60, 150, 400]), 3000).split()
        for _ in range(6):
            out.append(" ".join(w))
            v = list(rng.choice([w, w, out[-1].split()]))
            for at in rng.sample(range(len(v)), max(1, len(v) * rng.choice([1, 2, 3, 5]) // 100)):
                v[at] = f"new{rng.random()}"
            w = v
    out += [None, "", " ", "one two", "One  Two", "one two three four five", "one two three four five six"]
    rng.shuffle(out)
    return list(enumerate(out))


def test_stage_is_brute_force_jaccard(spark):
    rows = near_copies()
    want = brute(rows)
    docs = cases.frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = C.distinct(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    assert 40 < len(want) < len(rows) - 60  # both sides of the bound are there


def test_small_teams_lose_nothing(spark, monkeypatch):
    """Teams of at most eight: the same pairs are linked."""
    from pyspark.sql import functions as F

    from driftwake.llm import common

    rows = near_copies()
    docs = spark.createDataFrame([(i, i, i, t) for i, t in rows], "doc_id long, r0 long, r1 long, text string")
    told = docs.sparkSession.createDataFrame(J.nodes(docs).collect(), J.TOLD)
    sets = told.groupBy("node").agg(F.first("keys").alias("keys"), F.min("r0").alias("r0")).withColumn("r1", F.col("r0"))
    monkeypatch.setattr(common, "CROWD", 8)
    keep = {}
    for crowd in (J.CROWD, 4):
        monkeypatch.setattr(J, "BROADCAST_ROWS", 400_000 if crowd > 4 else 0)
        found = {r.node: r.root for r in J.roots(J.near(docs, sets, crowd)).collect()}
        groups = {}
        for r in told.select("doc_id", "node").orderBy("doc_id").collect():
            groups.setdefault(found.get(r.node, r.node), r.doc_id)
        keep[crowd] = sorted(groups.values())
    assert keep[J.CROWD] == keep[4] == brute(rows)


def test_crowd_repeated_rows_and_empty(spark):
    base = cases.prose(5, 300, 3000).split()
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]), "en", "s", 1) for i in range(200)]
    rows += [rows[0], (None, rows[3][1], None, None, None), (None, "alone and without an id", None, None, None)]
    got = J.one_of_each(cases.frame(spark, rows)).collect()
    assert sorted((r.doc_id for r in got), key=str) == [0, None]
    assert J.one_of_each(cases.empty(spark)).collect() == []


def test_fingerprints_link_by_themselves(spark):
    """Without keys to meet under, near copies are found by their SimHash; what is near by fingerprint but not similar stays apart."""
    from pyspark.sql import functions as F

    base = [cases.prose(s, 4000, 3000).split() for s in range(6)]
    rows = [(2 * s + k, " ".join(w[:2000] + ["changed"] * k + w[2000 + k :])) for s, w in enumerate(base) for k in (0, 1)]
    docs = spark.createDataFrame([(i, i, i, t) for i, t in rows], "doc_id long, r0 long, r1 long, text string")
    sets = spark.createDataFrame(J.nodes(docs).collect(), J.TOLD)
    bare = sets.select("node", F.array().cast("array<long>").alias("keys"), "r0", "r1")
    of = {r.node: r.doc_id for r in sets.select("node", "doc_id").collect()}
    assert J.near(docs, bare).collect() == []
    found = J.near(docs, bare, linked=J.by_fingerprint(sets)).collect()
    assert sorted(sorted((of[r.a], of[r.b])) for r in found) == [[2 * s, 2 * s + 1] for s in range(6)]
    far = spark.createDataFrame([(sets.filter(f"doc_id = {a}").head().node, sets.filter(f"doc_id = {b}").head().node) for a, b in ((0, 2), (4, 5))], "hub long, node long")
    assert [sorted((of[r.a], of[r.b])) for r in J.near(docs, bare, linked=far).collect()] == [[4, 5]]


def test_rounds_of_components_hold_few_edges_in_few_partitions(spark, monkeypatch):
    from driftwake.llm import components

    held, cut = [], components.cut_in_loop
    monkeypatch.setattr(components, "cut_in_loop", lambda df: held.append(cut(df)) or held[-1])
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        edges = [(i, i + 1) for i in range(30) if i != 12] + [(40, i) for i in range(41, 60)]
        got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {i: 0 if i <= 12 else 13 if i <= 30 else 40 for e in edges for i in e}
        assert max(df.rdd.getNumPartitions() for df in held[1:]) == 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)

import itertools
import math
import random

from pyspark.sql import functions as F

from driftwake.functions import text as T
from driftwake.operators import changes, graph, mining, ranking, resolve, spans


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_diff_is_null_safe_and_worst_first(spark):
    b = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "c", 1), (4, "d", 1)], "k int, s string, v int")
    a = spark.createDataFrame([(1, "a", 2), (2, None, 1), (3, "x", 9), (5, "e", 1)], "k int, s string, v int")
    assert rows(changes.snapshot_diff(b, a, "k", [("signature", "s"), ("value", "v")])) == [(1, "value"), (3, "signature"), (4, "removed"), (5, "added")]


def test_unique_pairs_never_guess(spark):
    gone = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 3)], "k string, m int")
    new = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), ("w", 3)], "k string, m int")
    pairs = changes.unique_pairs(gone, new, ["m"], "k")
    assert rows(pairs.select("old_key", "new_key")) == [("a", "x")]
    all_ = spark.createDataFrame([("a", "removed"), ("x", "added"), ("d", "removed")], "k string, kind string")
    assert rows(changes.with_renames(all_, pairs, "k")) == [("d", "removed", None), ("x", "renamed", "a")]


def test_overlay(spark):
    f = lambda d: spark.createDataFrame(list(d.items()), "k string, v string")
    got = changes.overlay(f({"a": "1", "b": "1", "c": "1", "d": "1"}), f({"a": "2", "b": "1", "c": "2"}), f({"a": "3", "b": "3", "c": "2", "d": "9", "n": "1"}), "k", "v")
    assert rows(got) == [("a", "2", "mine", True), ("b", "3", "theirs", False), ("c", "2", "mine", False), ("n", "1", "theirs", False)]


def test_innermost_ties(spark):
    p = spark.createDataFrame([(1, "f", 5), (2, "f", 50)], "id int, path string, line int")
    s = spark.createDataFrame([("f", "outer", 1, 20), ("f", "first", 4, 8), ("f", "second", 5, 9)], "path string, name string, start int, end int")
    width = F.col("end") - F.col("start")
    assert rows(spans.innermost(p, s, "path", "line", "id", width)) == [(1, "first"), (2, None)]
    assert rows(spans.innermost(p, s, "path", "line", "id", width, later_wins=True)) == [(1, "second"), (2, None)]


def test_islands_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 10)
    rng = random.Random(0)
    n = sorted({rng.randrange(300) for _ in range(220)} | set(range(95, 131)))
    want, start = [], n[0]
    for x, y in zip(n, n[1:] + [None]):
        if y != x + 1:
            want.append((start, x))
            start = y
    got = spans.islands(spark.createDataFrame([(x,) for x in n], "n long"), "n")
    assert sorted(map(tuple, got.collect())) == want


def test_contract_problems_like_python(spark):
    def f(a, b, /, c, d=1, *, k, j=2):
        pass

    p = [F.array(*map(F.lit, "abcd")), F.lit(1), F.lit(2), F.lit(False), F.array(F.lit("k"), F.lit("j")), F.array(F.lit("k")), F.lit(False)]
    calls = [(n, list(ks)) for n in range(6) for r in range(4) for ks in itertools.combinations(["c", "d", "k", "j", "z"], r)]
    got = spark.createDataFrame(calls, "n int, ks array<string>").select("n", "ks", F.size(resolve.contract_problems(*p, F.col("n"), F.col("ks"))).alias("bad")).collect()
    for r in got:
        try:
            f(*range(r.n), **dict.fromkeys(r.ks))
            fits = True
        except TypeError as e:
            if "multiple values" in str(e):  # a doubled argument is not judged
                continue
            fits = False
        assert fits == (r.bad == 0), r


def test_propagation_equals_walks(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(15), rng.randrange(15)) for _ in range(40)})
    weight = {e: rng.choice([0.9, 0.85, 0.45]) for e in edges}
    best = {}
    def walk(node, score, hops):
        for s, d in edges:
            if d == node and hops < 6 and s != 0 and score * weight[s, d] >= 0.1:
                best[s] = max(best.get(s, (0, 0)), (score * weight[s, d], -hops - 1))
                walk(s, score * weight[s, d], hops + 1)
    walk(0, 0.95, 0)
    got = graph.propagate(spark.createDataFrame([(s, d, w) for (s, d), w in weight.items()], "src int, dst int, weight double"), spark.createDataFrame([(0, 0.95)], "node int, score double"))
    assert {r.node: (round(r.score, 9), r.hops) for r in got.collect()} == {n: (round(s, 9), -h) for n, (s, h) in best.items()}


def test_cycles_and_reach(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)], "src int, dst int")
    assert rows(graph.cycles(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    start = spark.createDataFrame([(4,)], "node int")
    assert rows(graph.reach(e, start, backward=True)) == [(1, 3), (2, 2), (3, 1), (4, 0), (5, 1), (6, 4)]
    assert rows(graph.reach(e, start, 1, backward=True)) == [(3, 1), (4, 0), (5, 1)]


def test_similar_classes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    base = [rng.sample(range(60), 20) for _ in range(6)]
    sets = [(i, sorted(set(rng.choice(base)) ^ set(rng.sample(range(60), rng.randrange(4))))) for i in range(60)] + [(100, []), (101, [1])]
    data = spark.createDataFrame([(i % 2, i, s) for i, s in sets], "g int, k int, s array<int>")
    for heavy in (mining.HEAVY, 1):
        monkeypatch.setattr(mining, "HEAVY", heavy)
        for by in ([], ["g"]):
            classes, links = mining.similar_classes(data, "k", "s", 0.8, by=by)
            of = {r.key: r["class"] for r in classes.collect()}
            want = {}
            for i, x in sets:
                if x:
                    want.setdefault((i % 2 if by else 0, tuple(x)), i)
            assert of == {i: want[i % 2 if by else 0, tuple(x)] for i, x in sets if x}
            pairs = []
            for (a, x), (b, y) in itertools.combinations([(i, set(x)) for (_, x), i in want.items()], 2):
                if len(x & y) / len(x | y) >= 0.8 and (not by or a % 2 == b % 2):
                    pairs.append((min(a, b), max(a, b), round(len(x & y) / len(x | y), 9)))
            assert sorted((r.a, r.b, round(r.similarity, 9)) for r in links.collect()) == sorted(pairs)


def test_uncovered_by_group(spark):
    members = spark.createDataFrame([("e", "a", False), ("e", "b", False), ("e", "c", True), ("e", "d", True), ("f", "x", False), ("f", "y", True)], "g string, m string, new boolean")
    covered = spark.createDataFrame([("e", 1, "a"), ("e", 1, "b"), ("e", 2, "a"), ("e", 3, "a"), ("e", 3, "b"), ("e", 3, "c"), ("e", 4, "a"), ("e", 4, "b"), ("e", 4, "c"), ("e", 4, "d"), ("f", 5, "x")], "g string, h int, m string")
    got = mining.uncovered(members, covered, "h", "m", F.col("new"), by=["g"]).collect()
    assert sorted((r.g, r.h, r.missing) for r in got) == [("e", 1, ["c", "d"]), ("e", 3, ["d"]), ("f", 5, ["y"])]


def test_shortest_rings(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "y")], "src string, dst string")
    got = {r.node: r.ring for r in graph.shortest_rings(e, spark.createDataFrame([("a",), ("c",), ("d",), ("x",)], "node string")).collect()}
    assert got == {"a": ["a", "b", "a"], "c": ["c", "a", "b", "c"], "d": ["d", "e", "f", "d"], "x": None}


def test_cycles_on_random_graphs(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    far = {}
    for n in {x for e in edges for x in e}:
        seen, stack = set(), [n]
        while stack:
            x = stack.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    stack.append(b)
        far[n] = seen
    want = {}
    for n in far:
        group = {m for m in far if m in far[n] and n in far[m]}
        if len(group | {n}) > 1:
            want[n] = min(group | {n})
    assert {r.node: r.component for r in graph.cycles(spark.createDataFrame(edges, "src int, dst int")).collect()} == want


def test_baskets_leave_sweeps_out(spark):
    data = [(c, f) for c in range(6) for f in ("a", "b")] + [(9, "a")] + [(10, f"x{i}") for i in range(30)]
    got = mining.baskets(spark.createDataFrame(data, "c int, f string"), "c", "f")
    assert {(r.item, r.partner, r.together, r.total) for r in got.collect()} == {("a", "b", 6, 7), ("b", "a", 6, 6)}


def test_verdicts(spark):
    f = spark.createDataFrame([("x", "high", False), ("y", "high", True), ("z", "low", True), ("x", "low", True)], "p string, severity string, blocking boolean")
    assert rows(ranking.verdict(f, ["p"])) == [("x", "review"), ("y", "block"), ("z", "ok")]
    assert ranking.verdict(f.filter("p = 'none'")).head().verdict == "ok"


def test_text_functions(spark):
    paths = ["src/pkg/mod.py", "pkg/__init__.py", "tests/test_a.py", "pkg/a_test.py", "pkg/testing/x.py", ".git/x.py", "a/build/x.c", "Conftest.py", "conftest.py", "lib/tests/x.java", "testimony.py"]
    c = F.col("p")
    got = {r.p: r for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.module_name(c).alias("m"), T.is_test_path(c).alias("t"), T.is_test_file(c).alias("f"), T.in_skipped_dir(c).alias("s"), T.language(c).alias("l")).collect()}
    assert got["src/pkg/mod.py"].m == "pkg.mod" and got["pkg/__init__.py"].m == "pkg"
    assert {p for p in paths if got[p].t} == {"tests/test_a.py", "pkg/a_test.py", "pkg/testing/x.py", "conftest.py", "lib/tests/x.java"}
    assert {p for p in paths if got[p].f} == {"tests/test_a.py", "pkg/a_test.py", "lib/tests/x.java", "testimony.py"}
    assert {p for p in paths if got[p].s} == {".git/x.py", "a/build/x.c"} and got["a/build/x.c"].l == "c"
    one = lambda e: spark.range(1).select(e.alias("x")).head().x
    assert one(T.name_words(F.lit("parseHTTPRequest_v2"))) == ["parse", "http", "request", "v", "2"]
    assert one(T.picture_digits(F.lit("S9(5)V99"))).asDict() == {"whole": 5, "fraction": 2}
    assert one(T.shortened(F.lit("a  b\nc dddd"), 7)) == "a b c…" and one(T.big_o(F.lit(2), F.lit(1))) == "O(n^2 log n)"
    assert one(T.excluded(F.lit("a/b/c.py"), ["a/*.py"])) and one(T.excluded(F.lit("a/b/c.py"), ["a/"])) and not one(T.excluded(F.lit("ab/c.py"), ["a"]))
    assert one(T.short_hash(F.lit("a"), F.lit("b"))) == __import__("hashlib").sha1(b"a\0b").hexdigest()[:12]
    assert len(one(T.shingles(F.split(F.lit("a b c d e"), " "), 4))) == 2 and one(T.shingles(F.split(F.lit("a"), " "), 4)) == []
    assert math.isclose(one(F.lit(0.95) * 0.9), 0.855)


def test_similar_classes_send_each_set_once(spark):
    """Sets of a cluster go to one place to be compared, whatever the number of pairs; a set that shares but a few items with others is sent nowhere."""
    import numpy as np

    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(i)], "b long, a long")
    sets = spark.createDataFrame([(i, list(range(i, i + 100))) for i in range(41)], "i long, s array<long>")
    got = mining.compared(pairs, sets, 0.8)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in got.collect()) == [(j, i, round((100 - i + j) / (100 + i - j), 9)) for j in range(40) for i in range(j + 1, 40) if (100 - i + j) / (100 + i - j) >= 0.8]
    few = mining.prefixes(sets, 0.8, np.zeros(mining.BUCKETS, np.int64)).collect()
    assert len(few) == 41 and all((r.size, r.s) == (100, list(range(r.i, r.i + 21))) for r in few)

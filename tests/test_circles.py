"""Components found where edges lie, and what is left to go on from there."""

import random

import pytest

from driftwake.operators import graph


def brute(edges):
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
    groups = {n: {m for m in far if m in far[n] and n in far[m]} | {n} for n in far}
    return {n: min(g) for n, g in groups.items() if len(g) > 1}


def test_edges_that_lie_together_end_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(graph, "spread", lambda *a: pytest.fail("edges were dealt anew"))
    monkeypatch.setattr(graph, "coloured", lambda *a: pytest.fail("edges were dealt anew"), raising=False)
    rng = random.Random(3)
    edges = [(f"{g}é{rng.randrange(9)}", f"{g}é{rng.randrange(9)}") for g in range(24) for _ in range(14)]
    e = spark.sparkContext.parallelize(edges, 4).toDF("src string, dst string")  # six groups a task
    assert {r.node: r.component for r in graph.cycles(e).collect()} == brute([x for x in edges if x[0] != x[1]])


@pytest.mark.parametrize("held, struct", [(20, False), (60, True), (1000, False)])
def test_edges_that_lie_anywhere(spark, monkeypatch, held, struct):
    monkeypatch.setattr(graph, "HELD", held)
    rng = random.Random(held)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(100)] + [(200 + i, 200 + (i + 1) % 17) for i in range(17)] + [(300, 300), (301, 302)]
    rng.shuffle(edges)
    name = (lambda n: {"g": None if n % 2 else "g", "n": n}) if struct else (lambda n: n)
    kind = "struct<g: string, n: int>" if struct else "int"
    e = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"src {kind}, dst {kind}").repartition(3)
    got = {r.node: r.component for r in graph.cycles(e).collect()}
    if struct:
        order = {n: (0 if n % 2 else 1, n) for n in range(400)}  # nulls first
        want = brute([(order[a], order[b]) for a, b in edges if a != b])
        assert {order[n.n]: order[c.n] for n, c in got.items()} == want
    else:
        assert got == brute([x for x in edges if x[0] != x[1]])

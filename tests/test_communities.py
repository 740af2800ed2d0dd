from driftwake.operators import graph


def brute(edges, rounds=30):
    near = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {}).setdefault(y, 0)
            near[x][y] += w
    label = {x: x for x in near}
    for _ in range(rounds):
        new = {}
        for x, others in near.items():
            votes = {}
            for y, w in others.items():
                votes[label[y]] = votes.get(label[y], 0) + w
            new[x] = min(votes, key=lambda k: (-votes[k], k))
        label = new
    return label


def test_labels_settle_on_a_long_graph(spark):
    """Labels walk from triangle to triangle, further than five rounds take them."""
    edges = [(2 * i + a, 2 * i + b, 1) for i in range(12) for a, b in ((0, 1), (0, 2), (1, 2))]
    want = brute(edges)
    assert want != brute(edges, 5)
    got = graph.communities(spark.createDataFrame(edges, "src long, dst long, weight long"))
    assert {r.node: r.label for r in got.collect()} == want


def test_labels_that_swing_end_as_after_all_rounds(spark):
    """In a star the middle and its leaves swap labels for ever; an odd count of rounds and an even one end differently."""
    edges = [(9, i, 1) for i in range(4)] + [(20, 21, 2), (21, 22, 1), (22, 20, 1)]
    assert brute(edges, 3) != brute(edges, 30)
    for rounds in (0, 3, 30):
        got = graph.communities(spark.createDataFrame(edges, "src long, dst long, weight long"), rounds)
        assert {r.node: r.label for r in got.collect()} == brute(edges, rounds), rounds

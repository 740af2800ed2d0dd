import random
import zlib
from collections import Counter

import numpy as np
import pytest

from driftwake.llm import toxicity as T
from tests.llm import cases

LABELS = "doc_id long, toxic int"


def corpus(n=700, seed=4):
    """Prose, of which an eighth is sown with insults of the lists, or with words that begin like no others; a few labels are wrong."""
    rng = random.Random(seed)
    rows, true = [], {}
    for i in range(n):
        words = cases.prose(i, rng.choice([25, 60, 150])).split(" ")
        true[i] = rng.random() < 0.125
        if true[i]:
            bad = rng.choice([["idiot", "scum", "moron", "loser", "trash"], [f"grimpf{x}" for x in ("a", "elo", "uty", "anz", "ib")]])
            for _ in range(max(2, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 1))
    labels = [(i, int(true[i]) if rng.random() > 0.02 else int(not true[i])) for i in range(n) if rng.random() < 0.6]
    return rows, labels, true


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("toxic")
    rows, labels, true = corpus()
    cases.frame(spark, rows).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{home}/labels.parquet")
    return T.op12_weak_labels(spark, str(home)).collect(), true


def test_held_out(told):
    got, true = told
    assert len(got) == len(true) and all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    bad, good = [r.score for r in out if true[r.doc_id]], [r.score for r in out if not true[r.doc_id]]
    assert np.mean([b > g for b in bad for g in good]) > 0.97
    assert np.mean([s >= 0.3 for s in bad]) > 0.85 and np.mean([s >= 0.3 for s in good]) < 0.02


def test_held_out_labels_teach_nothing(spark, told):
    rows, labels, _ = corpus()
    turned = [(i, 1 - y if held(i) else y) for i, y in labels] + [(None, 1), (5, None)]
    docs = cases.frame(spark, rows)
    model = T.fit(docs, spark.createDataFrame(turned, LABELS))
    got = {r.doc_id: r.score for r in T.score(docs, model.linear).collect()}
    assert all(abs(got[r.doc_id] - r.score) < 1e-9 for r in told[0])


def test_odd_rows(spark):
    rows, labels, _ = corpus(300)
    model = T.fit(cases.frame(spark, rows), spark.createDataFrame([*labels, *labels[:9]], LABELS))
    got = T.score(cases.frame(spark), model.linear).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2, 3)}) == 1  # null and without words
    assert T.score(cases.empty(spark), model.linear).collect() == []


@pytest.mark.parametrize("labels, want", [([], 0.0), ([(0, 1), (4, 1)], 1.0), ([(0, 0)], 0.0)])
def test_without_two_classes(spark, labels, want):
    docs = cases.frame(spark)
    labels = [(i, y) for i, y in labels if not held(i)]
    assert labels or want == 0.0
    model = T.fit(docs, spark.createDataFrame(labels, LABELS))
    assert {r.score for r in T.score(docs, model.linear).collect()} == {want}


def test_label_model_finds_accuracies_and_correlations(spark):
    """Votes drawn from a known model, one voter repeating another: posteriors near the true ones, which counting would miss."""
    rng = np.random.default_rng(3)
    n = 40_000
    y = rng.random(n) < 0.2
    votes = np.zeros((n, T.VOTERS), np.int64)
    hit = [0.9, 0.7, 0.6, 0.8]
    false = [0.02, 0.1, 0.05, 0.2]
    for j in range(4):
        votes[:, j] = rng.random(n) < np.where(y, hit[j], false[j])
    for j in (4, 5):  # echoes of voter 3
        votes[:, j] = np.where(rng.random(n) < 0.97, votes[:, 3], rng.random(n) < 0.3)
    odds = np.log(0.2 / 0.8) + sum(np.where(votes[:, j] == 1, np.log(hit[j] / false[j]), np.log((1 - hit[j]) / (1 - false[j]))) for j in range(4))
    true = 1 / (1 + np.exp(-odds))
    gold = np.where(rng.random(n) < 0.02, y ^ (rng.random(n) < 0.03), -1).astype(np.int64)
    packed = (votes << T.SHIFT).sum(1)
    counts = Counter(zip(packed.tolist(), gold.tolist()))
    patterns = spark.createDataFrame([(*k, c) for k, c in counts.items()], "votes long, gold long, n long")
    model = T.label_model(patterns)
    assert abs(model.share - 0.2) < 0.02 and 0.93 < model.gold < 0.99
    assert {model.parent[4], model.parent[5], model.parent[3]} & {3, 4, 5}
    q = model.posterior(packed, np.full(n, -1))
    assert np.abs(q - true).mean() < 0.02
    x = np.exp(model.tables[0, :, 0, 1])
    assert abs(x[1] - 0.9) < 0.05 and abs(x[0] - 0.02) < 0.02


def test_posterior_by_hand():
    rng = np.random.default_rng(1)
    t = rng.random((T.VOTERS, 2, 3, 3)) + 0.1
    t /= t.sum(-1, keepdims=True)
    parent = [-1] + [int(rng.integers(0, j)) if j % 2 else -1 for j in range(1, T.VOTERS)]
    model = T.LabelModel(0.3, 0.9, parent, np.log(t))
    votes = rng.integers(0, 3, (50, T.VOTERS))
    got = model.posterior((votes << T.SHIFT).sum(1), np.array([-1, 0] * 25))
    for i, v in enumerate(votes):
        p = [0.7, 0.3]
        for y in (0, 1):
            for j, u in enumerate(parent):
                p[y] *= t[j, y, v[u] if u >= 0 else 0, v[j]]
        if i % 2:
            p = [p[0] * 0.9, p[1] * 0.1]
        assert got[i] == pytest.approx(p[1] / sum(p))


def test_g_test_and_bags():
    texts = ["alpha beta", "Alpha alphabets, alphabetic", None, ""]
    bags = T.Bags(texts)
    rows = {(int(r), f): int(c) for f, i in bags.number.items() for r, j, c in zip(bags.rows, bags.ids, bags.counts) if j == i}
    assert rows[1, "^alph"] == 3 and rows[0, "^alph"] == 1 and (0, "^beta") not in rows and rows[1, "^alphabe"] == 2
    g = T.g_test(np.array([10.0, 0, 5]), np.array([0.0, 10, 5]), 20, 20)
    assert g[0] > 10 and g[1] < -10 and abs(g[2]) < 1e-9

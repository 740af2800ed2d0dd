"""Quality classifier, URL filter, language model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from driftwake.llm import lm, quality, urls
from tests.llm import cases


def test_quality_learns_and_scores_held_out(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = cases.prose(i, 40) if good else " | ".join(f"{cases.prose(i * 7 + j, 2)} %%%" for j in range(8)) if rng.random() < 0.5 else "spam " * 30
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good)))
    d = cases.frame(spark, docs + cases.rows()[30:])
    model = quality.fit(d, spark.createDataFrame([*labels, (None, 1), (5, None), (99999, 0)], "doc_id long, quality int"))
    got = [r for r in quality.score(d, model, ["doc_id"]).collect()]
    assert len(got) == len(docs) + len(cases.rows()[30:]) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.5, labels[r.doc_id][1]) for r in got if r.doc_id is not None and r.doc_id >= 40 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_quality_does_not_read_held_out_labels(spark):
    docs = [(i, cases.prose(i, 20), "en", "s", 1) for i in range(40)]
    flip = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    scores = []
    for x in (0, 1):
        labels = spark.createDataFrame([(i, (i % 2) ^ (x if flip(i) else 0)) for i in range(40)], "doc_id long, quality int")
        d = cases.frame(spark, docs, False)
        scores.append(sorted(map(tuple, quality.score(d, quality.fit(d, labels), ["doc_id"]).collect())))
    assert scores[0] == scores[1]


def test_quality_without_labels_or_rows(spark):
    d, none = cases.frame(spark, clash=False), spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(d, quality.fit(d, none), ["doc_id"]).collect()} == {1.0}
    one = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.score(d, quality.fit(d, one), ["doc_id"]).collect()} == {0.0}
    e = cases.empty(spark)
    assert quality.score(e, quality.fit(e, none), ["doc_id"]).collect() == []


PAGES = [None, "", "no scheme", "://", "http://Example.ORG/es/x", "http://example.org/en/12?q", "https://a.example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/a#f", "http://x.com/en/?://org/", "ftp://org", "http://org/", "http://com/de/", "a://b://c/d", "http://x.net/" + "y" * 20000, "http://ÜBER.org/É?x", "http://Y.COM?a/de/"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, None
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host = rest[: ends[0]] if ends else rest
    tail = rest[len(host) :]
    cut = [i for i, c in enumerate(tail) if c in "?#"]
    path = tail[: cut[0]] if cut else tail
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0]), default=(None, None))
    return host, path, *best


def test_urls_rules_and_models(spark):
    known = [f"http://site{i}.example.org/{'en/2' if i % 2 else 'es/'}{i}" for i in range(200)]
    other = [f"http://z{i}.net/{'en/2' if i % 2 else 'es/'}{i}" for i in range(100)]
    pages = PAGES + known + other + PAGES[:6]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(pages)] + [(None, "http://a.net/en/2", "h")], "page_id long, url string, host string").repartition(3)
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(got) == len(pages) + 1
    for i, u in enumerate(pages):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") if verdict is None else got[i].verdict == verdict
    judged = [got[len(PAGES) + len(known) + i].verdict == ("allow" if i % 2 else "block") for i in range(len(other))]
    assert sum(judged) >= 90
    assert urls.judge(df.filter("page_id < 0")).collect() == []
    assert {r.verdict for r in urls.judge(df.filter("page_id < 4")).collect()} == {"allow"}


def test_urls_learn_from_every_labelled_one(spark):
    """Counts of all labelled URLs, added up over partitions, are those of one pass; the threshold is that of all kept back."""
    rows = [(i % 3 > 0, f"http://site{i}.org/{'a' if i % 3 else 'b'}/{i}") for i in range(1500)]
    known = spark.createDataFrame([(int(k), u, i % 5 == 4) for i, (k, u) in enumerate(rows)], "kind int, url string, back boolean").repartition(7)
    n = urls.tables(known.select("kind", "url"))
    for kind in (0, 1):
        one = urls.Markov([u.encode() for k, u in rows if k == kind])
        assert (n[kind] == np.stack((one.context, one.after))).all() and n[kind, 0, 0].sum() == sum(len(u) for k, u in rows if k == kind)
    ratio = urls.train(known)
    assert all((ratio.of(u.encode()) >= ratio.least) == k for k, u in rows)
    assert urls.threshold([(0, -3, 5), (1, -3, 1), (0, 2, 1), (1, 4, 9)]) == 4 / urls.STEPS and urls.train(known.filter("kind = 1")) is None


def test_markov_probabilities_add_up():
    m = urls.Markov([b"http://a.org/x", b"http://b.org/y"])
    s = urls.slots(b"http://a.")
    ends = []
    for c in range(256):
        t = urls.slots(b"http://a." + bytes([c]))
        ends.append(2 ** (m.log2(t) - m.log2(s)))
    assert sum(ends) == pytest.approx(1, abs=0.05)  # hashed tables may share a slot


def test_attention_gradients():
    rng = np.random.default_rng(0)
    counts = np.zeros(lm.IDS + 1, np.int64)
    counts[:50] = 10
    counts[lm.IDS] = 5
    model = lm.train([], counts)
    w = {k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in model.weights.items()}
    seen, target = rng.integers(0, 60, (4, lm.WIDTH)), rng.integers(0, 60, (4, lm.STRIDE))
    weight, first = rng.random((4, lm.STRIDE)) < 0.8, np.array([True, False, True, False])

    def loss(w):
        m = lm.Model(None, None, model.place, w)
        p = [m.log(m.hidden(seen[i : i + 1], bool(first[i]))[0][weight[i]], target[i][weight[i]]).sum() for i in range(4)]
        return -sum(p) / weight.sum()

    g = lm.gradients(w, model.place, seen, target, weight, first)
    for k in w:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            if k == "e":
                at = (int(rng.choice(seen.ravel())), at[1])
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=1e-6, rel=1e-3), k


def test_attention_sums_to_one_and_scores_each_token_once():
    rng = np.random.default_rng(1)
    texts = [np.array([*rng.integers(0, 40, n), lm.IDS]) for n in rng.integers(0, 120, 60)]
    counts = np.bincount(np.concatenate(texts), minlength=lm.IDS + 1)
    model = lm.train(texts, counts)
    t = model.token_of[texts[3]]
    h = model.hidden(np.zeros((1, lm.WIDTH), np.int64), True)[0][:1]
    assert np.exp(model.log(np.repeat(h, lm.VOCABULARY, 0), np.arange(lm.VOCABULARY)).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    assert (10 ** model.rare[: lm.IDS][model.token_of[: lm.IDS] == lm.RARE]).sum() == pytest.approx(1)
    # one text alone, together with others, and token by token from its own windows
    alone = model.score(t, np.array([len(t)]))[0]
    together = model.score(np.concatenate([model.token_of[x] for x in texts]), np.array(list(map(len, texts))))
    assert together[3] == pytest.approx(alone, rel=1e-4)
    total = 0.0
    for a in range(0, len(t), lm.STRIDE):
        seen = np.zeros((1, lm.WIDTH), np.uint16)
        for j in range(lm.WIDTH):
            at = a - lm.BEFORE + j
            seen[0, j] = t[at - 1] if 0 < at <= len(t) else lm.END
        part = t[a : a + lm.STRIDE]
        total += model.log(model.hidden(seen, a == 0)[0][: len(part)], part).sum()
    assert total / math.log(10) == pytest.approx(alone, rel=1e-4)


@pytest.mark.parametrize("head", [lm.HEAD, 10])
def test_lm_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "FLUSH", 50)
    monkeypatch.setattr(lm, "STEPS", 20)
    data = cases.rows()
    got = lm.score(cases.frame(spark)).collect()
    counts: Counter = Counter()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    for i, t, *_ in data:
        if not held(i):
            counts.update(lm.words(t))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in data:
        w = [*lm.words(t), None]
        want.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)))
    assert sorted(((*r[:5], round(r[5], 4)) for r in got), key=str) == sorted(want, key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = [r.score for r in got if r.doc_id in (7, 8)]  # equal texts
    assert max(same) - min(same) < 1e-3


def test_lm_empty_and_no_training(spark):
    assert lm.score(cases.empty(spark)).collect() == []
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score(cases.frame(spark, [(i, "a b", "", "", 1)])).head()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.score < 0


def test_quality_score_by_hand():
    """A score from the weights: each word's own bucket, those of its n-grams and those of pairs of neighbours, averaged, one by one."""
    import math
    import zlib

    import numpy as np

    from driftwake.llm import quality as Q

    rng = np.random.default_rng(7)
    model = Q.Model(rng.standard_normal(Q.BUCKETS).astype(np.float32), 0.3)
    texts = ["One two two three", "", None, "ñandú  İx a", "word " * 50, "a\x00b c", "lonely"]

    def pair(a: bytes, b: bytes) -> int:
        mask, mix = (1 << 64) - 1, int(Q.MIX)
        x = (((zlib.crc32(a) + 1) * mix + zlib.crc32(b) + 1) * mix) & mask
        x ^= x >> 29
        return ((x * mix & mask) >> 32) % Q.BUCKETS

    for text, got in zip(texts, model.scorer()(texts)):
        said = (text or "").lower().encode().split()
        found = []
        for w in said:
            marked = f"<{w.decode()}>"
            found.append(zlib.crc32(w) % Q.BUCKETS)
            found += [zlib.crc32(marked[i : i + n].encode(), n) % Q.BUCKETS for n in Q.GRAMS for i in range(len(marked) - n + 1)]
        found += [pair(a, b) for a, b in zip(said, said[1:])]
        x = 0.3 + (sum(float(model.weights[i]) for i in found) / len(found) if found else 0.0)
        assert abs(got - 1 / (1 + math.exp(-x))) < 1e-9

"""The registered queries themselves, over small tables, against brute force that shares no code with them."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftwake.llm import lm, queries, urls
from tests.llm import cases
from tests.llm.test_lines import brute as line_dedup
from tests.llm.test_models import plain
from tests.llm.test_secrets import base
from tests.llm.test_simhash import grouping, slow

CARD = "4111 password = hunter2hunter2 AKIA" + "Z9" * 10


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*cases.texts(), CARD, "a<|endoftext|>b", *(cases.prose(i, 40, 3000) for i in range(200, 320))])]
    spark.createDataFrame(rows, cases.SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, cases.prose(205, 40, 3000)), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    links = [f"http://site{i}.example.org/{'en/2' if i % 2 else 'es/'}{i}" for i in range(60)] + [f"http://z{i}.net/{'en/2' if i % 2 else 'es/'}{i}" for i in range(40)] + [None, "", "x"]
    spark.createDataFrame(list(enumerate(links)), "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    rng = np.random.default_rng(9)
    spark.createDataFrame([(i % 230, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(260)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at, rows, links


@pytest.fixture(scope="module")
def duck(home):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{home[0]}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_windows"])
def test_like_sql(spark, home, duck, name):
    df = queries.QUERIES[name](spark, home[0])
    rows = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in rows.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, rows.fetchall()))


def test_op2_packs_the_tokenizers_ids(spark, home):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text, *_ in home[1]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, len(ids))]
    got = queries.QUERIES["op2_best_fit"](spark, home[0]).collect()
    own = defaultdict(list)
    for r in got:
        own[r.doc_id].append(r)
    assert sorted(own) == [i for i, _ in want]
    for i, text, *_ in home[1]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    full = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert full[r.sequence_id] == r.offset
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048 and sum(full.values()) > 0.9 * 2048 * (len(full) - 1)


def test_op3_base_spans(spark, home):
    text = {i: t or "" for i, t, *_ in home[1]}
    for r in queries.QUERIES["op3_entropy"](spark, home[0]).collect():
        kinds = [k for _, k, _ in base(text[r.doc_id])]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in range(3))


def test_op5_rules_and_the_models_verdict(spark, home):
    """The models again with dictionaries instead of hashed tables: the verdicts are the same."""
    got = {r.page_id: r for r in queries.QUERIES["op5_markov"](spark, home[0]).collect()}
    links = home[2]
    for i, u in enumerate(links):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and (verdict is None or got[i].verdict == verdict)

    class Plain:
        def __init__(self, seen):
            self.context, self.after = Counter(), Counter()
            for u in seen:
                data = bytes(urls.ORDER) + u
                for p in range(urls.ORDER, len(data)):
                    for k in range(urls.ORDER + 1):
                        c = data[p - k : p]
                        self.context[k, c] += 1
                        self.after[k, c, data[p]] += 1

        def log2(self, u):
            data, total = bytes(urls.ORDER) + u, 0.0
            for p in range(urls.ORDER, len(data)):
                x = 1 / 256
                for k in range(urls.ORDER + 1):
                    c = data[p - k : p]
                    x = (self.after[k, c, data[p]] + urls.SMOOTH * x) / (self.context[k, c] + urls.SMOOTH)
                total += math.log2(x)
            return total

    some = [f"http://site{i}.example.org/{w}{i}".encode() for i in range(12) for w in ("en/2", "es/")]
    one, two = urls.Markov(some), Plain(some)
    for u in (b"http://site3.example.org/es/9", b"http://z.net/en/2", b"q"):
        assert one.log2(urls.slots(u)) == pytest.approx(two.log2(u), rel=0.02)


def test_op6_score_by_hand(spark):
    """Each token's probability from the weights, one by one, without windows cut in batches."""
    rng = np.random.default_rng(5)
    texts = [np.array([*rng.integers(0, 90, n), lm.IDS]) for n in rng.integers(1, 70, 40)]
    model = lm.train(texts, np.bincount(np.concatenate(texts), minlength=lm.IDS + 1))
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def probability(t, i):
        start = i // lm.STRIDE * lm.STRIDE
        first = max(0, start - lm.BEFORE)
        seen = [lm.END, *t[:-1]]
        x = np.array([w["e"][seen[j]] + w["p"][j - start + lm.BEFORE] for j in range(first, i + 1)])
        a = np.array([x[-1] @ w["q"] @ (w["k"].T @ y) for y in x]) / math.sqrt(lm.DIMENSIONS)
        a = np.exp(np.minimum(a, 30))
        h = x[-1] + (a / a.sum()) @ (x @ w["v"])
        c, s = divmod(int(model.place[t[i]]), lm.SLOTS)
        soft = lambda z: np.exp(np.clip(z, -30, 30)) / np.exp(np.clip(z, -30, 30)).sum()
        return soft(h @ w["c"] + w["cb"])[c] * soft(h @ w["u"][c] + w["ub"][c])[s]

    for n in (0, 7, 21):
        t = model.token_of[texts[n]]
        want = sum(math.log10(probability(t, i)) for i in range(len(t)))
        assert model.score(t, np.array([len(t)]))[0] == pytest.approx(want, rel=1e-3)


def test_op7_groups(spark, home):
    rows = home[1]
    want = grouping([slow(r[1]) for r in rows])
    got = {r.doc_id: r for r in queries.QUERIES["op7_pivots"](spark, home[0]).collect()}
    assert [got[r[0]].component_id for r in rows] == want and all(got[r[0]].fingerprint == f"{slow(r[1]):016x}" for r in rows)


def test_op8_held_out(spark, home):
    got = queries.QUERIES["op8_subwords"](spark, home[0]).collect()
    assert len(got) == len(home[1]) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_op9_law_and_places(spark, home):
    got = queries.QUERIES["op9_virtual_slots"](spark, home[0]).collect()
    text = {i: t or "" for i, t, *_ in home[1]}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(16))


def test_op10_lines(spark, home):
    got = {r.doc_id: r.text for r in queries.QUERIES["op10_deletions"](spark, home[0]).collect()}
    small = [(i, t) for i, t, *_ in home[1] if t is None or len(t) < 3000]
    kept = {i: t for i, t, *_ in line_dedup([(i, t) for i, t, *_ in home[1] if t is None or len(t) < 20000])}
    assert all(got[i] == kept[i] for i, _ in small if i < 11)

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from driftwake.llm import trie as T
from tests.llm.cases import CLASH

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, data):
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in CLASH if c != "n"})


def signed(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def brute(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", signed(text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in kids[k])
    out = []
    for k, m in members.items():
        end = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out, key=str)


def some(seed, n=120, words=4, longest=9):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randrange(words)))
    out = []
    for c in rng.sample(range(400), n):
        out += [(c, None if rng.random() < 0.05 else rng.randrange(6) if rng.random() < 0.1 else i, rng.choice(["user", "bot", None]), rng.choice([text(), text(), None])) for i in range(rng.randrange(1, longest))]
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    data = some(seed)
    assert got(T.trie(frame(spark, data))) == brute(data)


def test_long_conversation_hot_first_turn_and_copies(spark):
    data = [(40, i, "user", "word " * (i % 3)) for i in range(700)]  # longer than a partition
    data += [(41, i, "user", "word " * (i % 3)) for i in range(350)]  # leaves it half-way
    data += [(c, i, "user", t) for c in range(1000, 1300, 20) for i, t in enumerate(["hello", "same", "end"])]
    data += [(2000, 0, "user", "x")] * 40 + [(-5, i, "bot", "n") for i in range(4)] + [(-20, i, "bot", "m") for i in range(4)]
    data += [(7, 0, "user", "only")] + [(None, 0, "user", "x"), (3000, None, None, None), (3020, 0, "bot", "z" * 50000), (3020, 1, "bot", "one\x0btwo three")]
    assert got(T.trie(frame(spark, data))) == brute(data)


def test_equal_hashes_and_fingerprints_are_split(spark):
    data = some(9, 60, 3, 6)
    assert got(T.trie(frame(spark, data), mask=1)) == brute(data)
    assert got(T.trie(frame(spark, data), moduli=(3, 5, 2))) == brute(data)
    assert got(T.trie(frame(spark, data), moduli=(2, 2, 2), mask=3)) == brute(data)


def test_none(spark):
    assert T.trie(frame(spark, [])).collect() == []
    assert T.trie(frame(spark, [(None, 1, "a", "b")])).collect() == []
    one = [(3, 0, "user", "a b")]
    assert got(T.trie(frame(spark, one))) == brute(one)


def test_sums_are_the_same_however_turns_are_cut():
    """Scans of parts, put together, against the definition."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = 60
    cols = [np.sort(rng.integers(0, 4, n)), *(rng.integers(-(1 << 62), 1 << 62, n) for _ in range(2)), np.zeros(n, np.int64), np.ones(n, np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["conv", "a", "b", "level", "words"])
    whole = T.Turns(batch, T.MODULI)
    for cut in (1, 7, 30, 59):
        state = T.State()
        for part in (batch.slice(0, cut), batch.slice(cut)):
            t = T.Turns(part, T.MODULI)
            state.absorb([t.run(i) for i in range(len(t.starts))], T.MODULI)
        assert state.now == whole.run(len(whole.starts) - 1)
    last = [i for i in range(n) if cols[0][i] == cols[0][-1]]
    for j, m in enumerate(T.MODULI):
        assert state.now.total[j] == sum(int(whole.turn[j][i]) * pow(T.BASE, k, m) for k, i in enumerate(last, 1)) % m

import zlib

import numpy as np
import pytest

from driftwake.llm import packing as P
from tests.llm import cases


def best_fit(lengths, window):
    """One piece at a time, longest first, into the tightest open window: the number of windows, and what is left in each."""
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(left) if r >= n]
        if fit:
            i = min(fit, key=left.__getitem__)
            left[i] -= n
        else:
            left.append(window - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng, window = np.random.default_rng(seed), 64
    lengths = rng.integers(1, window + 1 if seed % 2 else 20, 500).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows, used = P.plan(counts, window), {}
    for i, (length, rank, per, first, offset) in enumerate(rows):
        stop = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else counts[length]
        for k in range(stop - rank):
            at = offset + k % per * length
            assert used.setdefault(first + k // per, 0) == at
            used[first + k // per] = at + length
    assert sorted(window - u for u in used.values()) == best_fit(lengths, window)


def test_segment_tree():
    tree, there = P.Capacities(50), set()
    rng = np.random.default_rng(0)
    for _ in range(400):
        c = int(rng.integers(0, 51))
        there ^= {c}
        tree.set(c, c in there)
        least = int(rng.integers(0, 51))
        assert tree.tightest(least) == min((x for x in there if x >= least), default=None)


def test_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = [*cases.rows(), (500, "<|endoftext|> is an id", "en", "s", 1), (501, "a<|endoftext|> b<|endoftext|><|endoftext|>", "en", "s", 1), (502, "<|endoftext", "en", "s", 1)]
    got = P.pack(cases.frame(spark, data), 256).collect()
    want = sorted(((r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in data), key=str)
    pieces = sorted((r.doc_id is None, r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got)
    expected = []
    for i, ids in want:
        for s in range(0, len(ids), 256):
            part = ids[s : s + 256]
            expected.append((i is None, i, len(ids), s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(pieces, key=key) == sorted(expected, key=key)
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 256 and sorted(sequences) == list(range(len(sequences)))


def test_empty_table(spark):
    assert P.pack(cases.empty(spark)).collect() == []

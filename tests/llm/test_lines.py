import random

import pytest

from driftwake.llm import lines as L
from tests.llm import cases


def near(a, b):
    """Edit distance in words by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 1


def brute(docs):
    """docs: (doc_id, text), distinct; in the order (id, hash) that the caller gives."""
    seen, out = [], []
    known = set()
    for i, t in docs:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        parts, keep = t.split("\n"), []
        for line in parts:
            if not line.strip(" \t\r\x0b\x0c"):
                keep.append(line)
                continue
            w = line.split(" ")
            gone = line in known or any(max(len(w), len(v)) >= 5 and near(w, v) for v in seen)
            if line not in known:
                known.add(line)
                seen.append(w)
            if not gone:
                keep.append(line)
        out.append((i, "\n".join(keep), len(parts), len(parts) - len(keep)))
    return out


def edits(seed, n=120):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(12)] + ["", "é"]
    docs = []
    base = [[rng.choice(lexicon[:12]) for _ in range(rng.randrange(3, 12))] for _ in range(15)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(at, rng.choice(lexicon))
            elif at < len(w) and len(w) > 1:
                w[at : at + 1] = [] if kind == 1 else [rng.choice(lexicon)]
        docs.append((i // 3, " ".join(w)))
    out = {}
    for i, line in docs:
        out.setdefault(i, []).append(line)
    return [(i, "\n".join(v)) for i, v in out.items()]


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(spark, seed):
    docs = edits(seed)
    got = L.dedup(cases.frame(spark, [(i, t, "en", "s", 1) for i, t in docs]).drop("n_lines")).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_edge_cases(spark):
    data = [r for r in cases.rows() if r[0] is not None and (r[1] is None or len(r[1]) < 20000)]
    seen, docs = set(), []
    for r in data:
        if (r[0], r[1]) not in seen and r[1] != "another text of the same id":
            seen.add((r[0], r[1]))
            docs.append((r[0], r[1]))
    want = {i: (t, n, d) for i, t, n, d in brute(sorted(docs, key=lambda r: r[0]))}
    got = L.dedup(cases.frame(spark)).select("doc_id", "text", "n_lines", "n_dropped", "lang", "w").collect()
    assert len(got) == len(cases.rows()) and all(r.w == "clash" for r in got)
    for r in got:
        # the two rows without an id come first, and have all lines of document 7
        if r.doc_id in want and r.doc_id not in (7, 8, 9, 11, 12) and r.text != "another text of the same id":
            assert (r.text, r.n_lines, r.n_dropped) == want[r.doc_id], r.doc_id
        if r.doc_id == 7:
            assert r.text == ""
    assert {r.text for r in got if r.doc_id is None} == {None, cases.prose(1, 60)}


def test_long_line_and_empty_table(spark):
    long = " ".join(f"a{i}" for i in range(8000))
    data = [(1, long, "", "", 1), (2, long + " b", "", "", 1), (3, "x" * 100000, "", "", 1)]
    got = {r.doc_id: r.text for r in L.dedup(cases.frame(spark, data)).collect()}
    assert got == {1: long, 2: "", 3: "x" * 100000}
    assert L.dedup(cases.empty(spark)).collect() == []

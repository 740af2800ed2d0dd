import hashlib
import re

from driftwake.llm import decontaminate as D
from tests.llm import cases


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=10):
    wins = {}
    for item, t in items:
        w = words(t)
        for s in range(max(1, len(w) - size + 1)) if w else []:
            wins.setdefault(tuple(w[s : s + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, clash=True):
    d = cases.frame(spark, [(i, t, "en", "s", 1) for i, t in docs], clash)
    b = cases.frame(spark, items, clash, "item_id long, text string")
    return sorted((tuple(r)[:6] for r in D.decontaminate(d, b).collect()), key=str)


ITEMS = [(1, cases.prose(1, 60)[40:200]), (2, "one"), (3, None), (4, ""), (5, "--"), (None, cases.prose(2, 300)[300:420]), (11, cases.prose(2, 300)[300:420]), (7, "tie tie"), (8, "tie tie tie tie tie tie tie tie tie tie tie tie"), (1, "one two")]


def test_brute_force_on_edge_cases(spark):
    docs = [(r[0], r[1]) for r in cases.rows() if r[1] is None or len(r[1]) < 20000]
    docs.append((77, "tie " * 25 + "! ONE, two"))
    assert run(spark, docs, ITEMS) == brute(docs, ITEMS)


def test_no_short_items_uses_longer_shingles(spark):
    docs, items = [(r[0], r[1]) for r in cases.rows()[:12]], [i for i in ITEMS if i[1] and len(i[1]) > 30]
    assert run(spark, docs, items, False) == brute(docs, items)


def test_empty_tables(spark):
    docs = [(1, "a b"), (2, None)]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], ITEMS) == []


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs = [(r[0], r[1]) for r in cases.rows()[:11]] + [(None, cases.prose(2, 300)), (None, None), (9, cases.prose(2, 300)), (9, cases.prose(2, 300))]
    assert run(spark, docs, ITEMS) == brute(docs, ITEMS)

import hashlib
import math
import random
import re
from collections import Counter

from driftwake.llm import secrets as S
from tests.llm import cases


def base(t):
    kinds = [("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]
    out = []
    for i, (k, p) in enumerate(kinds):
        for m in re.finditer(p, t):
            if (len(m[2]) >= 6) if k == "assign" else len(m[0]) >= (20 if k == "access" else 24):
                out.append((m.start(), i, m.end()))
    return sorted(out)


def samples():
    rng = random.Random(3)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return [None, "", f'é password = "{key}" x', "token=token:abcdefgh", "token=ab secret:abcdef", "Api_KEY: 'abc.def=='", "AKIA" + "A1" * 9, "AKIAAKIA short", f"deadbeef {hexes}{hexes}", f"ünder {key} {key}", "toKen=abcdefg ſecret=abcdefg", "0123456789abcdef" * 3,
            "550e8400-e29b-41d4-a716-446655440000", "/usr/local/share/some-thing/else_where/lib64", "a" * 50000 + hexes, "x" * 25 + "9", key[:19], "2024-01-01T00-00-00-abcdefgh"], key, hexes


def test_base_spans_stay_and_are_exact(spark):
    texts, key, _ = samples()
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + cases.rows()
    got = sorted(map(tuple, S.scan(cases.frame(spark, data)).collect()), key=str)
    assert len(got) == len(data)
    by_hash = sorted((str(r[0]), r[1] or "") for r in data)
    want = []
    for i, t, *_ in data:
        b = base(t or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{x}:{y}" for x, k, y in b)
        want.append((i, *(sum(k == n for _, k, _ in b) for n in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str) and by_hash
    for r in got:
        assert r[5] == "" or all(re.fullmatch(r"\w+:\d+:\d+", x) for x in r[5].split(","))


def test_windows_equal_counting_afresh():
    texts, key, hexes = samples()
    rng = random.Random(1)
    for text, size, bits in [(key * 2, 20, 3.75), (hexes * 2, 24, 3.1), ("".join(rng.choice("ab1c") for _ in range(300)), 8, 1.4), (key + "a" * 40 + key, 20, 3.75)]:
        hot = set()
        for i in range(len(text) - size + 1):
            w = text[i : i + size]
            h = -sum(c / size * math.log2(c / size) for c in Counter(w).values())
            if h >= bits - 1e-9 and any(x.isdigit() for x in w) and any(x.isalpha() for x in w):
                hot.update(range(i, i + size))
        assert {i for a, b in S.windows(text, size, bits) for i in range(a, b)} == hot


def test_entropy_finds_keys_and_lets_usual_strings_be():
    texts, key, hexes = samples()
    assert S.entropy_spans(f"é {key} z") == [(2, 4, 42)]
    assert S.entropy_spans(hexes)[0][1] == 3
    for quiet in (texts[12], texts[13], texts[15], texts[16], texts[17], "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "EXAMPLE" + key):
        assert S.entropy_spans(quiet) == []


def test_a_key_beside_allowed_strings_is_found():
    _, key, _ = samples()
    for around in ("example_key={}", "2024-01-01/{}", "path/to/xxxx/{}", "https://db/{}/1234567"):
        text = around.format(key)
        at = text.index(key)
        assert any(a < at + 20 and b > at + 20 for a, _, b in S.entropy_spans(text)), text
    split = key[:18] + "XXXX" + key[18:]
    assert S.entropy_spans(split)


def test_long_blobs_take_linear_time():
    import time

    rng = random.Random(5)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400_000))
    began = time.process_time()
    S.entropy_spans(blob[:100_000])
    short = time.process_time() - began
    began = time.process_time()
    S.entropy_spans(blob)
    assert time.process_time() - began < 8 * short + 0.2


def test_empty_table(spark):
    assert S.scan(cases.empty(spark)).collect() == []

"""C: layouts against the platform's own (ctypes), values against Python, reachability against a search of all ways, and what must stay quiet."""

import ctypes
import json
import random

import pytest

from driftwake.operators import records
from driftwake.plans import check
from driftwake.rules import registry
from driftwake.sources import declarations, facts, files, flow

PLAIN = {
    "char": ctypes.c_char, "short": ctypes.c_short, "int": ctypes.c_int, "long": ctypes.c_long, "double": ctypes.c_double, "float": ctypes.c_float, "unsigned char": ctypes.c_ubyte,
    "long unsigned int": ctypes.c_ulong, "uint16_t": ctypes.c_uint16, "void *": ctypes.c_void_p,
}
BITS = {"unsigned int": ctypes.c_uint, "unsigned char": ctypes.c_ubyte, "unsigned short": ctypes.c_ushort, "unsigned long": ctypes.c_ulong}
C_RULES = ("struct-layout-change", "enum-values-shifted", "unhandled-new-member", "non-exhaustive-match", "unreachable-statement")


def made(rng: random.Random, n: int, bits: bool):
    """Texts of n records, some inside others, and ctypes classes of the same."""
    text, classes = "#define WIDE 3\ntypedef long word_t;\ntypedef word_t row_t[2];\n", {}
    for i in range(n):
        kind = rng.choice(["struct", "struct", "union"])
        rows, fields = [], []
        for j in range(rng.randrange(1, 7)):
            name, roll = f"f{j}", rng.random()
            if roll < 0.2 and classes:
                other = rng.choice(list(classes))
                rows.append(f"  {other} {name};")
                fields.append((name, classes[other]))
            elif roll < 0.4 and kind == "struct" and bits:
                said = rng.choice(list(BITS))
                width = rng.randrange(1, ctypes.sizeof(BITS[said]) * 8 + 1)
                rows.append(f"  {said} {name} : {width};")
                fields.append((name, BITS[said], width))
            elif roll < 0.5:
                rows.append(f"  row_t {name};")
                fields.append((name, ctypes.c_long * 2))
            elif roll < 0.6:
                rows.append(f"  int (*{name})(char, int), *p{name}[WIDE + 1];")
                fields += [(name, ctypes.c_void_p), (f"p{name}", ctypes.c_void_p * 4)]
            else:
                said = rng.choice(list(PLAIN))
                size = rng.randrange(3)
                rows.append(f"  {said} {name}{f'[{size}]' if size else ''};")
                fields.append((name, PLAIN[said] * size if size else PLAIN[said]))
        text += f"{kind} r{i} {{\n" + "\n".join(rows) + "\n};\n"
        classes[f"{kind} r{i}"] = type(f"r{i}", (ctypes.Structure if kind == "struct" else ctypes.Union,), {"_fields_": fields})
    return text, classes


def layouts(spark, texts: dict[str, str]):
    known = facts.facts(files.in_memory(spark, {"v": texts}))
    values = records.constants(facts.table(known, "constant").select("snapshot", "owner", "name", "expr", "plus").distinct(), ["snapshot"])
    return values, {r["name"]: r for r in records.sized(facts.table(known, "record"), facts.table(known, "alias"), values, ["snapshot"]).collect()}


def test_layouts_are_the_platforms(spark):
    want, texts = {}, {}
    for seed in range(12):
        text, classes = made(random.Random(seed), 8, bits=False)
        texts[f"h{seed}.h"] = text.replace(" r", f" s{seed}r")
        want |= {name.replace(" r", f" s{seed}r"): c for name, c in classes.items()}
    got = layouts(spark, {k: v.replace(f"s{k[1:-2]}row_t", "row_t") for k, v in texts.items()})[1]
    for name, c in want.items():
        assert got[name]["size"] == ctypes.sizeof(c), name
        for f, (field, _) in zip(got[name]["fields"], c._fields_):
            assert (f["field"], f["offset"], f["size"]) == (field, getattr(c, field).offset * 8, getattr(c, field).size * 8), (name, f)


def placed(kind: str, fields) -> tuple[int, list[tuple[int, int]]]:
    """Of a record of plain types, by search: each field takes the first bit where it may stand. A bit field may stand where it lies in
    one unit of its type (units begin at multiples of their size); all else at multiples of its alignment."""
    at, most, align, out = 0, 0, 1, []
    for f in fields:
        unit, bits = ctypes.alignment(f[1]) * 8, f[2] if len(f) > 2 else ctypes.sizeof(f[1]) * 8
        p = 0 if kind == "union" else at
        while p % unit + bits > unit if len(f) > 2 else p % unit:
            p += 1
        out.append((p, bits))
        at, most, align = p + bits, max(most, p + bits), max(align, unit // 8)
    return -(-most // (8 * align)) * align, out


def test_bit_fields(spark):
    texts, want = {}, {}
    for seed in range(100, 130):
        text, classes = made(random.Random(seed), 1, bits=True)
        texts[f"h{seed}.h"] = text.replace(" r0", f" s{seed}")
        (name, c), = classes.items()
        want[name.replace(" r0", f" s{seed}")] = placed(name.split()[0], c._fields_)
    got = layouts(spark, texts)[1]
    for name, (size, fields) in want.items():
        assert (got[name]["size"], [(f["offset"], f["size"]) for f in got[name]["fields"]]) == (size, fields), name
    known = "struct k { unsigned a : 3; unsigned b : 30; unsigned char c; unsigned : 0; unsigned d : 1; };"
    one = layouts(spark, {"k.h": known})[1]["struct k"]
    assert [f["offset"] for f in one["fields"]] == [0, 32, 64, 96, 96] and one["size"] == 16


def test_what_is_not_known_has_no_layout(spark):
    text = "struct a { struct nowhere x; int y; };\nstruct b { struct b *next; struct a in; };\nstruct c { int v[OTHER]; };\nstruct d { struct d inner; };\nstruct e { int n; char tail[]; };\nstruct f { };\nstruct g { struct f x; enum q { Q } y; union { char c; long l; }; };\n"
    values, got = layouts(spark, {"x.h": text})
    assert [got[f"struct {n}"]["size"] for n in "abcdefg"] == [None, None, None, None, 4, 0, 16]
    assert [f["field"] for f in got["struct a"]["fields"]] == ["x", "y"] and got["struct g"]["fields"][2]["offset"] == 64
    assert layouts(spark, {"x.h": ""})[1] == {}


def test_values(spark):
    text = "#define A 4\n#define B (A << 2)\n#define LOOP LOOP2\n#define LOOP2 LOOP\n#define F(x) x\n#define CH 'a'\nenum e { P, Q = B | 1, R, S = -Q, T = 0x10UL, U = 017, V = LOOP, W, X = CH + 1, Y = 7 / -2, Z = sizeof(int) };\n"
    got = {r["name"]: r["value"] for r in layouts(spark, {"x.h": text})[0].collect()}
    assert {k: got[k] for k in "PQRSTUX"} | {"Y": got["Y"]} == {"P": 0, "Q": 17, "R": 18, "S": -17, "T": 16, "U": 15, "X": 98, "Y": -3}
    assert all(got.get(k) is None for k in ("V", "W", "Z", "LOOP"))


def test_odd_declarations():
    named = lambda t: [(f, json.loads(d)["name"]) for f, d in declarations.read(t)]
    assert named("struct s { int a; } x, *y; static int f(struct s *p) { struct t { int q; }; return 1; }\nint z = sizeof(struct s);") == [("record", "struct s")]
    assert named("typedef enum { A, B, } e_t;\ntypedef struct { struct { int k; } in; } o_t;") == [("constant", "A"), ("constant", "B"), ("alias", "e_t"), ("record", "struct o_t.in"), ("record", "struct o_t"), ("alias", "o_t")]
    assert named("/* struct no { int a; }; */ __attribute__((packed)) struct yes { int a; } ;") == [("record", "struct yes")]
    for broken in ("struct {", "struct s { int", "}}}}", "enum e { A = (", "typedef", "int (*(*f)(", "struct s { : 3; };"):
        declarations.read(broken)


class Maker:
    """Random bodies, a statement a line, and beside them which lines can follow which: built together, apart from the reader."""

    def __init__(self, seed: int):
        self.rng, self.rows, self.next, self.labels, self.gotos = random.Random(seed), [], {}, {}, []

    def line(self, text: str) -> int:
        self.rows.append(text)
        self.next[len(self.rows)] = set()
        return len(self.rows)

    def follow(self, ways: set[int], to: int) -> None:
        for w in ways:
            self.next[w].add(to)

    def block(self, ways: set[int], depth: int, breaks: list | None, again: int | None) -> set[int]:
        for _ in range(self.rng.randrange(1, 5)):
            ways = self.one(ways, depth, breaks, again)
        return ways

    def one(self, ways, depth, breaks, again):
        roll = self.rng.random()
        if roll < 0.25 and depth:
            at = self.line("if (x)")
            self.follow(ways, at)
            self.line("{")
            then = self.block({at}, depth - 1, breaks, again)
            self.line("}")
            if self.rng.random() < 0.5:
                self.line("else {")
                other = self.block({at}, depth - 1, breaks, again)
                self.line("}")
                return then | other
            return then | {at}
        if roll < 0.35 and depth:
            at = self.line("while (x) {")
            self.follow(ways, at)
            out: list[int] = []
            end = self.block({at}, depth - 1, out, at)
            self.follow(end, at)
            self.line("}")
            return {at} | set(out)
        if roll < 0.5 and depth:
            at = self.line("switch (x) {")
            self.follow(ways, at)
            out, now, default = [], set(), self.rng.random() < 0.5
            for i in range(self.rng.randrange(1, 4)):
                self.line("default:" if default and i == 0 else f"case {i}:")
                now = self.block(now | {at}, depth - 1, out, again)
            self.line("}")
            return now | set(out) | {at}  # a switch may always be left
        if roll < 0.6:
            name = f"l{len(self.labels)}"
            at = self.line(f"{name}:")
            self.labels[name] = at
            self.follow(ways, at)
            return {at}
        if roll < 0.72:
            at = self.line(f"goto l{self.rng.randrange(4)};")
            self.follow(ways, at)
            self.gotos.append((at, self.rows[-1][5:-1]))
            return set()
        kind = self.rng.choice(["return 1;", "a();", "a();", "break;" if breaks is not None else "a();", "continue;" if again else "a();"])
        at = self.line(kind)
        self.follow(ways, at)
        if kind == "break;":
            breaks.append(at)
        elif kind == "continue;":
            self.next[at].add(again)
        return {at} if kind == "a();" else set()

    def reached(self, start: int) -> set[int]:
        for at, name in self.gotos:
            if name in self.labels:
                self.next[at].add(self.labels[name])
        seen, todo = set(), [start]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += self.next.get(n, ())
        return seen


def test_reachability_is_that_of_all_ways():
    dead = 0
    for seed in range(400):
        m = Maker(seed)
        m.line("a();")
        m.block({1}, 3, None, None)
        want = m.reached(1)
        body = flow.Body("\n".join(m.rows), 1)
        reach = flow.Reach(body.items())
        plain = {i for i, r in enumerate(m.rows, 1) if r[0] in "abcgrwsi" and not r.startswith("case")}
        assert {x for x in reach.alive if x in plain} == want & plain, "\n".join(m.rows)
        for items, i in reach.found:
            assert items[i].line not in want
            dead += 1
    assert dead > 50


@pytest.mark.parametrize("body, line", [
    ("if (x)\n goto out;\n goto out;\n y = 1;\nout:\n return 1;", 4), ("return 1;\nbreak;", None), ("while (1) { a(); }\nreturn 0;", None), ("if (a) return 1; else return 2;\nb();", 2),
    ("abort(); return 1;", None), ("abort();\na();", 2), ("return 0;\n#else\na();", None), ("return 0;\n/* NOTREACHED */\na();", None), ("return 0;\nassert(0);", None), ("return 1;\nback: c(); goto back;", None),
    ("switch (x) {\ncase 1: return 1;\ndefault: return 2;\n}\ny();", None), ("for (;;) {\n continue;\n q();\n}", 3), ("switch (x) {\ncase 1: return 1;\n}\ny();", None), ("return 1;\nif (x) { in: y(); }", None), ("return 1 }", None), ("", None),
])
def test_unreachable(body, line):
    code = "\n".join("" if r.startswith("#") else r for r in body.replace("/* NOTREACHED */", " " * 16).split("\n"))
    found = [json.loads(d)["line"] for _, d in flow.unreachable("c@f", code, body, 1)]
    assert found == ([line] if line else [])


HEADER = "struct s {\n  int a;\n  char b;\n};\nenum k { ONE, TWO };\n"
CODE = '#include "h.h"\nint f(enum k x) {\n  switch (x) {\n  case ONE: return 1;\n  case TWO: return 2;\n  }\n  return 0;\n}\n'
CHECKS = [
    ({"h.h": HEADER}, {"h.h": HEADER.replace("char b", "char b, c")}, [("struct-layout-change", "h.h", 1)]),
    ({"h.h": HEADER}, {"h.h": HEADER.replace("int a", "short a")}, [("struct-layout-change", "h.h", 1)]),
    ({"h.h": HEADER}, {"h.h": "\n\n/* moved */\n" + HEADER}, []),
    ({"m.c": HEADER}, {"m.c": HEADER.replace("int a", "short a").replace("ONE", "ZERO, ONE")}, []),
    ({"h.h": HEADER, "m.c": CODE}, {"h.h": HEADER.replace("TWO", "TWO, THREE"), "m.c": CODE}, [("unhandled-new-member", "m.c", 3)]),
    ({"h.h": HEADER, "m.c": CODE}, {"h.h": HEADER.replace("TWO", "NEW, TWO"), "m.c": CODE.replace("case ONE", "case NEW: case ONE")}, [("enum-values-shifted", "h.h", 5)]),
    ({"h.h": HEADER, "m.c": CODE}, {"h.h": HEADER, "m.c": CODE.replace("  case TWO: return 2;\n", "")}, [("non-exhaustive-match", "m.c", 3)]),
    ({"h.h": HEADER, "m.c": CODE}, {"h.h": HEADER, "m.c": CODE.replace("  case TWO: return 2;\n", "  default: return 2;\n")}, []),
    ({"h.h": HEADER, "m.c": CODE.replace("  case TWO: return 2;\n", "")}, {"h.h": HEADER, "m.c": CODE.replace("  case TWO: return 2;\n", "").replace("  switch", "  x++;\n  switch")}, []),
    ({"h.h": HEADER, "m.c": CODE}, {"h.h": HEADER, "m.c": CODE.replace("return 0;", "return 0;\n  f(ONE);")}, [("unreachable-statement", "m.c", 8)]),
    ({"h.h": "typedef int id;\n" + HEADER.replace("int a", "id a")}, {"h.h": "typedef long id;\n" + HEADER.replace("int a", "id a")}, [("struct-layout-change", "h.h", 2)]),
]


def test_checks_of_texts(spark):
    """All cases in one plan of checks."""
    texts = {}
    for i, (b, a, _) in enumerate(CHECKS):
        texts |= {f"b{i}": b, f"a{i}": a}
    pairs = spark.createDataFrame([(str(i), f"b{i}", f"a{i}") for i in range(len(CHECKS))], "pair string, before string, after string")
    report = check.checks(files.in_memory(spark, texts), pairs, rules={r: registry.RULES[r] for r in C_RULES})
    assert report.errors.collect() == []
    got = sorted((int(r["pair"]), r["rule"], r["path"], r["line"]) for r in report.findings.collect())
    assert got == sorted((i, *hit) for i, (_, _, hits) in enumerate(CHECKS) for hit in hits)


def test_a_record_of_many_fields_is_laid_out_in_one_pass():
    import time

    from driftwake.operators import records

    def seconds(n: int) -> float:
        fields = [(4, 4, 1, None), (1, 1, 1, None), (4, 4, 1, 3)] * n
        t = time.process_time()
        starts, _, most, align = records.offsets("struct", fields)
        assert len(starts) == 3 * n and starts[:3] == [0, 32, 40] and most == 64 * n - 21 and align == 4
        return time.process_time() - t

    assert seconds(100_000) < 60


def test_layouts_from_a_table_read_each_text_once(spark):
    from driftwake.plans import language_tables

    found = language_tables.c_layout(spark, lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    assert "MapInArrow" not in found._jdf.queryExecution().toString()  # what was read is kept

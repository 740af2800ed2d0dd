"""COBOL: records against a plain walk over levels, and what checks of texts say and must not say."""

import json
import random

from driftwake.operators import copybooks
from driftwake.plans import check
from driftwake.rules import registry
from driftwake.sources import cobol, facts, files

RULES = ("copybook-layout-changed", "move-truncates", "call-using-mismatch", "perform-thru-range-changed", "fall-through-changed", "legacy-construct-introduced")


def row(text: str) -> str:
    return " " * 7 + text


def program(name: str, data: list[str], procedure: list[str], using: str = "") -> str:
    out = ["IDENTIFICATION DIVISION.", f"PROGRAM-ID. {name}.", "DATA DIVISION.", "WORKING-STORAGE SECTION.", *data, f"PROCEDURE DIVISION{using}."]
    return "\n".join(row(x) for x in [*out, *procedure]) + "\n"


def book(*rows: str) -> str:
    return "\n".join(row(r) for r in rows) + "\n"


def records(spark, texts: dict[str, str]):
    known = facts.facts(files.in_memory(spark, {"v": texts}))
    from pyspark.sql import functions as F

    books = spark.createDataFrame([("v", p.split(".")[0].upper(), p) for p in texts], "snapshot string, book string, path string")
    opened = copybooks.opened(facts.table(known, "item"), facts.table(known, "copy"), books, ["snapshot"])
    return {(r["path"], r["field"]): r for r in copybooks.laid_out(opened, ["snapshot"]).orderBy(F.lit(1)).collect()}


def walked(rows):
    """rows (level, name, bytes or None, occurs, redefines): (size, offset) of each, by recursion over the tree."""
    def parse(i):
        level, name, size, occurs, over = rows[i]
        kids, j = [], i + 1
        while j < len(rows) and rows[j][0] > level:
            kid, j = parse(j)
            kids.append(kid)
        return {"name": name, "own": size, "occurs": occurs, "over": over, "kids": kids}, j

    out = {}

    def place(n, at, path):
        path = f"{path}.{n['name']}" if path else n["name"]
        pos, last = at, at
        for k in n["kids"]:
            begin = last if k["over"] else pos
            size = place(k, begin, path)
            if not k["over"]:
                last, pos = pos, pos + size * k["occurs"]
        size = n["own"] if n["own"] is not None else pos - at
        out[path] = (size, at)
        return size

    i = 0
    while i < len(rows):
        n, i = parse(i)
        place(n, 0, "")
    return out


def some(seed: int):
    rng = random.Random(seed)
    rows, said = [], []

    def items(level: int, n: int, depth: int):
        before = None
        for _ in range(n):
            name = f"F{len(rows)}"
            occurs = rng.choice([1, 1, 1, 3])
            over = before if before and rng.random() < 0.2 else None
            clause = (f" REDEFINES {over}" if over else "") + (f" OCCURS {occurs} TIMES" if occurs > 1 and level > 1 else "")
            occurs = occurs if level > 1 else 1
            if depth and rng.random() < 0.45:
                rows.append((level, name, None, occurs, over))
                said.append(f"{level:02d} {name}{clause}.")
                items(level + rng.choice([1, 4, 5]), rng.randrange(1, 4), depth - 1)
            else:
                k = rng.randrange(1, 9)
                pic, size = rng.choice([(f"X({k})", k), (f"9({k})V99", k + 2), (f"S9({k}) COMP-3", k // 2 + 1), (f"S9({k}) COMP", 2 if k <= 4 else 4), ("-ZZ9.99", 7), (f"S9({k}) SIGN LEADING SEPARATE", k + 1)])
                rows.append((level, name, size, occurs, over))
                said.append(f"{level:02d} {name}{clause} PIC {pic}.")
            before = before if over else name if level > 1 else None
    for _ in range(3):
        items(1, 1, 3)
    return rows, said


def test_records_by_a_plain_walk(spark):
    texts, want = {}, {}
    for seed in range(25):
        rows, said = some(seed)
        texts[f"b{seed}.cpy"] = book(*said)
        want |= {(f"b{seed}.cpy", f): v for f, v in walked(rows).items()}
    got = records(spark, texts)
    assert {k: (r["size"], r["offset"]) for k, r in got.items()} == want


def test_copies_within_copies_with_replacing(spark):
    texts = {
        "outer.cpy": book("01 :T:-REC.", "   05 :T:-HEAD PIC X(4).", "   COPY INNER REPLACING ==:T:== BY ==:T:-IN==.", "   05 TAIL PIC 9(3)."),
        "inner.cpy": book("   05 :T:-A PIC X(2).", "   05 NAME PIC X(6).", "   COPY OUTER."),  # in a circle: not opened again
        "p.cbl": program("P", ["COPY OUTER REPLACING ==:T:== BY ==CUST== TAIL BY REST.", "01 Z PIC X.", "COPY NOWHERE."], ["MAIN.", "    GOBACK."]),
    }
    got = {f: (r["size"], r["offset"]) for (p, f), r in records(spark, texts).items() if p == "p.cbl"}
    assert got == {"CUST-REC": (15, 0), "CUST-REC.CUST-HEAD": (4, 0), "CUST-REC.CUST-IN-A": (2, 4), "CUST-REC.NAME": (6, 6), "CUST-REC.REST": (3, 12), "Z": (1, 0)}
    assert records(spark, {"x.cpy": ""}) == {}


def test_pictures():
    assert [cobol.picture(p) for p in ("9(5)", "S9(3)V9(2)", "X(10)", "-Z,ZZZ,ZZ9.99", "--,--9", "A(3)9", "9P(2)", "ZZ9.9CR")] == [
        (5, "digits", 5, 0), (5, "digits", 3, 2), (10, "text", 10, 0), (13, "digits", 7, 2), (6, "digits", 4, 0), (4, "text", 4, 0), (1, "digits", 3, 0), (7, "digits", 3, 1)]


def test_paragraphs_of_a_text():
    text = program("P", ["01 A PIC X VALUE 'X. 01 B PIC 9.'."], ["FIRST-ONE.", "    IF A = 'X' GO TO LAST-ONE.", "    PERFORM B-ONE THRU C-ONE.", "B-ONE.", "    IF A = 'Y' MOVE A TO D ELSE GO TO LAST-ONE END-IF", "    GO TO LAST-ONE.", "C-ONE. EXIT.", "LAST-ONE.", "    STOP RUN."])
    found = [(f, json.loads(d)) for f, d in cobol.read(text)]
    p = {d["name"]: d for f, d in found if f == "paragraph"}
    assert [(n, d["leaves"], d["empty"], d["tags"]) for n, d in p.items()] == [("FIRST-ONE", False, False, ["GO TO"]), ("B-ONE", True, False, ["GO TO"]), ("C-ONE", False, True, []), ("LAST-ONE", True, False, [])]
    assert [(d["first"], d["last"]) for f, d in found if f == "performs"] == [("B-ONE", "C-ONE")]
    assert [d["name"] for f, d in found if f == "item"] == ["A"] and [(d["src"], d["dst"]) for f, d in found if f == "move"] == [("A", "D")]
    for odd in ("", "\n", "       PROGRAM-ID", row("PROGRAM-ID. X."), row("01 A PIC X(9"), "x" * 5000, row("PROGRAM-ID. X. PROCEDURE DIVISION. MOVE A TO.")):
        cobol.read(odd)


CPY = book("01 CUSTOMER.", "   05 CUST-ID PIC 9(6).", "   05 FILLER PIC X(4).", "   05 CUST-NAME PIC X(30).")
USER = program("BILLING", ["COPY CUSTREC.", "01 SHORT-ID PIC 9(6).", "01 SHORT-NAME PIC X(10)."], ["MAIN.", "    MOVE CUST-ID TO SHORT-ID", "    MOVE CUST-NAME TO SHORT-NAME.", "    STOP RUN."])
ORDER = ["A-ONE.", "    DISPLAY 'A'.", "B-ONE.", "    DISPLAY 'B'.", "C-ONE.", "    DISPLAY 'C'.", "D-ONE.", "    GOBACK."]
RANGED = ["MAIN.", "    PERFORM A-ONE THRU C-ONE.", "    GOBACK.", *ORDER]
CALLER = program("CALLER", ["01 ARG PIC X(8).", "01 TWO PIC X(2)."], ["MAIN.", "    CALL 'CALLEE' USING ARG.", "    GOBACK."])
CALLEE = program("CALLEE", ["LINKAGE SECTION.", "01 PARM.", "   05 P1 PIC X(8)."], ["MAIN.", "    GOBACK."], " USING PARM")


def inserted(rows, at: str, *new: str):
    i = rows.index(at)
    return [*rows[:i], *new, *rows[i:]]


def p(rows):
    return {"p.cbl": program("P", ["01 A PIC X."], rows)}


CHECKS = [
    ({"custrec.cpy": CPY, "b.cbl": USER}, {"custrec.cpy": CPY.replace("9(6)", "9(8)"), "b.cbl": USER}, [("copybook-layout-changed", "custrec.cpy", 1), ("move-truncates", "b.cbl", 10)]),
    ({"custrec.cpy": CPY, "b.cbl": USER}, {"custrec.cpy": CPY.replace("CUST-NAME", "CUST-LABEL"), "b.cbl": USER}, []),
    ({"custrec.cpy": CPY, "b.cbl": USER}, {"custrec.cpy": CPY.replace("FILLER PIC X(4)", "CUST-KIND PIC X(4)"), "b.cbl": USER}, []),
    ({"custrec.cpy": CPY}, {"custrec.cpy": CPY.replace("9(6)", "9(8)")}, []),
    ({"custrec.cpy": CPY, "mid.cpy": book("COPY CUSTREC."), "b.cbl": USER.replace("COPY CUSTREC", "COPY MID")}, {"custrec.cpy": CPY.replace("X(30)", "X(40)"), "mid.cpy": book("COPY CUSTREC."), "b.cbl": USER.replace("COPY CUSTREC", "COPY MID")}, [("copybook-layout-changed", "custrec.cpy", 1)]),
    ({"custrec.cpy": CPY, "b.cbl": USER}, {"custrec.cpy": CPY, "b.cbl": USER.replace("01 SHORT-ID PIC 9(6)", "01 SHORT-ID PIC 9(4)")}, [("move-truncates", "b.cbl", 10)]),
    ({"custrec.cpy": CPY, "b.cbl": USER.replace("MOVE CUST-ID TO SHORT-ID", "CONTINUE")}, {"custrec.cpy": CPY, "b.cbl": USER.replace("01 SHORT-ID PIC 9(6)", "01 SHORT-ID PIC 9(4)")}, []),
    (p(RANGED), p(inserted(RANGED, "C-ONE.", "NEW-ONE.", "    DISPLAY 'N'.")), [("perform-thru-range-changed", "p.cbl", 8)]),
    (p(RANGED), p(inserted(RANGED, "C-ONE.", "NEW-ONE.", "    EXIT.")), []),
    (p(RANGED), p([r for r in RANGED if r not in ("B-ONE.", "    DISPLAY 'B'.")]), [("perform-thru-range-changed", "p.cbl", 8)]),
    (p(ORDER), p(inserted(ORDER, "B-ONE.", "NEW-ONE.", "    DISPLAY 'N'.")), [("fall-through-changed", "p.cbl", 8)]),
    (p(ORDER), p(inserted(ORDER, "B-ONE.", "NEW-ONE.", "    CONTINUE.")), []),
    (p(ORDER), p([r.replace("B-ONE", "BB-ONE") for r in ORDER]), []),
    (p(inserted(ORDER, "B-ONE.", "    GOBACK.")), p(ORDER), [("fall-through-changed", "p.cbl", 8), ("fall-through-changed", "p.cbl", 10), ("fall-through-changed", "p.cbl", 12)]),  # all that is reached now
    (p(RANGED), p(inserted(RANGED, "    GOBACK.", "    IF A = 'X' GO TO D-ONE.")), [("legacy-construct-introduced", "p.cbl", 7)]),
    (p(RANGED), p([*inserted(RANGED, "    GOBACK.", "    IF A = 'X' GO TO E-EXIT."), "E-EXIT.", "    EXIT."]), []),
    ({"a.cbl": CALLER, "c.cbl": CALLEE}, {"a.cbl": CALLER.replace("USING ARG", "USING ARG TWO"), "c.cbl": CALLEE}, [("call-using-mismatch", "a.cbl", 9)]),
    ({"a.cbl": CALLER, "c.cbl": CALLEE}, {"a.cbl": CALLER, "c.cbl": CALLEE.replace("P1 PIC X(8)", "P1 PIC X(9)")}, [("call-using-mismatch", "a.cbl", 9)]),
    ({"a.cbl": CALLER, "c.cbl": CALLEE}, {"a.cbl": CALLER.replace("USING ARG", "USING BY CONTENT TWO"), "c.cbl": CALLEE}, []),
    ({"a.cbl": CALLER.replace("ARG.\n", "TWO.\n"), "c.cbl": CALLEE}, {"a.cbl": CALLER.replace("ARG.\n", "TWO.\n").replace("GOBACK", "STOP RUN"), "c.cbl": CALLEE}, []),
]


def test_checks_of_texts(spark):
    texts = {}
    for i, (b, a, _) in enumerate(CHECKS):
        texts |= {f"b{i}": b, f"a{i}": a}
    pairs = spark.createDataFrame([(str(i), f"b{i}", f"a{i}") for i in range(len(CHECKS))], "pair string, before string, after string")
    report = check.checks(files.in_memory(spark, texts), pairs, rules={r: registry.RULES[r] for r in RULES})
    assert report.errors.collect() == []
    got = sorted((int(r["pair"]), r["rule"], r["path"], r["line"]) for r in report.findings.collect())
    assert got == sorted((i, *hit) for i, (_, _, hits) in enumerate(CHECKS) for hit in hits)


def test_work_on_a_record_grows_with_its_items():
    """A record of 200,000 items, which nested passes over all pairs would not end."""
    groups = [row for i in range(50_000) for row in ((5, f"G{i}", None, 2, None), (10, "A", 3, 1, None), (10, "B", 9, 1, "A"), (10, "C", 1, 4, None))]
    told = list(copybooks.record([(1, "R", None, 1, None), *groups]))
    assert told[0] == ("R", "R", 0, 50_000 * 14)
    assert told[-4:] == [("R", "R.G49999", 49_999 * 14, 7), ("R", "R.G49999.A", 49_999 * 14, 3), ("R", "R.G49999.B", 49_999 * 14, 9), ("R", "R.G49999.C", 49_999 * 14 + 3, 1)]
    lines = cobol.Text("\n".join(f"       01 A{i} PIC X." for i in range(200)))
    assert [json.loads(d)["line"] for _, d in lines.read()] == list(range(1, 201))

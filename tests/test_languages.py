import pytest

from driftwake.plans import check
from driftwake.sources import facts, files

C = "int limit(int a, int b) {\n    return a < b ? a : b;\n}\n\nint use(int x) {\n    /* limit(1) */\n    if (x) {\n        return limit(x, 3);\n    }\n    return 0;\n}\n"
JAVA = "package a;\nclass Pay {\n    int charge(int amount) {\n        return amount;\n    }\n    int twice(int x) {\n        return charge(x) + this.charge(x);\n    }\n}\nclass Shop {\n    Pay pay;\n    int total(int x) {\n        return pay.charge(x);\n    }\n}\n"
FORTRAN = "subroutine scale(a, b)\n  real a, b\n  a = a * b\nend subroutine\n\nsubroutine top(x)\n  real x\n  call scale(x, &\n    2.0)  ! scale(x)\nend subroutine\n"
COBOL = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. RATES.\n       PROCEDURE DIVISION USING AMT PCT.\n       MAIN-PARA.\n           PERFORM WORK-PARA.\n           GOBACK.\n       WORK-PARA.\n           COMPUTE AMT = AMT * PCT.\n       IDENTIFICATION DIVISION.\n       PROGRAM-ID. BILL.\n       PROCEDURE DIVISION.\n       START-PARA.\n           CALL 'RATES' USING TOTAL PCT.\n           STOP RUN.\n"
JS = "export function join(a, b = 1) {\n  return a + b;\n}\nfunction all(xs) {\n  return join(xs[0], 'x(1,2)');\n}\n"

CHANGES = [
    ("m.c", C, C.replace("(int a, int b)", "(int a, int b, int c)"), 8), ("m.cpp", C, C.replace("(int a, int b)", "(int a)"), 8), ("m.java", JAVA, JAVA.replace("charge(int amount)", "charge(int amount, String currency)"), 7),
    ("m.f90", FORTRAN, FORTRAN.replace("scale(a, b)", "scale(a, b, c)"), 8), ("m.cbl", COBOL, COBOL.replace("USING AMT PCT", "USING AMT PCT DAYS"), 13), ("m.ts", JS, JS.replace("(a, b = 1)", "(a)"), 5),
]


@pytest.fixture(scope="module")
def report(spark):
    pairs = spark.createDataFrame([(p, f"{p}/old", f"{p}/new") for p, *_ in CHANGES], "pair string, before string, after string")
    return check.checks(files.in_memory(spark, {f"{p}/{s}": {p: t} for p, old, new, _ in CHANGES for s, t in (("old", old), ("new", new))}), pairs)


def test_a_changed_signature_breaks_its_calls_in_each_language(report):
    got = {(r.pair, r.path, r.line) for r in report.findings.filter("rule = 'signature-break'").collect()}
    assert {(p, p, line) for p, _, _, line in CHANGES} <= got
    assert all(r.verdict == "block" for r in report.verdict.collect())


def test_definitions_and_calls(spark):
    told = facts.facts(files.in_memory(spark, {"x": {p: t for p, t, *_ in CHANGES}}))
    defs = {r.name: (r.line, r.end_line) for r in facts.table(told, "def").collect()}
    assert defs["c@use"] == (5, 11) and defs["java@Pay.twice"] == (6, 8) and defs["java@Shop"] == (10, 15) and defs["fortran@top"] == (6, 10) and defs["cobol@RATES.WORK-PARA"][0] == 7 and defs["typescript@join"] == (1, 3)
    uses = {(r.src, tuple(r.candidates), r.positional) for r in facts.table(told, "use").collect()}
    assert {("c@use", ("c@limit",), 2), ("fortran@top", ("fortran@scale",), 2), ("cobol@BILL.START-PARA", ("cobol@RATES",), 2), ("cobol@RATES.MAIN-PARA", ("cobol@RATES.WORK-PARA",), 0), ("typescript@all", ("typescript@join",), 2), ("java@Pay.twice", ("java@Pay.charge", "java@charge"), 1)} <= uses
    assert not any("if" in c for _, cs, _ in uses for c in cs)


def test_facts_are_read_once(spark, tmp_path, monkeypatch):
    one = {"a.py": "def f():\n    return 1\n", "b.c": C, "empty.py": ""}
    first = facts.kept(files.in_memory(spark, {"x": one}), str(tmp_path / "facts"))
    n = first.count()
    assert n == facts.facts(files.in_memory(spark, {"x": one})).count()
    again = facts.kept(files.in_memory(spark, {"y": one | {"a.py": "def g():\n    return 1\n"}}), str(tmp_path / "facts"))
    assert again.count() == n and spark.read.parquet(str(tmp_path / "facts")).filter("path = 'b.c' AND fact = 'none'").count() == 1

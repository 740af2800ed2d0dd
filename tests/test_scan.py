"""Patterns over whole texts, and values that reach a sink by several ways."""

import re

import pytest

from driftwake.plans import check
from driftwake.rules import registry
from driftwake.sources import files, lines
from driftwake.values import HIDDEN_CALLS, LEGACY

TEXTS = {
    "a.cbl": "       GO TO A B\n       C DEPENDING ON X.\n", "b.py": "m = import_module(\n    'x')\nm = import_module(\n    name)\n",
    "c.c": "int add(a, b)\nint a;\n  char *b;\n{\n  return a;\n}\nint plain(int a)\n{\n  return a;\n}\n", "d.c": "/* gets(x) */ s = \"gets(y)\";\ngets\n (z); gets(w);\n", "e.txt": "gets(x)", "f.c": "",
}


def test_over_lines(spark):
    frame = files.in_memory(spark, {"v": TEXTS})
    assert sorted((r["path"], r["line"], r["rule"]) for r in lines.scan(frame).collect()) == [("a.cbl", 1, "cobol-go-to-depending"), ("c.c", 1, "c-kr-definition"), ("d.c", 2, "c-gets"), ("d.c", 3, "c-gets")]
    assert sorted((r["path"], r["line"], r["rule"]) for r in lines.hidden_calls(frame).collect()) == [("b.py", 3, "py-import-by-name")]


@pytest.mark.parametrize("pattern, want", [("abc", ["abc"]), (r"\bgets\s*\(", ["gets"]), ("(ab|cde)x+", ["ab", "cde"]), ("(ab|.)c", ["c"]), ("(?:abc)?d", ["d"]), (r"\w+", []), ("(?:foo){2}", ["foo"]), ("a|", [])])
def test_needed(pattern, want):
    assert lines.needed(pattern) == want


def test_what_a_pattern_needs_stands_in_what_it_matches():
    """Every text that a pattern of the tables matches holds one of its literals."""
    said = "\n".join(TEXTS.values()) + "gets(x) strcpy (a) register int i; new Vector<A>() x.stop(); Class.forName(n) arguments.callee\n PERFORM A THRU B. ALTER X TO Y. NEXT SENTENCE EXHIBIT\n common /a/ b\n entry x\neval(x) dlsym(h) a->b(c) require(n) t[k](1)\n"
    hits = 0
    for lang, _, _, pattern in (*LEGACY, *HIDDEN_CALLS):
        need = [n.lower() for n in lines.needed(pattern)]
        for m in re.finditer(pattern, said, re.M | (re.I if lang in ("fortran", "cobol") else 0)):
            assert not need or any(n in m[0].lower() for n in need)
            hits += 1
    assert hits > 20


WEB = "import os\nfrom flask import Flask, request\napp = Flask(__name__)\n"
WAYS = WEB + "\ndef run(c):\n    os.system(c)\n\ndef aa(a):\n    run(a)\n\ndef bb(b):\n    run(b)\n\ndef longer(x):\n    bb(x)\n\ndef free(c):\n    return c\n\n@app.route('/')\ndef h():\n    aa(request.args['d'])\n    longer(request.args['d'])\n"
EDITS = [(" run(a)", True), (" run(b)", True), (" bb(x)", True), (" return c", False), (" os.system(c)", True)]


def test_each_way_to_a_sink_is_seen(spark):
    texts = {"old": {"m.py": WAYS}} | {str(i): {"m.py": WAYS.replace(e, f"{e}\n    len('')")} for i, (e, _) in enumerate(EDITS)}
    pairs = spark.createDataFrame([(str(i), "old", str(i)) for i in range(len(EDITS))], "pair string, before string, after string")
    rule = "unvalidated-input-reaches-sink"
    report = check.checks(files.in_memory(spark, texts), pairs, rules={rule: registry.RULES[rule]})
    got = {r["pair"]: r for r in report.findings.collect()}
    assert [str(i) in got for i in range(len(EDITS))] == [hit for _, hit in EDITS]
    assert all(r["severity"] == "critical" for r in got.values()) and "m.longer() hands it to m.bb()" in got["1"]["message"] and "m.aa()" in got["0"]["message"]


def test_a_circle_of_calls_ends(spark):
    text = WEB + "\ndef a(x, n):\n    b(x, n)\n\ndef b(x, n):\n    a(x, n)\n    os.system(x)\n\n@app.route('/')\ndef h():\n    a(request.args['d'], 1)\n"
    rule = "unvalidated-input-reaches-sink"
    report = check.check(files.in_memory(spark, {"before": {}, "after": {"m.py": text}}), rules={rule: registry.RULES[rule]})
    assert [(r["line"], r["severity"]) for r in report.findings.collect()] == [(10, "critical")]


def test_each_sink_of_a_pair_is_told(spark):
    text = WEB + "".join(f"\n@app.route('/{i}')\ndef h{i}():\n    os.system(request.args['d'])\n" for i in range(45))
    rule = "unvalidated-input-reaches-sink"
    report = check.check(files.in_memory(spark, {"before": {}, "after": {"m.py": text}}), rules={rule: registry.RULES[rule]})
    assert sorted((r["line"], r["severity"]) for r in report.findings.collect()) == [(7 + 4 * i, "critical") for i in range(45)]


def test_lines_are_not_shuffled_to_few_names(spark, monkeypatch):
    f = spark.createDataFrame([("a.py", "run it\nrunning\nrun run"), ("a.py", "run that"), ("b.cbl", "       MOVE RUN-ALL TO X.")], "path string, text string")
    names = spark.createDataFrame([("run",), ("RUN-ALL",), ("run",)], "name string")
    few = lines.mentions(f, names)
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, few.collect()))
    assert got == [("RUN-ALL", "b.cbl", 1), ("run", "a.py", 1), ("run", "a.py", 3)]
    monkeypatch.setattr(lines, "FEW_NAMES", 0)
    assert sorted(map(tuple, lines.mentions(f, names).collect())) == got

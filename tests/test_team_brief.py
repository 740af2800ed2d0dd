import json

import pytest

from driftwake.plans import brief, check, team
from driftwake.sources import files, manifests
from tests.test_check import AFTER, BEFORE

BASE = {"pay.py": "def charge(amount):\n    return amount\n", "shop.py": "def total(x):\n    return x\n"}
ANN = BASE | {"pay.py": "def charge(amount, currency):\n    return amount, currency\n"}
BOB = BASE | {"shop.py": "from pay import charge\n\ndef total(x):\n    return charge(x)\n"}


def test_fine_alone_broken_together(spark):
    f = files.in_memory(spark, {"base": BASE, "ann": ANN, "bob": BOB})
    report, only = team.combination(f, "base", "ann", "bob")
    assert report.verdict.head().verdict == "block" and {(r.rule, r.path) for r in only.collect()} == {("signature-break", "shop.py")}
    assert all(check.check(f, "base", m).verdict.head().verdict == "ok" for m in ("ann", "bob"))
    assert team.both_edited(f, "base", "ann", "bob").collect() == []
    assert {(r.path, r.owner, r.overlap) for r in team.all_together(f, "base", ["ann", "bob"]).collect()} == {("pay.py", "ann", False), ("shop.py", "bob", False)}
    assert [(r.a, r.b) for r in team.pairs(spark.createDataFrame([("x",), ("y",), ("z",)], "name string")).orderBy("a", "b").collect()] == [("x", "y"), ("x", "z"), ("y", "z")]


@pytest.fixture(scope="module")
def report(spark):
    return check.check(files.in_memory(spark, {"before": BEFORE, "after": AFTER}))


def test_brief_and_outputs(spark, report):
    b = brief.brief(report)
    assert b["verdict"] == "block" and b["findings"][0]["severity"] == "critical" and b["affected"][0]["score"] == 0.85 and b["files_changed"] == ["app/main.py", "app/util.py"]
    assert "- [ ] **critical**" in brief.markdown(b) and json.loads(json.dumps(b)) == b
    log = json.loads(brief.sarif_log(report.findings))
    assert len(log["runs"][0]["results"]) == report.findings.count() and all(len(r["partialFingerprints"]["primary"]) == 12 for r in log["runs"][0]["results"])
    uses = {(r.name, r.kind, tuple(r.sites)) for r in brief.uses_of(report.edges, "app.util.parse").collect()}
    assert ("app.main.Job.run_all", "calls", ("app/main.py:8",)) in uses


def test_tests_to_run(spark):
    f = spark.createDataFrame([("tests/test_a.py", "parse(x) helper"), ("tests/test_b.py", "nothing"), ("app.py", "parse")], "path string, text string")
    got = brief.tests_to_run(f, spark.createDataFrame([("parse", 0), ("helper", 1)], "word string, tier int")).collect()
    assert [(r.path, r.tier, r.names) for r in got] == [("tests/test_a.py", 0, ["helper", "parse"])]


def test_vague_names_need_their_context(spark):
    defs = spark.createDataFrame([("pay.charge_all", "function", "pay.py"), ("pay.Job.run", "method", "pay.py"), ("pay.get", "function", "pay.py"), ("pay.Job.__init__", "method", "pay.py"), ("java@Pay.sum(int)", "method", "src/Pay.java")], "name string, kind string, path string")
    assert [(r.word, r.context) for r in brief.look_for(defs).collect()] == [("charge_all", ""), ("run", "Job"), ("get", "pay"), ("Job", ""), ("sum", "Pay")]
    f = spark.createDataFrame([("tests/test_a.py", "Job().run()"), ("tests/test_b.py", "run()")], "path string, text string")
    got = brief.tests_to_run(f, spark.createDataFrame([("run", 0, "Job")], "word string, tier int, context string")).collect()
    assert [r.path for r in got] == ["tests/test_a.py"]


def test_nearest_settings(spark):
    f = spark.createDataFrame([("pyproject.toml", "[tool.driftwake]\ndisable = 'a'\n"), ("x/pyproject.toml", "[project]\nname = 'x'\n"), ("x/y/pyproject.toml", "[tool.driftwake]\ndisable = 'b'\n")], "path string, text string")
    assert [manifests.nearest_settings(f, d)["disabled"] for d in ("x/y/z", "x", "")] == [("b",), ("a",), ("a",)]


def test_manifests_and_settings(spark):
    toml = '[project]\ndependencies = ["Requests>=2", "PyYAML"]\n[tool.driftwake]\ndisable = "bare-except"\n'
    code = {"a.py": "import requests\nimport yaml\nimport os\n"}
    f = files.in_memory(spark, {"before": code | {"pyproject.toml": toml}, "after": {"a.py": code["a.py"] + "import numpy\nimport a\n", "pyproject.toml": toml.replace('"Requests>=2", ', "")}})
    got = {(r.rule, r.message.split()[0]) for r in check.check(f).findings.collect()}
    assert got == {("dependency-undeclared", "numpy"), ("dependency-removed-still-used", "requests")}
    assert manifests.settings(toml) == {"disabled": ("bare-except",), "excluded": [], "fail_on": "block"}
    assert manifests.names_in("requirements.txt", "a==1 # x\n-r other.txt\n") == (["a==1"], False) and manifests.names_in("pyproject.toml", "broken [") == ([], False)
    assert manifests.names_in("setup.py", "setup(install_requires=['x', 'y>1'])") == (["x", "y>1"], True)
    with pytest.raises(ValueError):
        manifests.settings("[tool.driftwake]\ndisable = [1]\n")


def test_words_of_tests_meet_where_they_are_read(spark):
    f = spark.createDataFrame([("tests/test_a.py", "run Job run"), ("tests/test_a.py", "run"), ("tests/test_b.py", "Job"), ("tests/test_c.py", "run x Job")], "path string, text string")
    wanted = spark.createDataFrame([("run", 1, "Job"), ("x", 0, "")], "word string, tier int, context string")
    whole = brief.tests_to_run(f, wanted)
    assert "array_contains" not in whole._jdf.queryExecution().analyzed().toString()  # no row carries all the words of its file
    got = {(r.path, r.tier, tuple(r.names)) for r in whole.collect()}
    few, brief.FEW_WORDS = brief.FEW_WORDS, 0
    try:
        assert {(r.path, r.tier, tuple(r.names)) for r in brief.tests_to_run(f, wanted).collect()} == got == {("tests/test_a.py", 1, ("run",)), ("tests/test_c.py", 0, ("run", "x"))}
    finally:
        brief.FEW_WORDS = few

import subprocess

import pytest

from driftwake.plans import check
from driftwake.sources import facts, files

BEFORE = {
    "app/util.py": "LIMIT = 3\n\ndef parse(line):\n    return line.split()\n\ndef helper(x):\n    return parse(x)\n\ndef old_name(a, b):\n    total = a + b\n    return total * LIMIT\n",
    "app/main.py": "from app.util import parse, old_name\nfrom app import util\nimport os\n\nclass Job:\n    def run_all(self, text):\n        try:\n            return parse(text)\n        except Exception:\n            pass\n\n    def again(self):\n        return self.run_all('x')\n\ndef top():\n    return Job().again()\n\ndef env():\n    return os.environ.get('HOST', 'a')\n",
    "app/broken.py": "def (:\n",
}
AFTER = {
    "app/util.py": "LIMIT = 4\n\ndef parse(line, sep):\n    return line.split(sep)\n\ndef helper(x):\n    return parse(x, ',')\n\ndef new_name(a, b):\n    total = a + b\n    return total * LIMIT\n\ndef quiet(x=[]):\n    return undefined_thing\n",
    "app/main.py": BEFORE["app/main.py"].replace("'HOST', 'a'", "'PORT', 'a'"),
    "app/broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def report(spark):
    return check.check(files.in_memory(spark, {"before": BEFORE, "after": AFTER}))


def test_changes_and_renames(report):
    got = {(r.name, r.kind, r.old_name) for r in report.changes.collect()}
    assert got == {("app.util.LIMIT", "value", None), ("app.util.parse", "signature", None), ("app.util.helper", "body", None), ("app.util.new_name", "renamed", "app.util.old_name"), ("app.util.quiet", "added", None), ("app.main.env", "body", None)}


def test_edges(report):
    got = {(r.src, r.dst, r.kind, r.guess) for r in report.edges.collect()}
    assert {("app.main.Job.run_all", "app.util.parse", "calls", False), ("app.main.Job.again", "app.main.Job.run_all", "calls", False), ("app.util.new_name", "app.util.LIMIT", "reads", False), ("app.main.top", "app.main.Job.again", "calls", True)} <= got
    assert not any(r[0] == r[1] for r in got)


def test_affected_fades_and_leaves_out_the_change(report):
    got = {r.name: (r.hops, round(r.score, 4)) for r in report.affected.collect()}
    assert got["app.main.Job.run_all"] == (1, 0.855)
    assert got["app.main.Job.again"] == (2, round(0.855 * 0.9, 4))
    assert got["app.main.top"] == (3, round(0.855 * 0.9 * 0.9 * 0.5, 4))
    assert "app.util.helper" not in got


def test_findings_and_verdict(report):
    got = {(r.rule, r.path, r.line) for r in report.findings.collect()}
    assert ("signature-break", "app/main.py", 8) in got and ("removed-still-referenced", "app/main.py", 1) in got
    assert ("mutable-default-argument", "app/util.py", 13) in got and ("undefined-name", "app/util.py", 14) in got and ("env-var-renamed", "app/main.py", 19) in got
    assert not any(r == "swallowed-exception" for r, _, _ in got)  # it is in code that the change did not touch
    assert report.verdict.head().verdict == "block" and [r.path for r in report.errors.collect()] == ["app/broken.py"]


def test_quiet_on_formatting_and_line_endings(spark):
    after = {p: t.replace("\n", "\r\n").replace("(a, b)", "(a,  b)") for p, t in BEFORE.items()}
    r = check.check(files.in_memory(spark, {"before": BEFORE, "after": after}))
    assert r.changes.collect() == [] and r.findings.collect() == [] and r.verdict.head().verdict == "ok"


def test_marks_settings(spark):
    after = dict(AFTER)
    after["app/main.py"] = after["app/main.py"].replace("            return parse(text)", "            # driftwake: ignore[signature-break]\n            return parse(text)")
    r = check.check(files.in_memory(spark, {"before": BEFORE, "after": after}), disabled=("undefined-name",), excluded=["app/util.py"])
    got = {(x.rule, x.path) for x in r.findings.collect()}
    assert ("signature-break", "app/main.py") not in got and not any(p == "app/util.py" for _, p in got)
    assert [x.rule for x in r.suppressed.collect()] == ["signature-break"]


THREADS = "import threading\nclass C:\n    def go(self):\n        threading.Thread(target=self.a).start()\n        threading.Thread(target=self.b).start()\n    def a(self):\n        self.n += 1\n    def b(self):\n        return self.n\n"


FILE_CASES = [
        ("def f(x):\n    assert (x, 'no')\n", {"assert-on-tuple"}), ("def f(x):\n    assert (), x\n", set()),
        ("try:\n    pass\nexcept:\n    raise\n", {"bare-except"}), ("def f(x):\n    return x == None\n", {"compare-to-none"}), ("def f(x):\n    return None == x\n", set()),
        ("def f():\n    return 1\n    g = 2\n", {"unreachable-code"}), ("def f():\n    return\n    yield\n", set()),
        ("if False:\n    x = 1\n", {"constant-condition"}), ("while True:\n    break\n", set()), ("if 1:\n    x = 1\nelse:\n    x = 2\n", {"constant-condition"}),
        ("import contextlib\nwith contextlib.suppress(Exception):\n    x = 1\n", {"swallowed-exception"}), ("def f():\n    print(1)\n", {"debug-leftover"}), ("def show():\n    print(1)\n", set()),
        ("def f():\n    breakpoint()\n", {"debug-leftover"}), ("def f(a=dict()):\n    return a\n", {"mutable-default-argument"}), ("x = nope\n", {"undefined-name"}),
        ("def f(d):\n    return d.replace(year=d.year + 1)\n", {"leap-day-date"}), ("def f(d):\n    return d.replace(year=d.year + 4)\n", set()),
        ("from datetime import date\ndef f(d):\n    return date(d.year - 1, d.month, d.day)\n", {"leap-day-date"}), ("def f(d):\n    try:\n        return d.replace(year=d.year + 1)\n    except ValueError:\n        return d\n", set()),
        ("import re\nP = re.compile(r'(a+)+$')\n", {"regex-catastrophic-backtracking"}), ("import re\nP = re.compile(r'(a+)+')\n", set()), ("import re\nP = re.compile(r'(\\w+\\s?)*$')\n", {"regex-catastrophic-backtracking"}), ("import re\nP = re.compile(r'.*.*.*=.*')\n", {"regex-catastrophic-backtracking"}),
        ("import re\nP = re.compile(r'(\\w+,)+x')\n", set()), ("import re\nP = re.compile(r'[a-z]+\\d+[a-z]+$')\n", set()),
        (THREADS, {"unsynchronized-shared-state"}), (THREADS.replace("self.n += 1", "with self.lock:\n            self.n += 1").replace("return self.n", "with self.lock:\n            return self.n"), set()),
        ("def f(d, n=28):\n    try:\n        return d.replace(year=d.year + 1)\n    except KeyError:\n        return d\n", {"leap-day-date"}),
        ("def f(tank):\n    while tank.level < tank.full:\n        abs(tank.tag)\n", {"loop-without-progress"}), ("def f(tank):\n    while tank.level < tank.full:\n        tank.level += abs(tank.tag)\n", set()),
        ("def f(left: int, wide):\n    while left > 12:\n        if wide:\n            if left > 20:\n                left -= 20\n        else:\n            left -= 12\n", set()),
        ("def f(left: int):\n    boxes = 3\n    while left > 12:\n        if bool(boxes):\n            if left > 20:\n                left -= 20\n                boxes += 1\n        else:\n            left -= 12\n            boxes += 1\n", {"loop-without-progress"}),
        ("def f(items):\n    while items:\n        items.pop()\n", set()), ("def f(it):\n    while it:\n        yield it\n", set()), ("def f(n: int):\n    while n > 10:\n        if n < 5:\n            pass\n        else:\n            n -= 1\n", set()),
        ("class C:\n    def get(self, key):\n        return self.get(key)\n", {"recursive-cycle"}), ("def fact(n):\n    if n <= 1:\n        return 1\n    return n * fact(n - 1)\n", set()), ("class C:\n    @property\n    def name(self):\n        return self.name\n", {"recursive-cycle"}),
        ("import threading\nclass C:\n    def go(self, xs):\n        for x in xs:\n            threading.Thread(target=self.work).start()\n    def work(self):\n        self.n += 1\n", {"unsynchronized-shared-state"}),
        ("import threading\nclass C:\n    def go(self, xs):\n        for x in xs:\n            t = threading.Thread(target=self.work)\n            t.start()\n            t.join()\n    def work(self):\n        self.n += 1\n", set()),
        ("def f():\n    x = lambda y: y + len([z for z in y])\n    return x\n", set()), ("def f(a):\n    return [b for b in a if c]\n", {"undefined-name"}), ("print 'old'\nx = nope\n", {"debug-leftover"}),
        ("from __future__ import annotations\ndef f(a: Later) -> Other:\n    return a\n", set()), ("class C:\n    y = 1\n    z = [1 for _ in range(y)]\n    w = __name__\n", set()),
        ("from m import *\nx = nope\n", set()),
]


@pytest.fixture(scope="module")
def single(spark):
    """What rules say of each file alone, wherever in it."""
    from driftwake.rules import registry

    pairs = spark.createDataFrame([("", "before", "after")], "pair string, before string, after string")
    ctx = check.Context(files.in_memory(spark, {"after": {f"pkg{i}/m.py": t for i, (t, _) in enumerate(FILE_CASES)}}), pairs)
    of_files, of_changes, failed = registry.run(ctx)
    assert failed == []
    out = {}
    for r in of_files.unionByName(of_changes).collect():
        out.setdefault(r.path, set()).add(r.rule)
    return out


@pytest.mark.parametrize("i", range(len(FILE_CASES)))
def test_file_rules_fire_and_stay_quiet(single, i):
    text, rules = FILE_CASES[i]
    assert single.get(f"pkg{i}/m.py", set()) == rules, text


def test_a_rule_that_raises_costs_itself_alone(spark, monkeypatch):
    from driftwake.rules import deep, registry

    rules = dict(registry.RULES)

    @registry.change_rule("broken", "low", into=rules)
    def broken(ctx):
        return ctx.no_such_table

    report = check.check(files.in_memory(spark, {"before": BEFORE, "after": AFTER}), rules=rules)
    assert [(e.rule, e.path) for e in report.errors.filter("rule IS NOT NULL").collect()] == [("broken", None)]
    assert {r.rule for r in report.findings.collect()} >= {"signature-break"}

    def boom(reader):
        raise ValueError("no")

    monkeypatch.setitem(deep.RULES, "leap-day-date", boom)
    told = [f for f, _ in facts.read_facts("m.py", "def f(x=[]):\n    return x\n")]
    assert told.count("error") == 1 and "def" in told and "node" in told


def test_registry_refuses_odd_rules():
    from driftwake.rules import registry

    with pytest.raises(ValueError):
        registry.rule("x", "fatal", into={})
    with pytest.raises(ValueError):
        registry.rule("bare-except", "low")


def test_a_file_that_can_no_longer_be_read_removes_nothing(spark):
    before = {"a.py": "def f():\n    return 1\n", "b.py": "from a import f\n\ndef g():\n    return f()\n"}
    r = check.check(files.in_memory(spark, {"before": before, "after": before | {"a.py": "def f(:\n"}}))
    assert r.findings.collect() == [] and [e.path for e in r.errors.collect()] == ["a.py"] and r.changes.collect() == []


WEB = """import os, subprocess
from flask import Flask, request
app = Flask(__name__)

def run(cmd):
    return subprocess.run(cmd, shell=True)

def build(name):
    return "ls " + name

def given():
    return request.args["q"]

class Runner:
    def __init__(self, cmd):
        os.system(cmd)

@app.route("/")
def far():
    return run(build(request.args["n"]))

@app.route("/g")
def handed():
    Runner(given())

@app.route("/<name>")
def near(name):
    os.system(name)

@app.route("/ok")
def fine():
    n = int(request.args["n"])
    if request.args["v"] in ("a", "b"):
        pass
    v = request.args["v"]
    if not v.isalnum():
        raise ValueError(v)
    os.system("sleep %d %s" % (n, v))

def plain(name):
    os.system(name)
"""


def test_input_reaches_sinks_across_functions(spark):
    r = check.check(files.in_memory(spark, {"before": {}, "after": {"app.py": WEB}}))
    got = {(x.line, x.severity): x.message for x in r.findings.filter("rule = 'unvalidated-input-reaches-sink'").collect()}
    assert set(got) == {(6, "critical"), (16, "critical"), (28, "critical")}
    assert "far() hands it to app.run()" in got[6, "critical"]
    same = check.check(files.in_memory(spark, {"before": {"app.py": WEB}, "after": {"app.py": WEB + "\ndef more():\n    return 1\n"}}))
    assert not [x for x in same.findings.collect() if x.rule == "unvalidated-input-reaches-sink"]


def test_costs_that_grew(spark):
    before = "def has(xs, y):\n    return y in xs\n\ndef work(xs):\n    for x in xs:\n        pass\n\ndef other(xs):\n    for x in xs:\n        work(x)\n"
    after = before.replace("        pass", "        for y in xs:\n            pass")
    r = check.check(files.in_memory(spark, {"before": {"m.py": before}, "after": {"m.py": after}}))
    assert [(x.rule, x.severity, x.message) for x in r.findings.collect()] == [("complexity-regression", "medium", "m.work went from O(n) to O(n^2)")]


def test_partners_in_the_history(spark):
    history = spark.createDataFrame([(f"c{i}", p) for i in range(5) for p in ("schema.py", "parser.py")] + [("x", "other.py")], "commit string, path string")
    texts = {"schema.py": "X = 1\n", "parser.py": "Y = 1\n", "other.py": "Z = 1\n"}
    r = check.check(files.in_memory(spark, {"before": texts, "after": texts | {"schema.py": "X = 2\n"}}), history=history)
    assert [(x.rule, x.severity, x.path) for x in r.findings.collect()] == [("co-change", "medium", "schema.py")]
    both = check.check(files.in_memory(spark, {"before": texts, "after": texts | {"schema.py": "X = 2\n", "parser.py": "Y = 2\n"}}), history=history)
    assert both.findings.collect() == []


def test_circles_of_calls(spark):
    ab = "def a(x):\n    return b(x)\n\n\ndef b(x):\n    return x + 1\n"
    closed = ab.replace("return x + 1", "return a(x) + 1")
    r = check.check(files.in_memory(spark, {"before": {"m.py": ab}, "after": {"m.py": closed}}))
    assert [(x.rule, x.message) for x in r.findings.collect()] == [("recursive-cycle", "these call each other: m.a -> m.b -> m.a")]
    bounded = ab.replace("(x)", "(x, depth)"), closed.replace("(x)", "(x, depth)")
    assert check.check(files.in_memory(spark, {"before": {"m.py": bounded[0]}, "after": {"m.py": bounded[1]}})).findings.collect() == []
    walker = "def walk(node):\n    for child in node.children:\n        visit(child)\n\n\ndef visit(node):\n    return node.name\n"
    assert check.check(files.in_memory(spark, {"before": {"m.py": walker}, "after": {"m.py": walker.replace("return node.name", "return walk(node.body)")}})).findings.collect() == []


def test_cycles_duplicates_values_and_unreferenced(spark):
    body = "".join(f"    v{i} = a * {i} + len(b)\n" for i in range(8)) + "    return v1\n"
    before = {"m/a.py": "import m.b\nFLAG = 7\n\ndef ping(n):\n    return n\n\ndef use():\n    return FLAG\n", "m/b.py": f"def pong(n):\n    return n\n\ndef work(a, b):\n{body}"}
    after = {"m/a.py": "import m.b\nOTHER = 7\n\ndef ping(n):\n    return m.b.pong(n)\n\ndef fresh():\n    return OTHER\n\ndef _lonely():\n    return 1\n", "m/b.py": f"from m.a import ping\n\ndef pong(n):\n    return ping(n)\n\ndef work(a, b):\n{body}\ndef work2(a, b):\n{body}"}
    r = check.check(files.in_memory(spark, {"before": before, "after": after}))
    got = {x.rule for x in r.findings.collect()}
    assert {"import-cycle", "near-duplicate", "reused-value", "new-unreferenced"} <= got


def test_git_and_directory_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".hidden").mkdir()
    for p, t in (("pkg/a.py", "x = 1\n"), ("pkg/b.py", "﻿é = 2\n"), (".hidden/c.py", "y = 3\n"), ("notes.txt", "no")):
        (tmp_path / p).write_text(t, encoding="utf-8")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "pkg/a.py").write_text("x = 2\n")
    rev = files.git_revision(spark, str(tmp_path), "HEAD", snapshot="before")
    tree = files.directory(spark, str(tmp_path), "after")
    assert {(r.path, r.text) for r in rev.collect()} == {("pkg/a.py", "x = 1\n"), ("pkg/b.py", "é = 2\n")}
    both = rev.unionByName(tree.select("snapshot", "path", "text"))
    assert [r.path for r in files.changed_paths(both, "before", "after").collect()] == ["pkg/a.py"]
    assert {r.path for r in files.git_history(spark, str(tmp_path)).collect()} >= {"pkg/a.py", "pkg/b.py"}
    assert files.changed_stamps(tree, tree).count() == 0

"""Flags of patterns, baskets of all items, calls in edited functions."""

import pytest

from driftwake.operators import contracts, mining
from driftwake.sources import facts


@pytest.mark.parametrize("call, hit", [
    (r"re.match(r'(?:[a-z]+[A-Z]+)*;', s)", False), (r"re.match(r'(?:[a-z]+[A-Z]+)*;', s, re.I)", True), (r"re.match(r'(?i)(?:[a-z]+[A-Z]+)*;', s)", True),
    (r"re.match(r'(?:.+\n+)*;', s)", False), (r"re.match(r'(?:.+\n+)*;', s, flags=re.DOTALL)", True), (r"re.match(r'(?:.+\n+)*;', s, re.I | re.S)", True),
])
def test_flags_change_what_items_take(call, hit):
    found = [d for f, d in facts.read_facts("m.py", f"import re\ndef f(s):\n    return {call}\n") if f == "finding"]
    assert bool(found) == hit


def test_a_basket_of_all_items(spark):
    rows = [(0, i) for i in range(5000)] + [(b, i) for b in range(1, 7) for i in (1, 2)] + [(7, 1), (8, None), (1, 1)]
    got = mining.baskets(spark.createDataFrame(rows, "b long, i long"), "b", "i")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 6, 7, 6 / 7), (2, 1, 6, 6, 1.0)]


def test_an_edited_functions_calls_are_its_writers(spark):
    sites = lambda dst: spark.createDataFrame([("f", 10, 12, 4, dst), ("g", 1, 2, 4, dst)], "src string, start int, line int, col int, dst string")
    edited = spark.createDataFrame([("g",)], "src string")
    assert [tuple(r) for r in contracts.rebound_calls(sites("h(int)"), sites("h(long)"), edited).collect()] == [("f", 12, "h(int)", "h(long)")]
    assert contracts.rebound_calls(sites("h(int)"), sites("h(long)")).count() == 2


def test_roles_have_reasons(spark):
    from driftwake.operators import roles

    schema = "parts array<string>, path array<string>, imported array<string>, decorators array<string>, main_guard boolean, opens boolean, exits boolean, returns boolean, params boolean, writes_global boolean, reads_global boolean, mutates boolean, container boolean, constant boolean, calls int, statements int"
    row = lambda parts, **k: tuple({"parts": parts, "path": parts, **k}.get(c.split()[0]) for c in schema.split(", "))
    rows = [row(["app", "db", "cache"]), row(["app"]), row(["app", "my_client"]), row(None), row(["a", "b"], statements=2), row(["x", "test_y.py"]), row(["a", "logic"], imported=["redis", "os"]), row(["a", "b"], decorators=["app.route"], main_guard=True)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(roles.module_label()).collect()]
    assert [r["layer"] for r in got] == ["state", "entrypoint", "data_access", "unknown", "domain", "test", "data_access", "interface"]
    assert all(r["evidence"] for r in got)
    one = spark.createDataFrame([row(["a"], constant=True), row(["a"], container=True), row(["a"])], schema)
    from pyspark.sql import functions as F

    assert [r[0] for r in one.select(roles.variable_label(F.lit("domain"))["layer"]).collect()] == ["config", "state", "domain"]


def test_texts_are_read_on_all_cores(spark):
    from driftwake.sources import facts, files

    known = facts.facts(files.in_memory(spark, {"v": {f"a{i}.py": f"x = {i}\n" for i in range(64)}}))
    assert known.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert known.select("path").distinct().count() == 64


def test_facts_leave_a_task_by_bytes():
    import pyarrow as pa

    texts = [f"def f{i}():\n    return '{'x' * 50_000}'\n" for i in range(200)]
    part = pa.RecordBatch.from_arrays([pa.array([f"a{i}.py" for i in range(200)]), pa.array(texts), pa.array([["v"]] * 200)], names=["path", "text", "snapshots"])
    got = list(facts.read_batches(iter([part])))
    want = [(["v"], f"a{i}.py", *f) for i, t in enumerate(texts) for f in facts.read_facts(f"a{i}.py", t)]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
    assert len(got) > 5 and max(b.nbytes for b in got) < 2 * facts.BYTES_HELD


def test_a_rule_alone_reads_what_it_needs(spark):
    import json

    from driftwake.plans import check, rule_tables
    from driftwake.rules import registry
    from driftwake.sources import files

    for rule, cases in rule_tables.CASES.items():
        asked = check.asked_of_reader({rule: registry.RULES[rule]})
        for text in (t for c in cases for t in rule_tables.several(c[1]).values()):
            every, some = (facts.read_facts("m.py", text, a) for a in (None, asked))
            told = [(f, d) for f, d in every if f == "finding" and json.loads(d)["rule"] == rule]
            assert [x for x in some if x[0] == "finding"] == told and set(some) <= set(every)
            assert {x for x in every if x[0] in ("def", "use", "import", "mark")} <= set(some)
    every = check.asked_of_reader(registry.RULES)
    assert all(set(facts.read_facts("m.py", t, every)) == set(facts.read_facts("m.py", t)) for t in ("def f(x=[]):\n    while x:\n        print(g)\n",))
    assert check.asked_of_reader({"own": registry.RULES["env-var-renamed"]}) is None
    two = files.in_memory(spark, {"before": {}, "after": {"m.py": "def f(x):\n    assert (x, 'no')\n\ndef g():\n    return f(1)\n"}})
    ctx = check.Context(two, spark.createDataFrame([("", "before", "after")], "pair string, before string, after string"), rules={"assert-on-tuple": registry.RULES["assert-on-tuple"]})
    assert {"def", "use", "node"} <= ctx.facts_there and not {"tokens", "asked", "given", "cost", "flow"} & ctx.facts_there
    report = check.check(two, rules={"assert-on-tuple": registry.RULES["assert-on-tuple"]})
    assert not {"edges", "affected"} & set(vars(report))  # made when asked for
    assert [r.rule for r in report.findings.collect()] == ["assert-on-tuple"] and report.edges.count() == 1


def test_what_was_read_stays_where_it_is(spark):
    from driftwake.plans import check
    from driftwake.sources import files

    two = files.in_memory(spark, {"before": {"m.py": "x = 1\n"}, "after": {"m.py": "x = 2\n"}})
    ctx = check.Context(two, spark.createDataFrame([("", "before", "after")], "pair string, before string, after string"))
    assert "rightHint=(strategy=broadcast)" in ctx.facts._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.side, r.path) for r in ctx.facts.collect()} == {("before", "m.py"), ("after", "m.py")}


def test_reach_broadcasts_no_steps(spark, monkeypatch):
    from pyspark.sql import functions as F

    from driftwake.operators import graph

    plans, real = [], graph.cut_in_loop
    monkeypatch.setattr(graph, "cut_in_loop", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    edges = spark.range(1, 40).select(F.col("id").alias("src"), F.floor(F.col("id") / 3).alias("dst")).filter("dst > 0")
    got = {r.node: r.hops for r in graph.reach(edges, spark.range(2, 3).withColumnRenamed("id", "node"), backward=True).collect()}
    assert got == {2: 0, 6: 1, 7: 1, 8: 1} | {i: 2 for i in range(18, 27)}
    joined = [p for p in plans if "Join" in p]
    assert joined and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in joined)

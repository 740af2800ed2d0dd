import pytest

from driftwake.plans import check, tools, worklist
from driftwake.sources import files, lines, python2

BASE = {"pay.py": "RATE = 3\n\ndef charge(amount):\n    return amount * RATE\n", "shop.py": "from pay import charge\n\ndef total(x):\n    return charge(x)\n\ndef other(x):\n    return charge(x)  # charge it\n", "notes.py": "# charge is not called here\nX = 'charge'\n"}
EDITS = [{"path": "pay.py", "old": "def charge(amount):\n    return amount * RATE", "new": "def charge(amount, currency):\n    return amount * RATE, currency"}]


def test_edits_are_placed_once():
    assert worklist.placed(BASE, EDITS)["pay.py"].count("currency") == 2
    crlf = {"a.py": "x = 1\r\ny = 2\r\n"}
    assert worklist.placed(crlf, [{"path": "a.py", "old": "x = 1\ny = 2", "new": "x = 1\ny = 3"}])["a.py"] == "x = 1\r\ny = 3\r\n"
    for path, old in (("none.py", "x"), ("shop.py", "charge(x)"), ("pay.py", "def chrge(amount):")):
        with pytest.raises(worklist.PlanError):
            worklist.placed(BASE, [{"path": path, "old": old, "new": "y"}])


def test_plan_progress_done(spark, tmp_path):
    f = files.in_memory(spark, {"base": BASE})
    plan = worklist.plan(f, "base", EDITS)
    assert plan["verdict"] == "block" and [(e["rule"], e["path"], e["line"]) for e in plan["edit"]] == [("signature-break", "shop.py", 4), ("signature-break", "shop.py", 7)]
    assert plan["by_language"] == {"python": 3} and plan["not_read"] == [] and plan["unchanged"] == []
    why = {r["why"]: r["where"] for r in plan["ruled_out"]}
    assert why["a comment or a text"] == ["notes.py:1", "notes.py:2"]
    worklist.save(spark, str(tmp_path), "one", plan)
    saved = worklist.load(spark, str(tmp_path), "one")
    assert saved == plan
    half = BASE | {"shop.py": BASE["shop.py"].replace("total(x):\n    return charge(x)", "total(x):\n    return charge(x, 'eur')")}
    now = worklist.progress(files.in_memory(spark, {"base": BASE, "now": half}), "now", saved)
    assert not now["done"] and now["planned_not_made"] == EDITS and [(x["path"], x["line"]) for x in now["left"]] == [("shop.py", 7)]
    end = worklist.placed(half, EDITS) | {"shop.py": half["shop.py"].replace("charge(x)  #", "charge(x, 'eur')  #")}
    out = worklist.done(files.in_memory(spark, {"base": BASE, "now": end}), "now", saved)
    assert out["done"] and out["changed"] == {"pay.py": "3-4", "shop.py": "4,7"}


@pytest.fixture(scope="module")
def report(spark):
    after = BASE | {"pay.py": BASE["pay.py"].replace("(amount)", "(amount, currency)")}
    return check.check(files.in_memory(spark, {"before": BASE, "after": after}))


def test_terminal_text(report):
    said = tools.text(report)
    assert said.startswith("driftwake: BLOCK (against before)") and "[ ] CRITICAL signature-break  shop.py:4" in said and "fix: pass what the new signature asks for" in said


def test_questions(spark):
    ctx = check.Context(files.in_memory(spark, {"now": BASE | {"tests/test_pay.py": "def test_x():\n    pass\n", "dead.py": "def never_said():\n    return 1\n\nclass Sub(Base):\n    def hook_me(self):\n        return 1\n"}}), spark.createDataFrame([("", "now", "now")], "pair string, before string, after string"))
    defs, edges = ctx.defs_of("after").drop("pair", "side"), ctx.edges.filter("side = 'after'")
    one = tools.resolve(defs, "charge")
    assert one["definition"]["name"] == "pay.charge" and tools.resolve(defs, "pay.py:4")["definition"]["name"] == "pay.charge" and tools.resolve(defs, "PAY.Charge")["definition"]["name"] == "pay.charge"
    assert "charge" in tools.resolve(defs, "chrge")["did_you_mean"] and tools.resolve(defs, "pay.py:99") == {"candidates": [], "more": 0}
    got, by_file = tools.reach(defs, edges, "pay.charge")
    assert [(r.name, r.hops) for r in got.collect()] == [("shop.other", 1), ("shop.total", 1)] and [(r.path, r.definitions) for r in by_file.collect()] == [("shop.py", 2)]
    about = tools.node(defs, edges, "pay.charge")
    assert [r.name for r in about["uses"].collect()] == ["pay.RATE"] and len(about["used_by"].collect()) == 2
    dead = {r.name for r in tools.unused(defs, ctx.files.filter("side = 'after'").select("path", "text")).collect()}
    assert dead == {"shop.total", "shop.other", "notes.X", "dead.never_said"}


def test_shared_work(spark, tmp_path):
    for who in ("ann", "bob", "ann"):
        tools.share(tools.load(spark, BASE | {"mine.py": f"X = '{who}'\n"}, "x"), str(tmp_path), who)
    got = {(r.snapshot, r.path) for r in tools.shared(spark, str(tmp_path)).collect()}
    assert got == {(f"wip/{w}", p) for w in ("ann", "bob") for p in [*BASE, "mine.py"]}


def test_masks_matches_and_statements(spark):
    text = "x = 'a#b' # c 'd'\ny = \"\"\"q\n#z\"\"\" + 'it\\'s'\n"
    assert lines.mask(text, "python") == "x = '   '        \ny = \"\"\" \n  \"\"\" + '     '\n"
    assert lines.mask("a /* b\nc */ d // e", "c") == "a     \n     d     " and lines.mask("C comment\n      X = 'a' ! b", "fortran", "x.f") == "         \n      X = ' '    "
    asked, known = (spark.createDataFrame([(n,) for n in names], "name string") for names in (["chrge", "zzzz"], ["charge", "change", "other", "large"]))
    assert {r.asked: r.close for r in lines.close_matches(asked, known).collect()} == {"chrge": ["charge", "change", "large"]}
    cobol = ["       MOVE A", "         TO B.", "       STOP RUN."]
    assert lines.statement(cobol, 1, "x.cbl", "cobol") == (1, 2) and lines.statement(["call f(a,", "     1 b)", "      x = 1"], 2, "x.f", "fortran") == (1, 2)


def test_old_python_is_read():
    import ast

    text = "import os\ndef f(x, y=0777):\n    print 'a', x, # say\n    print >>sys.stderr, 'b %s' % x\n    if x <> y: print x\n    try:\n        exec code in ns\n    except (IOError, OSError), e:\n        raise ValueError, 'bad, thing'\n    return `x` + ur'\\d' + u'print 1', 10L\n"
    new = python2.rewritten(text)
    assert len(new.splitlines()) == len(text.splitlines()) and "'print 1'" in new and ast.parse(new)
    for fine in ("def f(a):\n    print(a, end='')\n    return a < b > c\n", "x = '''\nprint a\n'''\n"):
        assert ast.dump(ast.parse(python2.rewritten(fine))) == ast.dump(ast.parse(fine))

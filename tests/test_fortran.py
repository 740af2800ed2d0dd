"""Fortran: what statements read and write, and what checks of texts say and must not say."""

import json

import pytest

from driftwake.plans import check
from driftwake.rules import registry
from driftwake.sources import files, fortran

RULES = ("common-layout-mismatch", "implicit-interface-arg-mismatch", "intent-out-read-before-write", "reads-unset-local")


def free(*rows: str) -> str:
    return "\n".join(rows) + "\n"


def sub(*rows: str, head: str = "subroutine s(a, n)") -> str:
    return free(head, *rows, "end subroutine s")


def first(text: str, path: str = "x.f90") -> dict[str, bool]:
    """Whether the first access of each name that is told writes."""
    return {d["name"]: d["writes"] for f, t in fortran.read(path, text) if f == "access" for d in [json.loads(t)]}


@pytest.mark.parametrize("body, want", [
    (["x = 1", "y = x + z"], {"x": True, "y": True, "z": False}), (["call f(x, y + 1)", "x = y"], {"x": True, "y": False}), (["if (k > 0) x = k", "y = x"], {"k": False, "x": True, "y": True}),
    (["do i = 1, m", "  t = t + i", "end do"], {"i": True, "m": False, "t": False}), (["real :: v(3), w", "w = v(j) + sqrt(u)"], {"w": True, "j": False, "u": False}), (["read(*, *) x", "write(*, *) x, y"], {"x": True, "y": False}),
    (["real, save :: x", "real :: y = 2.0", "z = x + y"], {"z": True}), (["data x /1/", "z = x"], {"z": True}), (["use m", "z = x"], {}), (["implicit none", "z = x"], {}), (["10 x = y", "goto 10"], {}), (["goto 10", "x = 1", "10 y = x"], {"x": True, "y": True}),
    (["z = fun(x) + fun2(y * 2)"], {"x": True, "y": False, "z": True}), (["x = 1.5e3 + 2.d0 + 'a b'"], {"x": True}), (["print *, (q(i), i = 1, 3)"], {}), (["a = n", "n = a"], {}), (["x10 = y200 + 3.5"], {"x10": True, "y200": False}), (["select case (k)", "case (1)", "end select"], {"k": False}),
])
def test_first_accesses(body, want):
    assert first(sub(*body)) == want


def test_forms_and_units():
    fixed = "      SUBROUTINE S(A)\n      COMMON /B/ X, I,\n     &  C(3)\nC     comment X = Y\n      INTEGER X\n      Z = A\n      END\n"
    found = [(f, json.loads(t)) for f, t in fortran.read("s.f", fixed)]
    assert [d["layout"] for f, d in found if f == "common"] == ["integer, integer, real(3)"] and [d["name"] for f, d in found if f == "access"] == ["z"]
    text = "module m\ncontains\nsubroutine inner(a)\nend subroutine\nend module\nsubroutine plain(a, &\n  b)\ninterface\nsubroutine other(q)\nend subroutine\nend interface\nend\nreal function f(x) result(r)\nr = x\nend function\n"
    assert [(d["unit"], d["explicit"]) for f, t in fortran.read("m.f90", text) for d in [json.loads(t)] if f == "unit"] == [("inner", True), ("plain", False), ("f", False)]
    for odd in ("", "\n", "end", "subroutine", "subroutine s(", "x = (", "common /", "if (", "do i ="):
        fortran.read("x.f90", odd)


ONE = "      SUBROUTINE ONE\n      COMMON /B/ X, Y\n      X = Y\n      END\n"
TWO, THREE = ONE.replace("ONE", "TWO"), ONE.replace("ONE", "THREE")
CALLEE = "      SUBROUTINE ADDUP(A, B)\n      B = A\n      END\n"
MAIN = "      PROGRAM MAIN\n      REAL X\n      CALL ADDUP(1.0, X)\n      END\n"
OUT = sub("real, intent(out) :: a", "integer, intent(in) :: n", "a = n")
CHECKS = [
    ({"a.f": ONE, "b.f": TWO, "c.f": THREE}, {"a.f": ONE, "b.f": TWO, "c.f": THREE.replace("X, Y", "X, Y(2)")}, [("common-layout-mismatch", "c.f", 2)]),
    ({"a.f": ONE, "b.f": TWO, "c.f": THREE}, {"a.f": ONE, "b.f": TWO, "c.f": THREE.replace("X, Y", "P, Q").replace("X = Y", "P = Q")}, []),
    ({"a.f": ONE, "b.f": TWO, "c.f": THREE.replace("X, Y", "X, Y(2)")}, {"a.f": ONE, "b.f": TWO, "c.f": THREE.replace("X, Y", "X, Y(2)") + "C     more\n"}, []),
    ({"s.f": CALLEE, "m.f": MAIN}, {"s.f": CALLEE, "m.f": MAIN.replace("1.0, X", "1.0, X, 3")}, [("implicit-interface-arg-mismatch", "m.f", 3)]),
    ({"s.f": CALLEE, "m.f": MAIN}, {"s.f": CALLEE.replace("A, B)", "A, B, C)"), "m.f": MAIN}, []),
    ({"s.f90": "module q\ncontains\n" + CALLEE + "end module\n", "m.f": MAIN}, {"s.f90": "module q\ncontains\n" + CALLEE + "end module\n", "m.f": MAIN.replace("1.0, X", "1.0")}, []),
    ({"o.f90": OUT}, {"o.f90": OUT.replace("a = n", "if (a > 0) return\na = n")}, [("intent-out-read-before-write", "o.f90", 4)]),
    ({"o.f90": OUT.replace("out", "inout")}, {"o.f90": OUT.replace("a = n", "if (a > 0) return\na = n")}, [("intent-out-read-before-write", "o.f90", 4)]),
    ({"o.f90": OUT.replace("a = n", "if (a > 0) return\na = n")}, {"o.f90": OUT.replace("a = n", "if (a > 1) return\na = n")}, []),
    ({"l.f90": sub("real t", "t = 0", "a = t + n")}, {"l.f90": sub("real t", "a = t + n")}, [("reads-unset-local", "l.f90", 3)]),
    ({"l.f90": sub("real t", "t = 0", "a = t + n")}, {"l.f90": sub("real t", "call init(t)", "a = t + n")}, []),
    ({"l.f90": sub("real t", "t = 0", "a = t + n")}, {"l.f90": sub("real, save :: t", "a = t + n")}, []),
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

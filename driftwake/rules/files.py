"""Rules of one file as conditions over its nodes; all of them together are one pass over one table."""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwake.functions.text import name_words
from driftwake.rules.registry import node_rule, rule

# What counts as a container, as output, as a command-line program.
CONTAINERS = ("List", "Dict", "Set", "ListComp", "DictComp", "SetComp")
CONTAINER_CALLS = ("list", "dict", "set", "bytearray", "defaultdict", "OrderedDict", "Counter", "deque")
OUTPUT_WORDS = ("main", "cli", "print", "pprint", "show", "display", "output", "echo", "report", "dump", "usage", "help", "banner")
PROGRAM_IMPORTS = ("argparse", "optparse", "getopt", "click", "typer")
BROAD = ("Exception", "BaseException")
MODULE_NAMES = ("__file__", "__name__", "__doc__", "__package__", "__spec__", "__loader__", "__path__", "__builtins__", "__annotations__", "__dict__", "__class__", "__module__", "__qualname__", "WindowsError")

C = F.col
LEAVES = ("Return", "Raise", "Break", "Continue")


def of(role: str) -> Column:
    return F.filter("parts", lambda p: p["role"] == role)


def last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def when(kind: str, condition: Column, message: Column, line: Column | None = None) -> tuple[Column, Column, Column | None]:
    return (C("kind") == kind) & F.coalesce(condition, F.lit(False)), message, line


@node_rule("assert-on-tuple", "medium", fix="assert the condition, with the text after a comma and no brackets")
def assert_on_tuple():
    return [when("assert", (C("type") == "Tuple") & (F.size("parts") > 0), F.lit("the assertion tests a tuple, which is always true"))]


@node_rule("bare-except", "low", fix="name what is caught")
def bare_except():
    return [when("handler", F.size(of("type")) == 0, F.lit("a handler without a type catches everything"))]


@node_rule("swallowed-exception", "low", fix="catch less, or say what happened")
def swallowed():
    idle = F.forall(of("body"), lambda p: p["idle"])
    broad = lambda role: F.exists(of(role), lambda p: last(p["name"]).isin(*BROAD))
    return [
        when("handler", broad("type") & idle, F.concat(F.lit("`except "), C("said"), F.lit("` throws the error away"))),
        when("with", (last(C("name")) == "suppress") & broad("arg"), F.concat(F.lit("`"), C("said"), F.lit("` throws every error away"))),
    ]


@node_rule("compare-to-none", "low", fix="use `is` or `is not`")
def compare_to_none():
    nones = F.exists("parts", lambda p: p["role"].isin("Eq", "NotEq") & (p["name"] == "None"))
    return [when("compare", nones, F.concat(F.lit("`"), C("said"), F.lit("` compares to None by equality")))]


@node_rule("mutable-default-argument", "medium", fix="default to None and make the value inside")
def mutable_default():
    made = C("type").isin(*CONTAINERS) | ((C("type") == "Call") & last(C("name")).isin(*CONTAINER_CALLS))
    return [when("default", made, F.concat(F.lit("all calls share one default in "), C("said")))]


@node_rule("constant-condition", "low", fix="take out what never runs")
def constant_condition():
    """Numbers, booleans and None; text and the ellipsis are left alone, and so is a loop that is meant to be endless."""
    test = F.get(of("test"), F.lit(0))["name"]
    other = F.get(of("else"), F.lit(0))
    known = C("type").isin("int", "float", "complex", "bool", "NoneType")
    never = F.concat(F.lit("what stands under `"), C("said"), F.lit("` never runs"))
    return [
        when("if", known & (test == "False"), never),
        when("while", known & (test == "False"), never),
        when("if", known & (test == "True") & other.isNotNull(), F.concat(F.lit("the else of `"), C("said"), F.lit("` never runs")), other["line"]),
    ]


@node_rule("unreachable-code", "medium", fix="take it out, or let it run")
def unreachable():
    """In the order of a block: what follows the first statement that leaves it, if it does anything and holds no yield
    (which makes a generator, reached or not)."""
    leaves = F.transform("parts", lambda p: p["type"].isin(*LEAVES))
    at = F.array_position(leaves, F.lit(True)).cast("int")
    rest = F.slice("parts", at + 1, F.size("parts"))
    dead = (at > 0) & (F.size(rest) > 0) & ~F.forall(rest, lambda p: p["idle"]) & ~F.exists(rest, lambda p: p["name"] == "yield")
    line, by = F.get(rest, F.lit(0))["line"], F.get("parts", at - 1)["line"]
    return [when("block", dead, F.concat(F.lit("line "), line.cast("string"), F.lit(" never runs: line "), by.cast("string"), F.lit(" leaves the block first")), line)]


@node_rule("debug-leftover", "low", fix="take it out, or log it")
def debug_leftover():
    """Programs print on purpose: files named or built like one, functions named for output, the program's guard, and print
    to a file given. A breakpoint is never on purpose."""
    speaks = F.exists("within", lambda f: (f == "__main__") | F.exists(name_words(f), lambda w: w.isin(*OUTPUT_WORDS)))
    program = F.arrays_overlap("tops", F.array(*(F.lit(x) for x in ("__main__", "main", *PROGRAM_IMPORTS)))) | C("path").rlike(r"(^|/)(cli|__main__)\.py$")
    silent = (C("name") == "print") & ~speaks & ~program & ~F.exists("parts", lambda p: p["name"] == "file")
    return [when("call", C("name").isin("breakpoint", "pdb.set_trace", "ipdb.set_trace"), F.concat("name", F.lit("() left in"))), when("call", silent, F.lit("print() left in"))]


def missing_names(asked: DataFrame, given: DataFrame, opaque: DataFrame, keys: list[str]) -> DataFrame:
    """Names looked up as globals that nothing defines: not the module, not the language; silent on files whose names may
    come from where no reader sees them."""
    known = [*dir(builtins), *MODULE_NAMES]
    out = asked.filter(~C("name").isin(*known)).join(given.select(*keys, "name").distinct(), [*keys, "name"], "left_anti")
    return out.join(opaque.select(*keys).distinct(), keys, "left_anti")


READ = {
    "leap-day-date": (True, "move the date with a calendar, or say what February 29 becomes"),
    "loop-without-progress": (True, "let every way round the loop change what it tests"),
    "regex-catastrophic-backtracking": (False, "let no two unbounded parts match the same text"),
    "unreachable-statement": (True, "put what belongs together in braces: what is indented below an if need not be in it"),
    "unsynchronized-shared-state": (False, "hold one lock round all uses"),
}


def _read(id_: str, blocking: bool, fix: str) -> None:
    """A rule that the reader judges (rules/deep.py)."""
    @rule(id_, "high", blocking=blocking, fix=fix)
    def build(context):
        if id_ not in context.read_rules:
            return None
        return context.found_by_reader.filter((C("side") == "after") & (C("rule") == id_)).select("pair", "severity", "message", "path", "line")


for _id, _about in READ.items():
    _read(_id, *_about)

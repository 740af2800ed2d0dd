"""Rules of Fortran over storage and order of accesses in both versions. Only what is new is told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.operators import layouts
from driftwake.operators.records import line_text
from driftwake.rules.languages import SCOPE, side
from driftwake.rules.registry import change_rule

C = F.col


@change_rule("common-layout-mismatch", "critical", blocking=True, fix="declare the block the same way everywhere: one INCLUDE file, or a module")
def common_layouts(ctx) -> DataFrame | None:
    """A10. Units whose COMMON block is laid out otherwise than in most, and was not, or not so, before. Storage is shared by place."""
    if "common" not in ctx.facts_there:
        return None
    told = ctx.table("common").select(*SCOPE, F.struct("pair", "block").alias("block"), F.struct("unit", "path").alias("unit"), "layout", "line")
    found = layouts.layout_mismatches(side(told, "before").select("block", "unit", "layout"), side(told, "after").select("block", "unit", "layout"))
    at = side(told, "after").groupBy("block", "unit").agg(F.min("line").alias("line"))
    return found.join(at, ["block", "unit"]).select("block.pair", line_text("COMMON /", C("block.block"), "/ in ", C("unit.unit"), " is (", C("layout"), "), elsewhere (", C("usual"), ")").alias("message"), C("unit.path").alias("path"), "line")


def unset(ctx, what: str) -> DataFrame:
    """Variables whose first access, in the order of statements, reads what nothing has set; new ones, at the line that reads."""
    rows = ctx.table("access").filter(C("what") == what)
    one = rows.select(*SCOPE, F.struct("pair", "path", "unit").alias("routine"), "name", C("line").alias("ord"), "line", "writes")
    declared = lambda s: side(one, s).select("routine", "name").distinct()
    hazards = lambda s: layouts.read_before_write(side(one, s).drop("pair"), declared(s))
    return layouts.new_findings(hazards("before"), hazards("after"), ["routine", "name"])


@change_rule("intent-out-read-before-write", "high", blocking=True, fix="set the argument before it is read, or make it INTENT(INOUT)")
def intent_out(ctx) -> DataFrame | None:
    """Arguments of INTENT(OUT), which have no value at entry, read first."""
    if "access" not in ctx.facts_there:
        return None
    return unset(ctx, "out").select("routine.pair", line_text(C("routine.unit"), " reads its INTENT(OUT) argument ", C("name"), " before setting it").alias("message"), "routine.path", "line")


@change_rule("reads-unset-local", "medium", fix="give the variable a value on every way to where it is read")
def unset_locals(ctx) -> DataFrame | None:
    """Scalars of a unit's own, neither saved nor given a value, read first."""
    if "access" not in ctx.facts_there:
        return None
    return unset(ctx, "local").select("routine.pair", line_text(C("routine.unit"), " reads ", C("name"), " before setting it").alias("message"), "routine.path", "line")


@change_rule("implicit-interface-arg-mismatch", "critical", blocking=True, fix="give the routine an interface that callers see (a module), then mend the calls")
def implicit_interfaces(ctx) -> DataFrame | None:
    """J29. Calls of routines whose interface the compiler does not see, with another number of arguments than they have, that are new. Of a
    routine whose arguments changed signature-break tells every call."""
    if "unit" not in ctx.facts_there:
        return None
    plain = ctx.table("unit").filter("NOT explicit AND kind <> 'program'").select(*SCOPE, F.concat(F.lit("fortran@"), "unit").alias("dst")).distinct()
    takes = ctx.defs.filter("name LIKE 'fortran@%' AND params IS NOT NULL").select(*SCOPE, C("name").alias("dst"), F.size("params.positional").alias("takes"))
    calls = ctx.edges.filter("kind = 'calls' AND NOT guess AND NOT unpacked AND dst LIKE 'fortran@%'").select(*SCOPE, "src", "dst", "path", "line", "positional")
    wrong = calls.join(plain, [*SCOPE, "dst"]).join(takes, [*SCOPE, "dst"]).filter("positional <> takes")
    key = ["pair", "src", "dst", "positional", "takes"]
    changed = ctx.changes.filter("kind = 'signature'").select("pair", C("name").alias("dst"))
    new = side(wrong, "after").join(side(wrong, "before").select(*key).distinct(), key, "left_anti").join(changed, ["pair", "dst"], "left_anti")
    short = lambda c: F.substring_index(c, "@", -1)
    said = line_text(short("src"), " calls ", short("dst"), " with ", C("positional"), " arguments, it has ", C("takes"))
    return new.groupBy("pair", "path", "line").agg(F.min(said).alias("message"))

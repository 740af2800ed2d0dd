"""Rules of C over declarations and switches of both versions. The facts are a reader's; sizes, values and layouts are worked out over
all files of a version (operators/records.py), and what differs by operators/layouts.py. Only headers speak of layouts and values,
for what is compiled apart holds on to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.operators import graph, layouts, records
from driftwake.operators.records import line_text
from driftwake.rules.registry import change_rule

C = F.col
SCOPE = ["pair", "side"]
SHOWN = 4


def side(df: DataFrame, which: str) -> DataFrame:
    return df.filter(C("side") == which).drop("side")


def listed(what: str, most: int = SHOWN):
    """The first few of an array as text, and how many more."""
    more = F.when(F.size(what) > most, line_text(" and ", F.size(what) - most, " more")).otherwise("")
    return F.concat(F.array_join(F.slice(what, 1, most), ", "), more)


def c_constants(ctx) -> DataFrame:
    return ctx.kept("c constants", lambda: graph.cut(records.constants(ctx.table("constant").select(*SCOPE, "owner", "name", "expr", "plus").distinct(), SCOPE)))


def c_layouts(ctx) -> DataFrame:
    return ctx.kept("c layouts", lambda: graph.cut(records.sized(ctx.table("record"), ctx.table("alias"), c_constants(ctx).select(*SCOPE, "name", "value"), SCOPE)))


def c_members(ctx) -> DataFrame:
    """pair, side, owner, member, value, path, line of enumerators."""
    def make() -> DataFrame:
        places = records.last_of(ctx.table("constant").filter("owner IS NOT NULL"), [*SCOPE, "owner", "name"]).select(*SCOPE, "owner", "name", "path", "line")
        return graph.cut(places.join(c_constants(ctx), [*SCOPE, "owner", "name"], "left").select(*SCOPE, F.struct("pair", "owner").alias("owner"), C("name").alias("member"), "value", "path", "line"))

    return ctx.kept("c members", make)


def c_switches(ctx) -> DataFrame:
    def make() -> DataFrame:
        known = c_members(ctx).select(*SCOPE, "owner", "member")
        return graph.cut(records.of_enum(ctx.table("switch"), known, SCOPE))

    return ctx.kept("c switches", make)


@change_rule("struct-layout-change", "high", blocking=True, fix="build all that includes the header again, and look at code that reads the record as bytes")
def struct_layouts(ctx) -> DataFrame | None:
    """Records of a header that are in both versions, with fields that went, came, moved or became of another type or size."""
    if "record" not in ctx.facts_there:
        return None
    found = c_layouts(ctx)
    rows = records.field_rows(found, SCOPE).withColumn("owner", F.struct("pair", "owner"))
    diff = layouts.layout_changes(side(rows, "before"), side(rows, "after"), ("type", "size", "offset", "at"), rename_is_fine=False)
    what = F.when(C("field") == "", "its size").otherwise(F.concat("field", F.lit(" ("), F.when(C("change") == "at", "order").otherwise(C("change")), F.lit(")")))
    told = diff.groupBy("owner").agg(F.array_sort(F.collect_list(what)).alias("what"))
    at = side(found, "after").filter(C("path").endswith(".h")).select("pair", "path", "line", C("name"), F.struct("pair", C("name").alias("owner")).alias("owner"))
    return at.join(told, "owner").select("pair", line_text("layout of ", C("name"), " changed: ", listed("what")).alias("message"), "path", "line")


@change_rule("enum-values-shifted", "high", blocking=True, fix="add new members at the end, or give each a value of its own")
def enum_values(ctx) -> DataFrame | None:
    """Members of a header's enum that stand for another number now."""
    if "constant" not in ctx.facts_there:
        return None
    m = c_members(ctx)
    b, a = side(m, "before"), side(m, "after")
    moved = layouts.shifted_values(b.select("owner", "member", "value"), a.select("owner", "member", "value"))
    said = moved.groupBy("owner").agg(F.array_sort(F.collect_list(line_text(C("member"), " ", C("was"), " to ", C("now")))).alias("what"))
    at = a.filter(C("path").endswith(".h")).groupBy("owner").agg(F.max("path").alias("path"), F.min("line").alias("line"))
    return at.join(said, "owner").select("owner.pair", line_text("members of ", C("owner.owner"), " have other values: ", listed("what")).alias("message"), "path", "line")


@change_rule("unhandled-new-member", "medium", fix="handle the new member wherever the type is switched on")
def unhandled_members(ctx) -> DataFrame | None:
    """Switches that named all members that there were, at least two, and not one that is new; a default takes it unseen."""
    if not {"constant", "switch"} <= ctx.facts_there:
        return None
    m = c_members(ctx)
    b, a = side(m, "before").select("owner", "member"), side(m, "after").select("owner", "member")
    enough = b.groupBy("owner").agg(F.count_distinct("member").alias("n")).filter("n >= 2").select("owner")
    s = side(c_switches(ctx), "after").select("owner", F.struct("path", "line", "holder", "subject").alias("holder"), "member", F.lit(False).alias("has_default"))
    found = layouts.unhandled_new_members(b.join(enough, "owner", "left_semi"), a.join(enough, "owner", "left_semi"), s)
    return found.select("owner.pair", line_text(listed("missing"), " of ", C("owner.owner"), " not handled by the switch on ", C("holder.subject"), " in ", F.substring_index("holder.holder", "@", -1)).alias("message"), "holder.path", "holder.line")


@change_rule("non-exhaustive-match", "medium", fix="handle the missing members, or add a default that fails loudly")
def missing_cases(ctx) -> DataFrame | None:
    """Switches without a default in functions that the change wrote, missing members that they did not miss before."""
    if not {"constant", "switch"} <= ctx.facts_there:
        return None
    s = c_switches(ctx).withColumn("at", F.struct("pair", "holder", "subject"))
    members = side(c_members(ctx), "after").select("owner", "member").distinct()
    written = ctx.live.select("pair", C("name").alias("fn")).distinct()
    b, a = (side(s, x).select("owner", C("at").alias("holder"), "member", "has_default") for x in ("before", "after"))
    edited = a.select("holder", "holder.pair", C("holder.holder").alias("fn")).distinct().join(written, ["pair", "fn"], "left_semi").select("holder")
    found = layouts.non_exhaustive(members, b, a, edited).withColumnRenamed("holder", "at")
    places = side(s, "after").groupBy("at").agg(F.min("path").alias("path"), F.min("line").alias("line"))
    return found.join(places, "at").select("owner.pair", line_text("the switch on ", C("at.subject"), " in ", F.substring_index("at.holder", "@", -1), " misses ", listed("missing"), " of ", C("owner.owner"), " and has no default").alias("message"), "path", "line")

"""Layouts, ranges and moves of data, for languages whose records have places (A10, G8, G11, J26, J27, W4, W5 and their rules).

All work on fact tables, whatever reader made them; both versions are given, and what already was so is no finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwake.functions.text import picture_digits
from driftwake.operators import graph, mining

C = F.col
SHAPE = ("offset", "size", "pic", "occurs", "redefines")


def layout_changes(before: DataFrame, after: DataFrame, shape: Sequence[str] = SHAPE, rename_is_fine: bool = True, filler: str = "FILLER") -> DataFrame:
    """copybook-layout-changed, struct-layout-change. owner, field, change (removed, added or the first of shape that differs).

    Fields are (owner, field, *shape); fillers have no name to be looked for by. A field whose shape another name has taken over in
    its place (removed and added with one shape, one of each) is renamed, which moves nothing."""
    b, a = (df.filter(C("field") != filler).select("owner", "field", F.struct(*shape).alias(s)) for df, s in ((before, "b"), (after, "a")))
    both = before.select("owner").distinct().join(after.select("owner").distinct(), "owner")
    j = b.join(a, ["owner", "field"], "full_outer").join(both, "owner", "left_semi")
    change = F.when(C("a").isNull(), F.lit("removed")).when(C("b").isNull(), F.lit("added"))
    for s in shape:
        change = change.when(~C(f"b.{s}").eqNullSafe(C(f"a.{s}")), F.lit(s))
    out = j.withColumn("change", change).filter("change IS NOT NULL")
    if rename_is_fine:
        side = lambda kind, s: out.filter(C("change") == kind).groupBy("owner", F.to_json(s).alias("was")).agg(F.count("*").alias("n"), F.min("field").alias(kind)).filter("n = 1").drop("n")
        renamed = side("removed", "b").join(side("added", "a"), ["owner", "was"]).select("owner", F.explode(F.array("removed", "added")).alias("field"))
        out = out.join(renamed, ["owner", "field"], "left_anti")
    return out.select("owner", "field", "change")


def copiers(copies: DataFrame, changed: DataFrame, programs: DataFrame) -> DataFrame:
    """G8. program, hops: programs that copy a changed book, through whatever books; copies(src, dst), changed(node), programs(node)."""
    reached = graph.reach(copies, changed, backward=True).filter("hops > 0")
    return reached.join(programs, "node", "left_semi").select(C("node").alias("program"), "hops")


def hierarchy(extends: DataFrame, start: DataFrame) -> DataFrame:
    """G9. node, hops: all subtypes of start(node); extends(cls, base)."""
    return graph.reach(extends.select(C("cls").alias("src"), C("base").alias("dst")), start, backward=True).filter("hops > 0")


def shifted_values(before: DataFrame, after: DataFrame) -> DataFrame:
    """enum-values-shifted. owner, member, was, now: members that have another value now."""
    return before.select("owner", "member", C("value").alias("was")).join(after.select("owner", "member", C("value").alias("now")), ["owner", "member"]).filter("was <> now")


def unhandled_new_members(before: DataFrame, after: DataFrame, switches: DataFrame) -> DataFrame:
    """unhandled-new-member. owner, holder, missing: switches without a default that had all old members and miss a new one.

    Sides are (owner, member); switches(owner, holder, member, has_default), as they are now."""
    old = before.select("owner", "member").distinct().withColumn("was", F.lit(True))
    members = after.select("owner", "member").distinct().join(old, ["owner", "member"], "left").withColumn("new", C("was").isNull())
    return mining.uncovered(members, switches.filter("NOT has_default"), "holder", "member", C("new"), by=["owner"])


def non_exhaustive(members: DataFrame, before: DataFrame, after: DataFrame, edited: DataFrame) -> DataFrame:
    """non-exhaustive-match. owner, holder, missing: edited switches without a default that miss members they did not miss before.

    members(owner, member) as they are now; sides are switches(owner, holder, member, has_default), edited(holder)."""
    def gaps(s: DataFrame) -> DataFrame:
        held = s.filter("NOT has_default").select("owner", "holder").distinct().join(members.select("owner", "member").distinct(), "owner")
        return held.join(s.select("owner", "holder", "member"), ["owner", "holder", "member"], "left_anti")

    new = gaps(after.join(edited, "holder", "left_semi")).join(gaps(before), ["owner", "holder", "member"], "left_anti")
    return new.groupBy("owner", "holder").agg(F.array_sort(F.collect_list("member")).alias("missing"))


def truncating_moves(moves: DataFrame, old_moves: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """J27, move-truncates. stmt, src, dst, lost, lost_before: moves of one field into one that has room for fewer digits before or
    after the point (or fewer characters), more of them lost than before; a move that is new is its writer's to look at.

    moves(stmt, src, dst); sides are (field, pic): a picture of digits such as S9(5)V99, or of characters such as X(10)."""
    one = moves.join(moves.groupBy("stmt").agg(F.count_distinct("src").alias("n")).filter("n = 1"), "stmt", "left_semi").join(old_moves, ["stmt", "src", "dst"], "left_semi").distinct()

    def room(fields: DataFrame, side: str) -> DataFrame:
        return fields.select(C("field").alias(side), capacity(C("pic")).alias(f"{side}_room"))

    def lost(fields: DataFrame, name: str) -> DataFrame:
        j = one.join(room(fields, "src"), "src").join(room(fields, "dst"), "dst")
        less = lambda part: F.greatest(C(f"src_room.{part}") - C(f"dst_room.{part}"), F.lit(0))
        same = C("src_room.text") == C("dst_room.text")
        return j.select("stmt", "src", "dst", F.when(same, less("whole") + less("fraction")).otherwise(0).alias(name))

    return lost(after, "lost").join(lost(before, "lost_before"), ["stmt", "src", "dst"]).filter("lost > lost_before")


def capacity(picture: Column) -> Column:
    """What a picture has room for: text, whole (digits before the point, or characters), fraction."""
    text = F.upper(picture).rlike("[XA]")
    digits = picture_digits(picture)
    runs = F.regexp_extract_all(F.upper(picture), F.lit(r"[XA](?:\((\d+)\))?"), F.lit(1))
    chars = F.aggregate(runs, F.lit(0), lambda acc, x: acc + F.when(x == "", 1).otherwise(x.cast("int")))
    return F.struct(text.alias("text"), F.when(text, chars).otherwise(digits["whole"]).alias("whole"), F.when(text, 0).otherwise(digits["fraction"]).alias("fraction"))


def range_changes(before: DataFrame, after: DataFrame, ranges: DataFrame) -> DataFrame:
    """W5, perform-thru-range-changed. range, lost, gained: what a range from one paragraph through another runs, now and before.

    Sides are (program, ord, name); ranges(range, program, first, last)."""
    def members(side: DataFrame, name: str) -> DataFrame:
        at = side.select("program", "ord", C("name").alias("p"))
        ends = ranges.join(at.select("program", C("p").alias("first"), C("ord").alias("a")), ["program", "first"]).join(at.select("program", C("p").alias("last"), C("ord").alias("z")), ["program", "last"])
        return ends.join(at, "program").filter("ord BETWEEN a AND z").groupBy("range").agg(F.array_sort(F.collect_list(F.struct("ord", "p"))).alias("m")).select("range", F.transform("m", lambda x: x["p"]).alias(name))

    j = members(before, "was").join(members(after, "now"), "range")
    return j.select("range", F.array_except("was", "now").alias("lost"), F.array_except("now", "was").alias("gained")).filter("size(lost) + size(gained) > 0")


def falls_into(paragraphs: DataFrame, skip: Column) -> DataFrame:
    """G11. program, name, next: the paragraph that control falls into from the end of each, past those that `skip` says are passed
    through (empty ones that the change put in)."""
    w = Window.partitionBy("program").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    return paragraphs.withColumn("next", F.first(F.when(~skip, C("name")), ignorenulls=True).over(w)).select("program", "name", "next")


def fall_through_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """W4, fall-through-changed. program, name, was, now: paragraphs in both versions that do not leave by themselves and now fall into
    another one. Sides are (program, ord, name, empty, leaves)."""
    old = before.select("program", "name", F.lit(True).alias("old"))
    marked = after.join(old, ["program", "name"], "left")
    now = falls_into(marked, C("empty") & C("old").isNull()).withColumnRenamed("next", "now")
    was = falls_into(before, F.lit(False)).withColumnRenamed("next", "was")
    open_ = after.filter("NOT leaves").select("program", "name").join(before.filter("NOT leaves").select("program", "name"), ["program", "name"])
    return was.join(now, ["program", "name"]).join(open_, ["program", "name"], "left_semi").filter(~C("was").eqNullSafe(C("now")))


def introduced(before: DataFrame, after: DataFrame) -> DataFrame:
    """legacy-construct-introduced. program, tags: constructs that a program of both versions has now and had not; sides (program, tag)."""
    new = after.join(before.select("program").distinct(), "program", "left_semi").join(before, ["program", "tag"], "left_anti")
    return new.groupBy("program").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def read_before_write(accesses: DataFrame, declared: DataFrame) -> DataFrame:
    """reads-unset-local, intent-out-read-before-write. routine, name, line: variables without a value at entry that the routine's
    first statement about them reads. accesses(routine, name, ord, line, writes), declared(routine, name)."""
    first = accesses.groupBy("routine", "name").agg(F.min_by(F.struct("writes", "line"), "ord").alias("f"))
    return first.filter("NOT f.writes").join(declared, ["routine", "name"], "left_semi").select("routine", "name", C("f.line").alias("line"))


def unreachable_statements(statements: DataFrame) -> DataFrame:
    """unreachable-statement. function, ord, line: a statement that follows one that leaves (goto, return, break, continue) in its
    block and has no label to be reached by. statements(function, block, ord, line, kind, label)."""
    w = Window.partitionBy("function", "block").orderBy("ord")
    before = statements.withColumn("above", F.lag("kind").over(w))
    return before.filter(C("above").isin("goto", "return", "break", "continue") & C("label").isNull()).select("function", "ord", "line")


def new_findings(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    """U5 for hazards: those that were not there before."""
    return after.join(before.select(*on).distinct(), list(on), "left_anti")


def layout_mismatches(before: DataFrame, after: DataFrame) -> DataFrame:
    """common-layout-mismatch. block, unit, layout, usual: units whose layout of a shared block is not the usual one, and was before
    (or the unit is new). Sides are (block, unit, layout)."""
    wrong = lambda df: mining.majority(df, ["block"], "layout", "unit").select("block", "unit", "layout", "usual")
    return new_findings(wrong(before), wrong(after), ["block", "unit"])



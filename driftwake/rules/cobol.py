"""Rules of COBOL over data and the order of procedures of both versions. Copies are opened and records laid out over all files of a
version (operators/copybooks.py); order is that of operators/paragraphs.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.operators import copybooks, graph, layouts, paragraphs
from driftwake.operators.records import line_text
from driftwake.rules.languages import SCOPE, listed, side
from driftwake.rules.registry import change_rule

C = F.col
SHAPE = ("offset", "size", "pic", "usage", "occurs", "redefines")


def book_names(ctx) -> DataFrame:
    """pair, side, book, path: files by the name that COPY gives them."""
    stem = F.upper(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    return ctx.files.filter(F.lower(C("path")).rlike(r"\.(cbl|cob|cpy|cobol|dcl)$")).select(*SCOPE, stem.alias("book"), "path")


def records(ctx) -> DataFrame:
    def make() -> DataFrame:
        return graph.cut(copybooks.laid_out(copybooks.opened(ctx.table("item"), ctx.table("copy"), book_names(ctx), SCOPE), SCOPE))

    return ctx.kept("cobol records", make)


def order(ctx) -> DataFrame:
    return ctx.kept("cobol paragraphs", lambda: graph.cut(ctx.table("paragraph")))


@change_rule("copybook-layout-changed", "critical", blocking=True, fix="build every program that copies the book again, and convert what was written with the old layout")
def copybook_layouts(ctx) -> DataFrame | None:
    """Fields of a copybook that went, moved, or became of another size, picture, usage, number or overlay, if a program copies it,
    through whatever books (G8). Fillers have no name to be missed by; a field renamed in its place is no change of layout, and one that
    comes in moves others or nothing."""
    if not {"item", "copy"} <= ctx.facts_there:
        return None
    books = records(ctx).filter(C("program").isNull()).withColumn("owner", F.struct("pair", "path"))
    b, a = (side(books, s) for s in ("before", "after"))
    diff = layouts.layout_changes(b.filter("name <> 'FILLER'"), a.filter("name <> 'FILLER'"), SHAPE, rename_is_fine=False)
    shape = [C(c) for c in SHAPE]
    came = a.join(b.select("owner", "field").distinct(), ["owner", "field"], "left_anti").select("owner", F.to_json(F.struct(*shape)).alias("shape")).distinct()
    gone = b.select("owner", "field", F.to_json(F.struct(*shape)).alias("shape")).join(came, ["owner", "shape"], "left_semi").select("owner", "field")
    diff = diff.filter("change <> 'added'").join(gone.withColumn("change", F.lit("removed")), ["owner", "field", "change"], "left_anti")
    lines = a.select("owner", "field", "line").groupBy("owner", "field").agg(F.min("line").alias("line"))
    told = diff.join(lines, ["owner", "field"], "left").groupBy("owner").agg(F.array_sort(F.collect_list(line_text(C("field"), " (", C("change"), ")"))).alias("what"), F.coalesce(F.min("line"), F.lit(1)).alias("line"))
    # who copies it: from files to the books they name, against the arrows
    named = side(ctx.table("copy").join(book_names(ctx).withColumnRenamed("path", "target"), [*SCOPE, "book"]), "after")
    arrows = named.select(F.struct("pair", "path").alias("src"), F.struct(C("pair"), C("target").alias("path")).alias("dst")).distinct()
    programs = side(ctx.table("program"), "after").select(F.struct("pair", "path").alias("node")).distinct()
    told = told.join(ctx.edited_paths.select(F.struct("pair", "path").alias("owner")), "owner", "left_semi")
    owners = told.select(C("owner").alias("node"))
    reached = copiers_of(arrows, owners, programs)
    found = told.join(reached, "owner")
    return found.select("owner.pair", line_text("layout of copybook ", C("owner.path"), ", which ", C("n"), " programs copy, changed: ", listed("what")).alias("message"), "owner.path", "line")


def copiers_of(arrows: DataFrame, owners: DataFrame, programs: DataFrame) -> DataFrame:
    """owner, n: how many programs copy each of owners(node), in rounds over what the last one found."""
    front = graph.cut_in_loop(owners.select(C("node").alias("owner"), "node").distinct())
    known = front
    while True:
        new = front.join(arrows.select(C("dst").alias("node"), "src"), "node").select("owner", C("src").alias("node")).distinct().join(known, ["owner", "node"], "left_anti")
        front = graph.cut_in_loop(new)
        if not front.head(1):
            break
        known = graph.cut_in_loop(known.unionByName(front))
    return known.join(programs, "node", "left_semi").groupBy("owner").agg(F.count("*").alias("n"))


@change_rule("move-truncates", "high", blocking=True, fix="widen the field that receives, or see that the value fits")
def truncations(ctx) -> DataFrame | None:
    """J27. Moves that stood there before, of one field into another of its program, that lose more leading digits than they did; or
    characters, which they did not lose before (to take the head of a text is a way to write)."""
    if not {"move", "item"} <= ctx.facts_there:
        return None
    fields = records(ctx).filter(C("program").isNotNull()).groupBy(*SCOPE, "program", "name").agg(F.count("*").alias("n"), F.min(F.struct("kind", F.when(C("kind") == "digits", C("whole").cast("long")).otherwise(C("size")).alias("room"))).alias("f")).filter("n = 1")
    fields = fields.select(*SCOPE, "program", "name", F.when(C("f.kind") == "digits", "digits").otherwise("bytes").alias("unit"), "f.room")
    moves = ctx.table("move").groupBy(*SCOPE, "program", "src", "dst").agg(F.min(F.struct("path", "line")).alias("site"))
    room = lambda which, c: side(fields, which).select("pair", "program", C("name").alias(c), C("unit").alias(f"{c}_unit"), C("room").alias(f"{c}_room"))

    def lost(which: str, name: str) -> DataFrame:
        j = side(moves, which).join(room(which, "src"), ["pair", "program", "src"]).join(room(which, "dst"), ["pair", "program", "dst"])
        return j.select("pair", "program", "src", "dst", "site", C("src_unit").alias(f"{name}_unit"), F.when(C("src_unit") == C("dst_unit"), F.greatest(C("src_room") - C("dst_room"), F.lit(0))).otherwise(0).alias(name))

    j = lost("after", "lost").join(lost("before", "was").drop("site"), ["pair", "program", "src", "dst"])
    found = j.filter((C("lost") > C("was")) & ((C("was") == 0) | (C("lost_unit") == "digits")))
    what = F.when(C("lost_unit") == "digits", " leading digits").otherwise(" trailing characters")
    return found.select("pair", line_text("MOVE ", C("src"), " TO ", C("dst"), " in ", C("program"), " drops ", C("lost"), what, F.when(C("was") > 0, line_text(", was ", C("was"))).otherwise("")).alias("message"), "site.path", "site.line")


@change_rule("call-using-mismatch", "critical", blocking=True, fix="pass what the called program's linkage takes")
def mismatches(ctx) -> DataFrame | None:
    """J28. Calls whose number of arguments is not what the program takes, or that hand over by reference less than it lays over it, and
    did not before. Of a program whose parameters changed signature-break tells every call."""
    if not {"call", "program"} <= ctx.facts_there:
        return None
    sizes = records(ctx).filter(C("program").isNotNull()).groupBy(*SCOPE, "program", "name").agg(F.count("*").alias("n"), F.min("size").alias("size")).filter("n = 1").drop("n")
    calls = ctx.table("call").join(ctx.table("program").select(*SCOPE, C("program").alias("callee")).distinct(), [*SCOPE, "callee"])
    site = ["pair", "side", "program", "paragraph", "callee", "ord"]
    given = ctx.table("passed")
    taken = ctx.table("taken")
    counts = calls.join(given.groupBy(*site).agg(F.max("position").alias("given")), site, "left").join(taken.groupBy(*SCOPE, C("program").alias("callee")).agg(F.count("*").alias("takes")), [*SCOPE, "callee"], "left")
    g, t = F.coalesce("given", F.lit(0)), F.coalesce("takes", F.lit(0))
    wrong = counts.filter(g != t).select(*site, "path", "line", F.lit("count").alias("what"), line_text("passes ", g, " arguments, it takes ", t).alias("said"))
    want = taken.join(sizes, [*SCOPE, "program", "name"]).select(*SCOPE, C("program").alias("callee"), "position", C("name").alias("wants"), C("size").alias("least"))
    have = given.filter("by = 'REFERENCE' AND item IS NOT NULL").join(sizes.withColumnRenamed("name", "item"), [*SCOPE, "program", "item"])
    short = have.join(want, [*SCOPE, "callee", "position"]).filter("size < least")
    wrong = wrong.unionByName(short.select(*site, "path", "line", line_text("size", C("position")).alias("what"), line_text(C("item"), " of ", C("size"), " bytes for ", C("wants"), " of ", C("least")).alias("said")))
    changed = ctx.changes.filter("kind = 'signature' AND name LIKE 'cobol@%'").select("pair", F.expr("substring(name, 7)").alias("callee"))
    key = ["pair", "program", "paragraph", "callee", "what"]
    new = side(wrong, "after").join(side(wrong, "before").select(*key).distinct(), key, "left_anti").join(changed, ["pair", "callee"], "left_anti")
    told = new.groupBy("pair", "program", "callee", "path", "line").agg(F.array_sort(F.collect_set("said")).alias("why"))
    return told.select("pair", line_text("CALL ", C("callee"), " in ", C("program"), ": ", listed("why")).alias("message"), "path", "line")


@change_rule("perform-thru-range-changed", "high", blocking=True, fix="look at every PERFORM ... THRU over what came or went")
def thru_ranges(ctx) -> DataFrame | None:
    """W5. Ranges of both versions that run a paragraph more (empty ones apart) or one less; order alone is fall-through's to tell."""
    if not {"paragraph", "performs"} <= ctx.facts_there:
        return None
    found = paragraphs.ranges(order(ctx), ctx.table("performs"), SCOPE)
    diff = paragraphs.changed_ranges(side(found, "before"), side(found, "after"), ["pair"])
    what = F.concat_ws(" and ", F.when(F.size("joined") > 0, line_text("now also runs ", listed("joined"))), F.when(F.size("left") > 0, line_text("no longer runs ", listed("left"))))
    return diff.select("pair", line_text("PERFORM ", C("first"), " THRU ", C("last"), " ", what).alias("message"), "path", "line")


@change_rule("fall-through-changed", "medium", fix="look at the paragraphs that control falls into now")
def fall_through(ctx) -> DataFrame | None:
    """W4, G11. Paragraphs of both versions that now run off their end into another one."""
    if "paragraph" not in ctx.facts_there:
        return None
    all_, performs, jumps = order(ctx), ctx.table("performs"), ctx.table("jump")
    found = paragraphs.falls(all_, performs, jumps, SCOPE)
    named = all_.filter("name <> ''")
    diff = paragraphs.changed_falls(side(found, "before"), side(found, "after"), side(named, "before"), side(named, "after"), ["pair"])
    was = F.when(C("was").isNotNull(), line_text(", was ", C("was"))).otherwise(", was none")
    return diff.filter("name <> ''").select("pair", line_text(C("program"), ".", C("name"), " now falls through into ", C("next"), was).alias("message"), "path", "line")


@change_rule("legacy-construct-introduced", "low", fix="say it with EVALUATE, PERFORM or inline code")
def introduced(ctx) -> DataFrame | None:
    """Constructs on their way out that a paragraph has and had not, told once a program. GO TO an exit is not counted."""
    if "paragraph" not in ctx.facts_there:
        return None
    only_exits = ctx.table("jump").groupBy(*SCOPE, "program", "paragraph").agg(F.min(C("target").contains("EXIT")).alias("exits")).filter("exits").select(*SCOPE, "program", C("paragraph").alias("name"), F.lit("GO TO").alias("tag"))
    tags = order(ctx).select(*SCOPE, "program", "name", "path", "line", F.explode("tags").alias("tag"))
    new = side(tags, "after").join(side(only_exits, "after"), ["pair", "program", "name", "tag"], "left_anti").join(side(tags, "before").select("pair", "program", "name", "tag").distinct(), ["pair", "program", "name", "tag"], "left_anti")
    told = new.groupBy("pair", "program").agg(F.array_sort(F.collect_set("tag")).alias("what"), F.min(F.struct("path", "line")).alias("at"), F.count_distinct("name").alias("n"))
    return told.select("pair", line_text(C("program"), " gains ", listed("what"), " in ", C("n"), " paragraphs").alias("message"), "at.path", "at.line")

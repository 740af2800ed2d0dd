"""Nodes and edges of several languages in one graph: differences, moves, what still refers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwake.operators import graph
from driftwake.operators.changes import unique_pairs

C = F.col


def node_changes(before: DataFrame, after: DataFrame, plumbing: Sequence[str] = ("file", "import")) -> DataFrame:
    """J30. id, change: a row a way in which a node differs, of several that it may have. Nodes are (id, parent, kind, signature,
    decorators, value, body, doc); what went with its parent is told of once, with the parent."""
    b, a = (df.filter(~C("kind").isin(*plumbing)).alias(s) for df, s in ((before, "b"), (after, "a")))
    j = b.join(a, C("b.id") == C("a.id"), "full_outer")
    gone, new = C("a.id").isNull(), C("b.id").isNull()
    ways = [F.when(~gone & ~new & ~C(f"b.{c}").eqNullSafe(C(f"a.{c}")), F.lit(c)) for c in ("signature", "decorators", "value", "body", "doc")]
    change = F.array_compact(F.array(F.when(gone, F.lit("removed")), F.when(new, F.lit("added")), *ways))
    out = j.select(F.coalesce("b.id", "a.id").alias("id"), C("b.parent").alias("parent"), F.explode(change).alias("change"))
    lost = out.filter("change = 'removed'").select(C("id").alias("parent"), F.lit(True).alias("with"))
    return out.join(lost, "parent", "left").filter("NOT (change = 'removed' AND with IS NOT NULL)").select("id", "change")


def moves(gone: DataFrame, new: DataFrame, rounds: int = 10) -> DataFrame:
    """J4. old, new, stage: nodes that went and came under another id, by ever weaker signs, each only where it fits one of either
    side: the symbol; name and body; the body alone (nothing trivial); then members by name of what moved, layer by layer.

    Sides are (id, parent, kind, name, symbol, body, trivial)."""
    g, n = graph.cut(gone), graph.cut(new)
    out = None
    signs = [(1, ["kind", "symbol"], "symbol IS NOT NULL"), (2, ["kind", "name", "body"], "body IS NOT NULL"), (3, ["kind", "body"], "body IS NOT NULL AND NOT trivial")]

    def take(pairs: DataFrame, stage: int) -> bool:
        nonlocal g, n, out
        found = graph.cut(pairs.select(C("old_key").alias("old"), C("new_key").alias("new"), F.lit(stage).alias("stage")))
        if not found.head(1):
            return False
        out = found if out is None else out.unionByName(found)
        g, n = g.join(found.select(C("old").alias("id")), "id", "left_anti"), n.join(found.select(C("new").alias("id")), "id", "left_anti")
        return True

    for stage, match, condition in signs:
        take(unique_pairs(g.filter(condition), n.filter(condition), match, "id"), stage)
    for _ in range(rounds):
        if out is None:
            break
        under = out.select(C("old").alias("parent"), F.concat(F.lit("m:"), "old").alias("moved"))
        there = out.select(C("new").alias("parent"), F.concat(F.lit("m:"), "old").alias("moved"))
        if not take(unique_pairs(g.join(under, "parent"), n.join(there, "parent"), ["moved", "kind", "name"], "id"), 4):
            break
    return out if out is not None else gone.sparkSession.createDataFrame([], f"old {gone.schema['id'].dataType.simpleString()}, new {gone.schema['id'].dataType.simpleString()}, stage int")


def surviving_references(old_edges: DataFrame, removed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """J14. src, dst, line: references to what went that still stand: the one who refers is there, did not go too, is not inside what
    went, does not have the name otherwise now, and is unedited or still says the name.

    old_edges(src, dst, line), removed(id, name), sides (id, parent, name, body, text)."""
    was = before.select(C("id").alias("src"), C("body").alias("was"))
    now = after.select(C("id").alias("src"), C("body").alias("now"), C("text").alias("said"), C("parent").alias("in"))
    again = after.select(C("name").alias("short"), C("parent").alias("in")).distinct()
    e = old_edges.join(removed.select(C("id").alias("dst"), C("name").alias("short")), "dst").filter("src <> dst")
    e = e.join(was, "src").join(now, "src").join(removed.select(C("id").alias("in")), "in", "left_anti").join(again, ["short", "in"], "left_anti")
    names = F.regexp_extract_all("said", F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    return e.filter((C("was") == C("now")) | F.array_contains(names, C("short"))).select("src", "dst", "line").distinct()


def copied_as_reads(imports: DataFrame) -> DataFrame:
    """J18. A program that copies a book reads it: src, dst, kind, line (0 where it is not known)."""
    return imports.filter("kind = 'copy'").select("src", "dst", F.lit("reads").alias("kind"), F.coalesce("line", F.lit(0)).alias("line")).distinct()


def missing_implementations(new_abstract: DataFrame, subtypes: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """J32. cls, method: concrete subtypes of a class with a new abstract method that neither have it nor get it from a class between.

    new_abstract(base, method), subtypes(base, cls), classes(cls, abstract), methods(cls, method, abstract)."""
    due = new_abstract.join(subtypes, "base").join(classes.filter("NOT abstract").select("cls"), "cls").select("cls", "base", "method")
    real = methods.filter("NOT abstract").select(C("cls").alias("by"), "method")
    above = subtypes.select(C("base").alias("by"), "cls").unionByName(classes.select(C("cls").alias("by"), "cls"))
    has = above.join(real, "by").select("cls", "method").distinct()
    return due.join(has, ["cls", "method"], "left_anti").select("cls", "method").distinct()


def flag_flips(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """J33. id, reason, user: who is hit by a class or method that became final, abstract or (no longer) static.

    Sides are (id, final, abstract, static), edges (src, dst, kind of extends, overrides, instantiates, calls)."""
    o = before.select("id", *(C(c).alias(f"was_{c}") for c in ("final", "abstract", "static")))
    j = after.join(o, "id").join(edges.select(C("dst").alias("id"), C("src").alias("user"), C("kind").alias("how")), "id")
    reason = (
        F.when(C("final") & ~C("was_final") & C("how").isin("extends", "overrides"), "became final")
        .when(C("abstract") & ~C("was_abstract") & (C("how") == "instantiates"), "became abstract")
        .when((C("static") != C("was_static")) & (C("how") == "calls"), "changed between static and not")
    )
    return j.withColumn("reason", reason).filter("reason IS NOT NULL").select("id", "reason", "user").distinct()


LEVELS = ("private", "package", "protected", "public")


def narrowed(before: DataFrame, after: DataFrame, edges: DataFrame, subtypes: DataFrame) -> DataFrame:
    """J34. id, user: who refers to a member from outside what it narrowed to: its top class, its package, or its package and
    subtypes. Sides are (id, owner, top, package, visibility), edges (src, dst), subtypes (base, cls)."""
    level = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c)
    o = before.select("id", level(C("visibility")).alias("was"))
    n = after.join(o, "id").filter(level(C("visibility")) < C("was")).select(C("id").alias("dst"), C("owner").alias("base"), "top", "package", "visibility")
    who = after.select(C("id").alias("src"), C("owner").alias("cls"), C("top").alias("from_top"), C("package").alias("from_package"))
    j = edges.select("src", "dst").join(n, "dst").join(who, "src").join(subtypes.withColumn("kin", F.lit(True)), ["base", "cls"], "left")
    out = F.when(C("visibility") == "private", C("top") != C("from_top")).when(C("visibility") == "package", C("package") != C("from_package")).otherwise((C("package") != C("from_package")) & C("kin").isNull())
    return j.filter(out).select(C("dst").alias("id"), C("src").alias("user")).distinct()


def no_longer_permitted(before: DataFrame, after: DataFrame, extends: DataFrame) -> DataFrame:
    """J35. cls, base: subtypes that a sealed type no longer permits; sides are (base, permits)."""
    lost = before.select("base", C("permits").alias("was")).join(after, "base").select("base", F.explode(F.array_except("was", "permits")).alias("cls"))
    return extends.select("cls", "base").join(lost, ["cls", "base"]).distinct()


def lost_overrides(old: DataFrame, new: DataFrame, methods: DataFrame) -> DataFrame:
    """J36. method, was: methods that overrode something, are there, and override nothing now."""
    still = old.join(methods.select("method"), "method", "left_semi")
    return still.join(new.select("method"), "method", "left_anti").select("method", C("base_method").alias("was")).distinct()


def users_of_changed_fields(before: DataFrame, after: DataFrame, uses: DataFrame, edited: DataFrame) -> DataFrame:
    """J37. owner, field, path, line: unedited uses of fields whose type or place changed; by place only where fields are given in order.

    Sides are (owner, field, type, pos), uses (owner, field, path, line, by_place), edited (path)."""
    j = before.select("owner", "field", C("type").alias("t"), C("pos").alias("p")).join(after, ["owner", "field"])
    hit = j.filter("t <> type OR p <> pos").select("owner", "field", (C("t") != C("type")).alias("retyped"))
    out = uses.join(hit, ["owner", "field"]).filter("retyped OR by_place").join(edited, "path", "left_anti")
    return out.select("owner", "field", "path", "line").distinct()


def prototype_mismatches(prototypes: DataFrame, definitions: DataFrame) -> DataFrame:
    """J37. name, declared, defined: prototypes that say something else than the one definition of the name."""
    one = definitions.groupBy("name").agg(F.count("*").alias("n"), F.min("signature").alias("defined")).filter("n = 1")
    return prototypes.join(one, "name").filter("signature <> defined").select("name", "path", C("signature").alias("declared"), "defined")


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """U8. The first row of each key in the order given (dropDuplicates has none)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def degrees(edges: DataFrame) -> DataFrame:
    """A9. node, degree: edges in and out."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A14. what (node, edge), kind, n: the most common first."""
    n = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n")).orderBy("what", F.desc("n"), "kind")


def weighted(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """G15. Edges with the weight of their kind each way (forward, reverse); a kind that is not in the table weighs nothing.
    weights(kind, forward, reverse) is a dimension of a row a kind."""
    return edges.join(weights, "kind", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("forward", "reverse")})

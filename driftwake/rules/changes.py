"""Rules of a change: they see both versions. All keys hold `pair`, so any number of pairs of versions goes through one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwake.functions.text import is_test_path, module_name, shingles, tokens
from driftwake.operators import graph, mining, resolve
from driftwake.rules import files as single
from driftwake.rules import flows
from driftwake.rules.registry import change_rule
from driftwake.values import GUARDS

NEAR_TOKENS, NEAR_LEAST, NEAR_RATIO, NEAR_SHINGLE = 30, 0.82, 0.6, 4
DEPTH = 6  # calls that a cost is followed through
C = F.col


def contract(p: Column, bound: Column, n: Column, keywords: Column) -> Column:
    """P12 for a params struct; seen through an instance, the first parameter is filled already."""
    shift = (bound & p["binds_first"] & (F.size(p["positional"]) > 0)).cast("int")
    size = F.size(p["positional"])
    positional = F.slice(p["positional"], shift + 1, F.greatest(size - shift, F.lit(0)))
    return resolve.contract_problems(positional, F.least(p["defaults"], size - shift), F.greatest(p["positional_only"] - shift, F.lit(0)), p["varargs"], p["keyword_only"], p["keyword_required"], p["varkw"], n, keywords)


@change_rule("signature-break", "critical", blocking=True, fix="pass what the new signature asks for")
def signature_breaks(ctx) -> DataFrame | None:
    """J12. Calls that fit the old signature and do not fit the new one, one a line."""
    if "signature" not in ctx.kinds:
        return None
    c = ctx.changes.filter("kind = 'signature' AND before.params IS NOT NULL AND after.params IS NOT NULL").select("pair", C("name").alias("dst"), "before", "after")
    e = ctx.edges.filter("side = 'after' AND kind = 'calls' AND NOT unpacked AND NOT guess").select("pair", "src", "dst", "path", "line", "bound", "positional", "keywords")
    j = e.join(c, ["pair", "dst"])
    now, was = (contract(C(s)["params"], C("bound"), C("positional"), C("keywords")) for s in ("after", "before"))
    said = F.concat("src", F.lit(" calls "), "dst", F.lit(" the old way: it now "), F.get(now, F.lit(0)))
    return j.filter((F.size(now) > 0) & (F.size(was) == 0)).groupBy("pair", "path", "line").agg(F.min(said).alias("message"))


@change_rule("removed-still-referenced", "critical", blocking=True, fix="take the use out, or bring the definition back")
def removed_uses(ctx) -> DataFrame | None:
    """J13. Code that still names what went."""
    if not ctx.kinds & {"removed", "renamed"}:
        return None
    gone = ctx.changes.filter("kind IN ('removed', 'renamed')").select("pair", F.coalesce("old_name", "name").alias("dst")).join(ctx.defs_of("after").select("pair", C("name").alias("dst")), ["pair", "dst"], "left_anti").distinct()
    used = ctx.edges.filter("side = 'after'").select("pair", "dst", "path", "line", F.concat("src", F.lit(" still "), "kind", F.lit(" "), "dst").alias("message"))
    imported = ctx.imports.select("pair", C("target").alias("dst"), "path", "line", F.concat("path", F.lit(" still imports "), "target").alias("message"))
    return used.unionByName(imported).join(gone, ["pair", "dst"]).groupBy("pair", "path", "line").agg(F.min("message").alias("message"))


@change_rule("undefined-name", "critical", blocking=True, fix="define or import it")
def undefined(ctx) -> DataFrame | None:
    """Names that nothing defines now and that were not missing before (U5); where the old version could not be known, nothing
    is. High if only a function asks, critical if loading the module does. Lines that name what went are told of already."""
    if "asked" not in ctx.news:
        return None
    keys = ["pair", "side", "path"]
    opaque = ctx.table("opaque").select(*keys)
    missing = single.missing_names(ctx.table("asked"), ctx.table("given"), opaque, keys)
    before = missing.filter("side = 'before'").select("pair", "path", "name").distinct()
    unknown = opaque.unionByName(ctx.errors_of_files.select(*keys)).filter("side = 'before'").select("pair", "path").distinct()
    new = missing.filter("side = 'after'").join(before, ["pair", "path", "name"], "left_anti").join(unknown, ["pair", "path"], "left_anti")
    told = removed_uses(ctx)
    if told is not None:
        new = new.join(told.select("pair", "path", "line"), ["pair", "path", "line"], "left_anti")
    return new.select("pair", "path", "line", F.when(C("deferred"), "high").otherwise("critical").alias("severity"), F.concat(F.lit("nothing defines "), "name").alias("message"))


@change_rule("reused-value", "high", fix="take a value that nothing else has had")
def reused_values(ctx) -> DataFrame | None:
    """J25. A constant went or changed, and a new one of its scope takes over its literal value and type, with other readers."""
    if "added" not in ctx.kinds or not ctx.kinds & {"removed", "value"}:
        return None
    scope = F.regexp_replace("name", r"\.[^.]*$", "")
    lost = ctx.changes.filter("kind IN ('removed', 'value') AND before.kind = 'constant' AND before.value_type <> 'expr'").select("pair", scope.alias("scope"), C("name").alias("old"), C("before.value").alias("value"), C("before.value_type").alias("type"))
    got = ctx.changes.filter("kind = 'added' AND after.kind = 'constant'").select("pair", scope.alias("scope"), C("name").alias("new"), C("after.value").alias("value"), C("after.value_type").alias("type"), "path", "line")
    readers = lambda side, c: ctx.edges.filter((C("side") == side) & (C("kind") == "reads")).groupBy("pair", C("dst").alias(c)).agg(F.array_sort(F.collect_set("src")).alias(f"{c}_readers"))
    j = lost.join(got, ["pair", "scope", "value", "type"]).join(readers("before", "old"), ["pair", "old"]).join(readers("after", "new"), ["pair", "new"])
    return j.select("pair", F.concat("new", F.lit(" takes over the value that "), "old", F.lit(" had: "), "value").alias("message"), "path", "line")


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("side = 'before'").drop("side"), df.filter("side = 'after'").drop("side")


@change_rule("env-var-renamed", "high", fix="set the new variable wherever the old one was set")
def environment_renamed(ctx) -> DataFrame | None:
    """J24. A reader that lost one variable and gained one."""
    if "env" not in ctx.facts_there:
        return None
    b, a = (x.withColumn("holder", F.struct("pair", "reader")) for x in sides(ctx.table("env")))
    at = a.groupBy("pair", "reader", C("var").alias("gained")).agg(F.min(F.struct("path", "line")).alias("at"))
    moved = mining.lost_and_gained(b, a, "holder", "var").select("holder.pair", "holder.reader", "lost", "gained").join(at, ["pair", "reader", "gained"])
    return moved.select("pair", F.concat("reader", F.lit(" reads "), "gained", F.lit(" where it read "), "lost").alias("message"), "at.path", "at.line")


@change_rule("env-var-default-changed", "medium", fix="say so wherever the default is relied on")
def environment_default(ctx) -> DataFrame | None:
    """A11. One way to read it before, another one now; a variable that became optional is no news."""
    if "env" not in ctx.facts_there:
        return None
    told = ctx.table("env").withColumn("shape", F.concat_ws("|", C("required").cast("string"), F.coalesce("default", F.lit("nothing"))))
    b, a = sides(told)
    at = a.groupBy("pair", "reader", "var").agg(F.min(F.struct("path", "line")).alias("at"))
    moved = mining.single_variant_change(b, a, ["pair", "reader", "var"], "shape").filter("NOT (old LIKE 'true%' AND new LIKE 'false%')").join(at, ["pair", "reader", "var"])
    return moved.select("pair", F.concat("var", F.lit(": "), "old", F.lit(" became "), "new").alias("message"), "at.path", "at.line")


def rings(ctx, both: DataFrame) -> DataFrame:
    """both(pair, side, src, dst) -> pair, component, node, ring, old (the node's component before, or null): components of the
    new version's graph, only of pairs that have an edge which they had not."""
    fresh = both.filter("side = 'after'").select("pair", "src", "dst").join(both.filter("side = 'before'").select("pair", "src", "dst"), ["pair", "src", "dst"], "left_anti")
    busy = graph.cut(fresh.select("pair").distinct())
    if not busy.head(1):
        return None
    e = graph.cut(both.join(busy, "pair").select(F.struct("pair", "side", C("src").alias("n")).alias("src"), F.struct("pair", "side", C("dst").alias("n")).alias("dst")).distinct())
    found = graph.cycles(e)
    now = found.filter("node.side = 'after'").select("node.pair", C("component.n").alias("component"), C("node.n").alias("node"))
    was = found.filter("node.side = 'before'").select("node.pair", C("component.n").alias("old"), C("node.n").alias("node"))
    heads = now.groupBy("pair", "component").agg(F.min("node").alias("n")).select(F.struct("pair", F.lit("after").alias("side"), "n").alias("node"))
    inside = e.join(found.select(C("node").alias("src"), C("component").alias("c")), "src").join(found.select(C("node").alias("dst"), C("component").alias("d")), "dst").filter("c = d")
    way = graph.shortest_rings(inside.select("src", "dst"), heads).select("node.pair", C("node.n").alias("component"), F.concat_ws(" -> ", F.transform("ring", lambda x: x["n"])).alias("ring"))
    return now.join(was, ["pair", "node"], "left").join(way, ["pair", "component"], "left")


@change_rule("import-cycle", "medium", fix="move what both need to a third module, or import inside the function")
def import_cycles(ctx) -> DataFrame | None:
    """G5. Modules that load each other in the new version: not all of one old circle, at least one of the imports naming
    something of the module, and a new import in an edited file."""
    if "import" not in ctx.news:
        return None
    mods = ctx.files.select("pair", "side", "path").filter(C("path").endswith(".py")).withColumn("module", module_name(C("path")))
    load = ctx.table("import").filter("NOT late").join(mods, ["pair", "side", "path"]).withColumnRenamed("module", "src")
    load = load.select("pair", "side", "path", "line", "plain", "src", F.explode(F.array("target", F.regexp_replace("target", r"\.[^.]*$", ""))).alias("dst"))
    load = load.join(mods.select("pair", "side", C("module").alias("dst")), ["pair", "side", "dst"]).filter("src <> dst")
    load = graph.cut(load)
    found = rings(ctx, load.select("pair", "side", "src", "dst").distinct())
    if found is None:
        return None
    found = graph.cut(found)
    b, a = sides(load)
    inside = a.join(found.select("pair", C("node").alias("src"), "component"), ["pair", "src"]).join(found.select("pair", C("node").alias("dst"), C("component").alias("d")), ["pair", "dst"]).filter("component = d")
    inside = inside.join(b.select("pair", "src", "dst", F.lit(True).alias("old_edge")).distinct(), ["pair", "src", "dst"], "left").join(ctx.edited_paths.withColumn("edited", F.lit(True)), ["pair", "path"], "left")
    new = C("old_edge").isNull() & C("edited")
    told = inside.groupBy("pair", "component").agg(F.bool_or(~C("plain")).alias("named"), F.min(F.when(new, F.struct("path", "line"))).alias("at"))
    groups = found.groupBy("pair", "component").agg(F.countDistinct("old").alias("olds"), F.count("old").alias("known"), F.count("*").alias("n"), F.array_sort(F.collect_set("node")).alias("nodes"), F.first("ring").alias("ring"))
    out = groups.join(told, ["pair", "component"]).filter("named AND at IS NOT NULL AND NOT (olds = 1 AND known = n)")
    return out.select("pair", F.concat(F.lit("these load each other: "), F.coalesce("ring", F.concat_ws(", ", "nodes"))).alias("message"), "at.path", "at.line")


@change_rule("recursive-cycle", "medium", blocking=True, fix="give the recursion an end")
def call_circles(ctx) -> DataFrame | None:
    """G4, G6. Functions that call each other in a circle, at least two of them there before and not all in one old circle;
    quiet where a parameter's name or a cache bounds it, or each call passes a smaller piece of what it was given. And functions that
    call themselves on every path, which the reader tells of (high), if they did not before."""
    alone = None
    if "recursive-cycle" in ctx.read_rules:
        b, a = sides(ctx.found_by_reader.filter("rule = 'recursive-cycle'"))
        alone = a.join(b.select("pair", "message").distinct(), ["pair", "message"], "left_anti").select("pair", "severity", "message", "path", "line")
    if "call" not in ctx.news:
        return alone
    calls = ctx.edges.filter("kind = 'calls' AND NOT guess")
    found = rings(ctx, calls.select("pair", "side", "src", "dst").distinct())
    if found is None:
        return alone
    found = graph.cut(found)
    defs = ctx.table("def").filter("kind IN ('function', 'method')")
    names = F.concat(C("params.positional"), C("params.keyword_only"))
    bounded = F.exists(names, lambda p: reduce(lambda x, y: x | y, (F.contains(F.lower(p), F.lit(g)) for g in GUARDS)))
    about = defs.filter("side = 'after'").select("pair", C("name").alias("node"), bounded.alias("bounded"), "decorated")
    there = defs.filter("side = 'before'").select("pair", C("name").alias("node"), F.lit(1).alias("there"))
    inside = calls.filter("side = 'after'").join(found.select("pair", C("node").alias("src"), "component"), ["pair", "src"]).join(found.select("pair", C("node").alias("dst"), C("component").alias("d")), ["pair", "dst"]).filter("component = d")
    told = inside.groupBy("pair", "component").agg(F.bool_and("smaller").alias("smaller"), F.min(F.struct("path", "line")).alias("at"))
    groups = found.join(about, ["pair", "node"], "left").join(there, ["pair", "node"], "left").groupBy("pair", "component").agg(
        F.count("there").alias("there"), F.bool_or(F.coalesce("bounded", F.lit(False)) | F.coalesce("decorated", F.lit(False))).alias("bounded"), F.countDistinct("old").alias("olds"), F.count("old").alias("known"),
        F.count("*").alias("n"), F.first("ring").alias("ring"), F.array_sort(F.collect_set("node")).alias("nodes"))
    out = groups.join(told, ["pair", "component"]).filter("there >= 2 AND NOT bounded AND NOT smaller AND NOT (olds = 1 AND known = n)")
    circle = out.select("pair", F.lit("medium").alias("severity"), F.concat(F.lit("these call each other: "), F.coalesce("ring", F.concat_ws(", ", "nodes"))).alias("message"), "at.path", "at.line")
    return circle if alone is None else alone.unionByName(circle)


@change_rule("near-duplicate", "low", fix="call the one that is there")
def near_duplicates(ctx) -> DataFrame | None:
    """F8. Added functions that are nearly another one; the best match of each, each pair once. Names that are alike on purpose
    (dunder methods, visitors, tests) and equal names are left alone."""
    if "added" not in ctx.kinds:
        return None
    short = F.substring_index("name", ".", -1)
    added = ctx.changes.filter("kind = 'added'").select("pair", "name")
    t = ctx.table("tokens").filter((C("side") == "after") & (F.size("tokens") >= NEAR_TOKENS) & ~is_test_path(C("path"))).withColumn("short", short)
    t = t.filter(~C("short").rlike(r"^(__\w+__|visit_\w+|test_\w+)$")).withColumn("key", F.struct("pair", "name"))
    busy = t.join(added.select("pair").distinct(), "pair", "left_semi")
    classes, links = mining.similar_classes(busy.select("key", "pair", shingles(C("tokens"), NEAR_SHINGLE).alias("s")), "key", "s", NEAR_LEAST, NEAR_RATIO, by=["pair"])
    both = links.unionByName(links.select(C("b").alias("a"), C("a").alias("b"), "similarity"))
    near = classes.join(both, C("class") == C("a")).select("key", C("b").alias("other"), "similarity")
    # within a class each is equal to the first, and the first to the second
    second = classes.filter(C("key") != C("class")).groupBy("class").agg(F.min("key").alias("second"))
    equal = classes.join(second, "class").select("key", F.when(C("key") == C("class"), C("second")).otherwise(C("class")).alias("other"), F.lit(1.0).alias("similarity"))
    both = near.unionByName(equal).select("key.pair", C("key.name").alias("name"), C("other.name").alias("other"), "similarity")
    best = both.join(added, ["pair", "name"], "left_semi").filter(short != F.substring_index("other", ".", -1)).groupBy("pair", "name").agg(F.max_by("other", F.struct("similarity", "other")).alias("other"))
    once = best.groupBy("pair", F.least("name", "other"), F.greatest("name", "other")).agg(F.min("name").alias("name"), F.max_by("other", "name").alias("other"))
    return once.select("pair", "name", "other").join(t.select("pair", "name", "path", "line"), ["pair", "name"]).select("pair", F.concat("name", F.lit(" nearly repeats "), "other").alias("message"), "path", "line")


@change_rule("new-unreferenced", "low", fix="call it where it was meant to be, or delete it")
def unreferenced(ctx) -> DataFrame | None:
    """New private functions that no other line of code names (A5); quiet if decorated, if a text of its file is the beginning of
    its name (dispatch by prefix), or, for a method, if its class has a base from outside."""
    if "added" not in ctx.kinds:
        return None
    after = ctx.defs_of("after")
    own = after.filter("kind IN ('function', 'method') AND NOT decorated").withColumn("word", F.substring_index("name", ".", -1)).filter(C("word").rlike("^_[^_]"))
    new = own.join(ctx.changes.filter("kind = 'added'").select("pair", "name"), ["pair", "name"], "left_semi").select("pair", "name", "word", "kind", "path", "line", "end_line")
    words = ctx.files.filter("side = 'after'").select("pair", "path", F.posexplode(F.split("text", "\n")).alias("at", "row")).select("pair", C("path").alias("of"), (C("at") + 1).alias("at"), F.explode(F.array_distinct(tokens(C("row")))).alias("word"))
    named = words.join(new, ["pair", "word"]).filter(~((C("of") == C("path")) & C("at").between(C("line"), C("end_line")))).select("pair", "name").distinct()
    prefixes = ctx.files.filter("side = 'after'").select("pair", "path", F.explode(F.regexp_extract_all("text", F.lit(r"""['"](_\w{2,38})['"]"""), F.lit(1))).alias("start"))
    spoken = new.join(prefixes, ["pair", "path"]).filter(C("word").startswith(C("start")) & (C("word") != C("start"))).select("pair", "name").distinct()
    classes = after.filter("kind = 'class'")
    inner = classes.select("pair", F.substring_index("name", ".", -1).alias("base"))
    bases = classes.select("pair", C("name").alias("cls"), F.explode("bases").alias("b")).withColumn("base", F.substring_index("b", ".", -1)).filter(~C("base").isin("object", "Generic", "Protocol", "ABC"))
    foreign = bases.join(inner, ["pair", "base"], "left_anti").select("pair", "cls").distinct()
    new = new.join(named, ["pair", "name"], "left_anti").join(spoken, ["pair", "name"], "left_anti").withColumn("cls", F.regexp_replace("name", r"\.[^.]*$", ""))
    return new.join(foreign, ["pair", "cls"], "left_anti").select("pair", F.concat(F.lit("nothing uses "), "name").alias("message"), "path", "line")


def _dependencies(ctx, which: str) -> DataFrame | None:
    from driftwake.sources import manifests

    if not ctx.has_manifest:
        return None
    modules = ctx.files.filter(C("path").endswith(".py")).select("pair", module_name(C("path")).alias("module")).distinct()
    out = manifests.findings(manifests.third_party(ctx.table("import").filter("NOT guarded"), modules), ctx.manifests)
    return out.filter(C("rule") == which).select("pair", "severity", "message", "path", "line")


@change_rule("dependency-undeclared", "high", fix="declare it")
def dependency_undeclared(ctx) -> DataFrame | None:
    return _dependencies(ctx, "dependency-undeclared")


@change_rule("dependency-removed-still-used", "critical", blocking=True, fix="declare it again, or stop importing it")
def dependency_removed(ctx) -> DataFrame | None:
    return _dependencies(ctx, "dependency-removed-still-used")


def total_costs(costs: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """G13. keys, name, cost (degree, log): what a function costs with all that it calls, `depth` calls deep; costs(keys, name,
    degree, log, calls[callee, degree, log])."""
    own = costs.select(*keys, "name", F.struct("degree", "log").alias("cost"))
    calls = costs.select(*keys, "name", F.explode("calls").alias("c")).select(*keys, "name", C("c.callee").alias("callee"), C("c.degree").alias("d"), C("c.log").alias("l"))
    calls = calls.join(own.select(*keys, C("name").alias("callee")), [*keys, "callee"]).filter("callee <> name")
    now = own
    for _ in range(depth):
        through = calls.join(now.select(*keys, C("name").alias("callee"), C("cost").alias("inner")), [*keys, "callee"])
        more = through.select(*keys, "name", F.struct((C("d") + C("inner.degree")).alias("degree"), (C("l") + C("inner.log")).alias("log")).alias("cost"))
        was, now = now, graph.cut(own.unionByName(more).groupBy(*keys, "name").agg(F.max("cost").alias("cost")))
        if not now.join(was.withColumnRenamed("cost", "was"), [*keys, "name"]).filter("cost <> was").head(1):
            break
    return now


@change_rule("complexity-regression", "medium", fix="look for the loop that the change put round another")
def complexity(ctx) -> DataFrame | None:
    """A function that was there before, is edited, and now costs a square or more, and more than it did; high if that is a
    cube or more and two degrees up."""
    if "loop" not in ctx.news:
        return None
    costs = graph.cut(ctx.table("cost"))
    b, a = sides(total_costs(costs, ["pair", "side"]))
    j = a.withColumnRenamed("cost", "now").join(b.withColumnRenamed("cost", "was"), ["pair", "name"]).filter("now.degree >= 2 AND now > was")
    j = j.join(ctx.live.select("pair", "name", "path", "line"), ["pair", "name"])
    from driftwake.functions.text import big_o

    severity = F.when(C("now.degree").__ge__(3) & (C("now.degree") - C("was.degree") >= 2), "high").otherwise("medium")
    said = F.concat("name", F.lit(" went from "), big_o(C("was.degree"), C("was.log")), F.lit(" to "), big_o(C("now.degree"), C("now.log")))
    return j.select("pair", severity.alias("severity"), said.alias("message"), "path", "line")


@change_rule("unvalidated-input-reaches-sink", "critical", fix="check, convert or escape it for where it goes")
def tainted(ctx) -> DataFrame | None:
    """See rules/flows.py."""
    if "flow" not in ctx.facts_there:
        return None
    return flows.findings(ctx)


@change_rule("co-change", "low", fix="look whether the other file needs the same change")
def co_change(ctx) -> DataFrame | None:
    """A4, J19. An edited file whose history says that another, which is there and not edited, changes with it."""
    if ctx.history is None:
        return None
    found = mining.baskets(ctx.history, "commit", "path")
    here = ctx.files.filter("side = 'after'").select("pair", C("path").alias("partner"))
    j = ctx.edited_paths.join(found, C("path") == C("item")).join(here, ["pair", "partner"]).join(ctx.edited_paths.select("pair", C("path").alias("partner")), ["pair", "partner"], "left_anti")
    at = ctx.defs_of("after").select("pair", C("name").alias("dst"), C("path").alias("to"))
    linked = linked_files(ctx.edges.filter("side = 'after'").join(at, ["pair", "dst"]), "path", "to").withColumn("linked", F.lit(True))
    j = j.withColumn("a", F.least("item", "partner")).withColumn("b", F.greatest("item", "partner")).join(linked, ["pair", "a", "b"], "left")
    first = Window.partitionBy("pair", "a", "b").orderBy(F.desc("confidence"), F.desc("together"), "item")
    j = j.withColumn("n", F.row_number().over(first)).filter("n = 1")
    severity = F.when((C("confidence") >= 0.8) & C("linked").isNull(), "medium").otherwise("low")
    said = F.concat("item", F.lit(" usually changes together with "), "partner", F.lit(": "), C("together").cast("string"), F.lit(" of the last "), C("total").cast("string"), F.lit(" commits"))
    return j.select("pair", severity.alias("severity"), said.alias("message"), C("item").alias("path"), F.lit(1).alias("line"))


def linked_files(edges: DataFrame, one: str, other: str) -> DataFrame:
    """J19. pair, a, b: files with an edge between them, whichever way."""
    return edges.filter(C(one) != C(other)).select("pair", F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()

"""Input that reaches a sink unchecked, across functions.

Flow facts say, for each function, which of its sources, parameters and results of calls reach which sinks, arguments and
returns. Three fixpoints over joins put them together: what a call gives back (parameters that reach their function's return, sources
that it returns), then which parameters a source reaches, with the functions on the way, then the sinks that these reach. Of all ways to a
state the shortest is kept, and the shortest through a function that the change wrote: it alone makes a finding. Each
place of a sink is told, however many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwake.functions.text import is_test_path
from driftwake.operators import graph

C = F.col
#: How grave input of a kind is where a request brings it; what the program's own user brings is a level lower, and counts only for LOCAL.
GRAVE = {"exec": "critical", "eval": "critical", "deserialize": "critical", "sql": "critical", "path": "high", "ssrf": "high", "redirect": "medium", "html": "medium"}
LOCAL = ("exec", "eval", "deserialize", "sql")
LOWER = {"critical": "high", "high": "medium", "medium": "low"}


def resolved(flows: DataFrame, defs: DataFrame) -> DataFrame:
    """pair, owner, call, callee, params: of each call the first of its names that is a function, or a class, whose __init__
    takes the arguments."""
    fns = defs.filter("kind IN ('function', 'method')").select("pair", C("name").alias("callee"), "params")
    made = fns.filter(C("callee").endswith(".__init__")).select("pair", F.regexp_replace("callee", r"\.__init__$", "").alias("said"), "callee", "params")
    known = fns.select("pair", C("callee").alias("said"), "callee", "params").unionByName(made)
    tried = flows.filter("target = 'called'").select("pair", "owner", "call", F.posexplode("callees").alias("pos", "said")).join(known, ["pair", "said"])
    return tried.groupBy("pair", "owner", "call").agg(F.min_by(F.struct("callee", "params"), "pos").alias("h")).select("pair", "owner", "call", "h.*")


def arguments(flows: DataFrame, calls: DataFrame) -> DataFrame:
    """Flows into arguments -> callee and param; seen through an instance the first parameter is filled already."""
    j = flows.filter("target = 'arg'").drop("callees", "target", "sink").join(calls, ["pair", "owner", "call"])
    place = F.expr("try_cast(kind AS int)")
    shift = C("params.binds_first").cast("int")
    param = F.when(place.isNotNull(), F.get(C("params.positional"), place + shift)).otherwise(C("kind"))
    return j.withColumn("param", param).filter("param IS NOT NULL").drop("params")


def settled(start: DataFrame, step, keys: list[str], best=None) -> DataFrame:
    """start with all that step adds, until it adds nothing: there are no more rows than keys. step(new, now) gets what the last round
    found and all so far. Of rows with equal keys in a round the one with the least `best` stays; one of an earlier round goes before."""
    def one(df: DataFrame) -> DataFrame:
        if best is None:
            return df.dropDuplicates(keys)
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), best).alias("r")).select(*keys, "r.*").select(df.columns)

    now = new = graph.cut_in_loop(one(start))
    rounds = 0
    while True:
        new = graph.cut_in_loop(one(step(new, now)).join(now, keys, "left_anti"))
        if not new.head(1):
            return now
        rounds += 1
        now = now.unionByName(new)  # of written parts
        if rounds % 8 == 0:
            now = graph.cut_in_loop(now)


def both(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def grounded(flows: DataFrame, calls: DataFrame) -> DataFrame:
    """pair, path, owner, origin (never a call), name, target, line, kind, sink, callee, param, cleared."""
    args = arguments(flows, calls)
    arg = args.select("pair", "path", "owner", "origin", "name", F.lit("arg").alias("target"), "line", F.lit("").alias("kind"), F.lit("").alias("sink"), "callee", "param", "call", "cleared")
    rest = flows.filter("target IN ('sink', 'return')").select("pair", "path", "owner", "origin", "name", "target", "line", "kind", "sink", F.lit("").alias("callee"), F.lit("").alias("param"), F.lit(0).alias("call"), "cleared")
    every = graph.cut(arg.unionByName(rest))
    waiting = every.filter("origin = 'call'").select("pair", "path", "owner", C("name").cast("int").alias("of"), "target", "line", "kind", "sink", "callee", "param", "call", C("cleared").alias("c0"))
    keys = ["pair", "owner", "origin", "name", "target", "line", "kind", "sink", "callee", "param", "call", "cleared"]

    def step(new: DataFrame, now: DataFrame) -> DataFrame:
        passes = lambda df: df.filter("origin = 'param' AND target = 'return'").select("pair", C("owner").alias("callee"), C("name").alias("param"), C("cleared").alias("c1")).distinct()
        handed = lambda df: df.filter("target = 'arg'").select("pair", "owner", "origin", "name", C("call").alias("of"), "callee", "param", C("cleared").alias("c2"))
        met = handed(new).join(passes(now), ["pair", "callee", "param"]).unionByName(handed(now).join(passes(new), ["pair", "callee", "param"]))
        through = waiting.join(met.drop("callee", "param"), ["pair", "owner", "of"]).withColumn("cleared", both(both(C("c0"), C("c1")), C("c2")))
        gives = new.filter("origin NOT IN ('param', 'call') AND target = 'return'").select("pair", C("owner").alias("gives"), "origin", "name", C("cleared").alias("c1"))
        named = of_calls.join(gives, ["pair", "gives"])
        given = waiting.join(named.select("pair", "owner", "of", "origin", "name", "c1"), ["pair", "owner", "of"]).withColumn("cleared", both(C("c0"), C("c1")))
        return through.select(now.columns).unionByName(given.select(now.columns))

    of_calls = calls.select("pair", "owner", C("call").alias("of"), C("callee").alias("gives"))
    start = every.filter("origin <> 'call'")
    return settled(start, step, keys)


def findings(ctx) -> DataFrame | None:
    told = ctx.table("flow").filter((C("side") == "after") & ~is_test_path(C("path"))).drop("side")
    told = graph.cut(told)
    outside = F.col("origin").isin("web", "network", "local")
    there = set()
    for r in told.groupBy((C("target") == "sink").alias("sink"), outside.alias("source")).count().collect():  # four rows
        there |= {n for n in ("sink", "source") if r[n]}
    if there != {"sink", "source"}:
        return None
    ground = grounded(told, graph.cut(resolved(told, ctx.defs_of("after"))))
    edited = ctx.live.select("pair", C("name").alias("owner")).distinct().withColumn("wrote", F.lit(True))
    ground = graph.cut(ground.join(edited, ["pair", "owner"], "left").withColumn("wrote", F.coalesce("wrote", F.lit(False))))
    source = "origin NOT IN ('param', 'call')"
    hand = ground.filter("origin = 'param' AND target = 'arg'").select("pair", "owner", C("name").alias("param"), C("callee").alias("next"), C("param").alias("next_param"), C("cleared").alias("c1"), "wrote")
    # touched: an edited function is on the way. Ways with one and without are states of their own, so neither hides the other
    first = ground.filter(source + " AND target = 'arg'").select("pair", C("callee").alias("owner"), "param", "origin", "name", "cleared", C("wrote").alias("touched"), F.array("owner").alias("via"))

    def step(new: DataFrame, now: DataFrame) -> DataFrame:
        on = new.join(hand, ["pair", "owner", "param"])
        return on.select("pair", C("next").alias("owner"), C("next_param").alias("param"), "origin", "name", both(C("cleared"), C("c1")).alias("cleared"), (C("touched") | C("wrote")).alias("touched"), F.concat("via", F.array("owner")).alias("via"))

    reached = settled(first, step, ["pair", "owner", "param", "origin", "name", "cleared", "touched"], C("via"))
    sinks = ground.filter("target = 'sink'").select("pair", "path", "owner", "origin", "name", "line", "kind", "sink", "cleared", "wrote")
    direct = sinks.filter(source).withColumn("touched", F.lit(False)).withColumn("via", F.array().cast("array<string>"))
    far = sinks.filter("origin = 'param'").select("pair", "path", "owner", C("name").alias("param"), "line", "kind", "sink", C("cleared").alias("c1"), "wrote").join(reached, ["pair", "owner", "param"]).withColumn("cleared", both(C("cleared"), C("c1")))
    every = direct.unionByName(far.select(direct.columns)).filter(~F.array_contains("cleared", C("kind")) & ((C("origin") != "local") | C("kind").isin(*LOCAL)))
    touched = every.filter("wrote OR touched").drop("wrote", "touched").distinct()
    level = F.lit("low")
    for kind, severity in GRAVE.items():
        level = F.when(C("kind") == kind, F.when(C("origin") == "local", LOWER[severity]).otherwise(severity)).otherwise(level)
    rank = F.struct(F.when(C("origin") == "web", 0).when(C("origin") == "network", 1).otherwise(2).alias("o"), F.size("via").alias("hops"), "name", "via", "owner", "sink")
    best = touched.groupBy("pair", "path", "line", "kind").agg(F.min_by(F.struct("origin", "name", "owner", "sink", "via"), rank).alias("b"), F.countDistinct("name").alias("sources"))
    best = best.select("pair", "path", "line", "kind", "sources", "b.*").withColumn("severity", level)
    way = F.array_join(F.concat("via", F.array("owner")), "() hands it to ")
    more = F.when(C("sources") > 1, F.concat(F.lit(" ("), (C("sources") - 1).cast("string"), F.lit(" more sources)"))).otherwise("")
    said = F.concat("name", F.lit(" reaches "), "sink", F.lit("() in "), way, F.lit("()"), more)
    return best.select("pair", "severity", said.alias("message"), "path", "line")

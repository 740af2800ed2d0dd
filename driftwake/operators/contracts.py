"""What a changed signature breaks, and calls against what they call.

A break says which shapes of call it hits, as a struct: hard, test, name, at (slot, from 1), names (required or accepted), text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Rows of a symbol that make a cell of pairs, about so many at most of who takes it and of who gives it; takers that go together.
TAKERS, GIVERS, TOGETHER = 4096, 1024, 256
BREAK = "struct<hard:boolean,test:string,name:string,at:int,names:array<string>,text:string>"


def _break(hard: bool, test: str, text: Column, name: Column | None = None, at: Column | None = None, names: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(hard).alias("hard"), F.lit(test).alias("test"), (none if name is None else name).cast("string").alias("name"),
        (none if at is None else at).cast("int").alias("at"), (none if names is None else names).cast("array<string>").alias("names"), text.alias("text"),
    )


def _at(names: Column, name: Column) -> Column:
    return F.array_position(names, name).cast("int")


def arity_breaks(old: Column, new: Column) -> Column:
    """P14. Typed breaks between two contracts, structs of positional, required (how many), positional_only (names), keyword_only,
    keyword_required, varargs, varkw, and defaults (map of name to text). An empty array where calls of any shape go on."""
    op, np_, ok, nk = old["positional"], new["positional"], old["keyword_only"], new["keyword_only"]
    empty = F.array().cast(f"array<{BREAK}>")
    more = F.when(new["required"] > old["required"], F.array(_break(True, "fewer-positional", F.concat(F.lit("requires "), new["required"].cast("string"), F.lit(" positional arguments, was "), old["required"].cast("string")), names=F.slice(np_, 1, new["required"]))))
    gone = F.filter(op, lambda p: ~F.array_contains(np_, p) & ~F.array_contains(nk, p))

    def dropped(p: Column) -> Column:
        i = _at(op, p)
        other = F.get(np_, i - 1)
        renamed = other.isNotNull() & ~F.array_contains(op, other) & ~F.array_contains(ok, other) & ((i <= old["required"]) == (i <= new["required"]))
        return F.when(renamed, _break(True, "uses-keyword", F.concat(F.lit("parameter "), p, F.lit(" renamed to "), other), p)).otherwise(_break(True, "uses-slot-or-keyword", F.concat(F.lit("dropped parameter "), p), p, i))

    lost = F.when(~new["varkw"], F.transform(F.filter(ok, lambda k: ~F.array_contains(nk, k) & ~F.array_contains(np_, k)), lambda k: _break(True, "uses-keyword", F.concat(F.lit("dropped keyword-only parameter "), k), k)))
    moved = F.transform(F.filter(op, lambda p: F.array_contains(np_, p) & (_at(op, p) != _at(np_, p))), lambda p: _break(True, "reaches-slot", F.concat(F.lit("parameter "), p, F.lit(" moved")), p, F.least(_at(op, p), _at(np_, p))))
    keyed = F.transform(F.filter(op, lambda p: F.array_contains(nk, p)), lambda p: _break(True, "reaches-slot", F.concat(p, F.lit(" became keyword-only")), p, _at(op, p)))
    only = F.transform(F.array_except(new["positional_only"], old["positional_only"]), lambda p: _break(True, "uses-keyword", F.concat(p, F.lit(" became positional-only")), p))
    needed = F.transform(F.array_sort(F.array_except(new["keyword_required"], old["keyword_required"])), lambda k: _break(True, "omits-keyword", F.concat(F.lit("new required keyword-only argument "), k), k))
    accepted = F.concat(F.array_except(np_, new["positional_only"]), nk)
    closed = F.when(old["varkw"] & ~new["varkw"], F.array(_break(True, "unknown-keyword", F.lit("no longer accepts **kwargs"), names=accepted)))
    short = F.when(old["varargs"] & ~new["varargs"], F.array(_break(True, "reaches-slot", F.lit("no longer accepts *args"), at=F.size(np_) + 1)))
    both = F.filter(F.map_keys(old["defaults"]), lambda k: F.map_contains_key(new["defaults"], k) & (F.element_at(old["defaults"], k) != F.element_at(new["defaults"], k)))
    soft = F.transform(F.array_sort(both), lambda k: _break(False, "omits", F.concat(F.lit("default value changed for "), k), k, F.nullif(_at(np_, k), F.lit(0))))
    parts = [more, F.transform(gone, dropped), lost, moved, keyed, only, needed, closed, short, soft]
    return F.concat(*(F.coalesce(p, empty) for p in parts))


def affects(brk: Column, positional: Column, keywords: Column, star: Column, dstar: Column, offset: Column) -> Column:
    """P13. Would a break hit a call of this shape? offset: 1 if the first parameter is filled by the instance. What the call doesn't
    let be seen (unpacked arguments) counts as hit."""
    reach, test = positional + offset, brk["test"]
    past = F.slice(brk["names"], reach + 1, F.greatest(F.size(brk["names"]) - reach, F.lit(0)))
    named = F.array_contains(keywords, brk["name"])
    return (
        F.when(star & test.isin("reaches-slot", "uses-slot-or-keyword", "fewer-positional"), True)
        .when(dstar & test.isin("uses-keyword", "uses-slot-or-keyword", "unknown-keyword", "omits-keyword", "omits"), True)
        .when(test == "fewer-positional", F.size(F.array_except(past, keywords)) > 0)
        .when(test == "reaches-slot", reach >= brk["at"])
        .when(test == "uses-keyword", named)
        .when(test == "uses-slot-or-keyword", named | (reach >= brk["at"]))
        .when(test == "omits-keyword", ~named)
        .when(test == "unknown-keyword", F.size(F.array_except(keywords, brk["names"])) > 0)
        .when(test == "omits", ~(F.coalesce(reach >= brk["at"], F.lit(False))) & ~named)
        .otherwise(True)
    )


def typed_breaks(old: Column, new: Column) -> Column:
    """P15. Breaks of languages whose calls are told by count and type alone; contracts are structs of types (one a parameter), returns,
    variadic, static, throws. What is given is told as texts: the count, each type that changed, a return type, varargs that went, a
    static flip, and exceptions that are new."""
    count = F.when(F.size(old["types"]) != F.size(new["types"]), F.concat(F.lit("takes "), F.size(new["types"]).cast("string"), F.lit(" arguments, was "), F.size(old["types"]).cast("string")))
    pairs = F.arrays_zip(old["types"].alias("o"), new["types"].alias("n"))
    types = F.when(F.size(old["types"]) == F.size(new["types"]), F.filter(F.transform(pairs, lambda p, i: F.when(p["o"] != p["n"], F.concat(F.lit("argument "), (i + 1).cast("string"), F.lit(": "), p["o"], F.lit(" to "), p["n"]))), F.isnotnull))
    gives = F.when(old["returns"] != new["returns"], F.concat(F.lit("returns "), new["returns"], F.lit(", was "), old["returns"]))
    fixed = F.when(old["variadic"] & ~new["variadic"], F.lit("no longer takes any number of arguments"))
    static = F.when(old["static"] != new["static"], F.when(new["static"], F.lit("became static")).otherwise(F.lit("is no longer static")))
    raises = F.transform(F.array_sort(F.array_except(new["throws"], old["throws"])), lambda t: F.concat(F.lit("throws "), t))
    return F.concat(F.array_compact(F.array(count)), F.coalesce(types, F.array().cast("array<string>")), F.array_compact(F.array(gives, fixed, static)), raises)


def rebound_calls(old: DataFrame, new: DataFrame, edited: DataFrame | None = None) -> DataFrame:
    """J15. Calls that stand where they stood and mean another overload now: src, line, was, now; none in edited(src), whose writer meant them.
    Sites are (src, start, line, col, dst); start is where the function begins, so a function that moved as a whole still matches."""
    new = new if edited is None else new.join(edited.select("src").distinct(), "src", "left_anti")
    stem = lambda c: F.regexp_replace(c, r"\(.*$", "")
    o = old.select("src", (C("line") - C("start")).alias("at"), "col", C("dst").alias("was"))
    n = new.select("src", (C("line") - C("start")).alias("at"), "col", "line", C("dst").alias("now"))
    return o.join(n, ["src", "at", "col"]).filter((C("was") != C("now")) & (stem(C("was")) == stem(C("now")))).select("src", "line", "was", "now")


def linked_by_symbol(imports: DataFrame, exports: DataFrame, most: float = 0.8) -> DataFrame:
    """J16. src, dst, symbol, confidence: code of one language that takes what code of another gives, by the symbol both name.

    The pairs of a symbol are a rectangle, so a symbol that many name is dealt out as cells of TAKERS by GIVERS, and a task holds the givers of
    one. Rows come by TOGETHER takers, a giver at a time: files of columns pack what repeats like that to little."""
    spark = imports.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    i = imports.select("symbol", C("node").alias("src"), "lang", F.least("confidence", F.lit(most)).alias("confidence"))
    e = exports.select("symbol", C("node").alias("dst"), C("lang").alias("to"))
    across, down = (F.broadcast(shares(df, size, n)) for df, size, n in ((i, TAKERS, "across"), (e, GIVERS, "down")))  # a row for `size` rows at most

    own = lambda df, shares_, n: df.join(shares_, "symbol", "left").withColumn(n, F.pmod(F.xxhash64(*df.columns), F.coalesce(n, F.lit(1))))  # noqa: E731  a row is in one share of its side
    all_of = lambda df, shares_, n: df.join(shares_, "symbol", "left").withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1)))  # noqa: E731  and meets all of the other
    cell = ["symbol", "across", "down"]
    takers = own(i, across, "across").groupBy("symbol", "across", "lang").agg(F.array_sort(F.collect_list(F.struct("confidence", "src"))).alias("all"))
    some = F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(TOGETHER)), lambda at: F.slice("all", at, TOGETHER))
    takers = all_of(takers.select("symbol", "across", "lang", F.explode(some).alias("some")), down, "down")
    givers = all_of(own(e, down, "down"), across, "across")
    # of few rows come many, so the number of tasks stands; a join makes all rows of one on the left at once, TOGETHER by GIVERS
    met = takers.repartition(tasks, *cell).hint("merge").join(givers.repartition(tasks, *cell), cell).filter("lang <> to")
    return met.select("dst", "symbol", F.inline("some")).select("src", "dst", "symbol", "confidence")


def shares(df: DataFrame, size: int, name: str) -> DataFrame:
    """symbol, name: how many shares of about `size` rows make up those of a symbol, where one does not."""
    return df.groupBy("symbol").agg(F.ceil(F.count("*") / size).alias(name)).filter(C(name) > 1)


def through_arguments(passed: DataFrame, dummies: DataFrame, calls: DataFrame) -> DataFrame:
    """J17. src, dst, line: a routine that is passed as an argument is called where the dummy it fills is called.

    passed(callee, position, routine), dummies(callee, position, name), calls(src, name, line)."""
    filled = passed.join(dummies, ["callee", "position"]).select(C("callee").alias("src"), "name", C("routine").alias("dst"))
    return calls.join(filled, ["src", "name"]).filter("src <> dst").select("src", "dst", "line").distinct()


def argument_mismatches(arguments: DataFrame, parameters: DataFrame, old_arguments: DataFrame, old_parameters: DataFrame) -> DataFrame:
    """J28, J29. Calls whose arguments do not fit what they call, and did before (or were not there): site, callee, reason.

    arguments(site, callee, position, type, size), parameters(callee, position, type, size): another count, another type, or an
    argument smaller than what the callee takes there."""
    def wrong(args: DataFrame, params: DataFrame) -> DataFrame:
        given = args.groupBy("site", "callee").agg(F.max("position").alias("given"))
        taken = params.groupBy("callee").agg(F.max("position").alias("taken"))
        counts = given.join(taken, "callee").filter("given <> taken").select("site", "callee", F.concat(F.lit("passes "), C("given").cast("string"), F.lit(" of "), C("taken").cast("string")).alias("reason"))
        p = params.select("callee", "position", C("type").alias("wants"), C("size").alias("least"))
        pairs = args.join(p, ["callee", "position"])
        said = F.when(C("type") != C("wants"), F.concat("type", F.lit(" for "), "wants")).when(C("size") < C("least"), F.concat(C("size").cast("string"), F.lit(" bytes for "), C("least").cast("string")))
        return counts.unionByName(pairs.select("site", "callee", F.concat(F.lit("argument "), C("position").cast("string"), F.lit(": "), said).alias("reason")).filter("reason IS NOT NULL"))

    return wrong(arguments, parameters).join(wrong(old_arguments, old_parameters), ["site", "callee", "reason"], "left_anti")


def constructor_contracts(fields: DataFrame, bases: DataFrame) -> DataFrame:
    """J31. cls, positional, required: the constructor that a class of fields gets, its bases' fields first, a field that is declared
    again staying in its first place. fields(cls, ord, name, has_default), bases(cls, base, depth): depth 1 is the nearest."""
    own = fields.select("cls", F.lit(0).alias("depth"), "ord", "name", "has_default")
    far = bases.join(fields.withColumnRenamed("cls", "base"), "base").select("cls", "depth", "ord", "name", "has_default")
    every = own.unionByName(far)
    one = every.groupBy("cls", "name").agg(F.max(F.struct("depth", (-C("ord")).alias("o"))).alias("first"), F.min_by("has_default", "depth").alias("has_default"))
    ranked = one.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct((-C("first.depth")).alias("d"), (-C("first.o")).alias("o"), "name", "has_default"))).alias("f"))
    return ranked.select("cls", F.transform("f", lambda x: x["name"]).alias("positional"), F.size(F.filter("f", lambda x: ~x["has_default"])).alias("required"))

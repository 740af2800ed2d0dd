"""The check: facts of two versions to changes, edges, affected code, findings and one verdict.

Any number of pairs of versions goes through one plan: every table has a `pair`, and `side` (before, after) where it holds both. Facts
are read once for each distinct text, whatever number of pairs hold it. Rules are those of the registry (rules/); which of them
have anything to do is told by one small count of kinds of changes and facts, so a change that touches no constant never joins
constants."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.functions import text as T
from driftwake.operators import changes as diffs
from driftwake.operators import graph, ranking, spans
from driftwake.rules import changes as _change_rules  # noqa: F401  registers
from driftwake.rules import cobol as _cobol_rules  # noqa: F401  registers
from driftwake.rules import files as _file_rules  # noqa: F401  registers
from driftwake.rules import fortran as _fortran_rules  # noqa: F401  registers
from driftwake.rules import languages as _language_rules  # noqa: F401  registers
from driftwake.rules import registry
from driftwake.sources import facts as sources
from driftwake.sources import manifests
from driftwake.values import COMMON_METHODS, GUESS, SEEDS, STEPS

C = F.col


def unsuppressed(findings: DataFrame, marks: DataFrame, path: str, line: str, rule: str, alone: str = "alone", by: Sequence[str] = ()) -> DataFrame:
    """P7. Findings that no mark names: on their own line, or, if the mark's line is nothing but a comment, on the line above."""
    own = marks.select(*by, path, line, rule)
    above = marks.filter(alone).select(*by, path, (C(line) + 1).alias(line), rule)
    return findings.join(own.unionByName(above).distinct(), [*by, path, line, rule], "left_anti")


def definitions(facts: DataFrame) -> DataFrame:
    """Of a name defined twice the last in path order stands."""
    return diffs.last_wins(sources.table(facts, "def"), ["pair", "side", "name"], [F.desc("path"), F.desc("ord")])


def changed(defs: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Pair, name, kind, old_name, path, line, end_line, before and after (structs). What stood in a file that can no
    longer be read is not known to have gone, nor is what stands in one that could not be read to be new."""
    keep = ["name", "kind", "path", "line", "end_line", "signature", "body", "value", "value_type", "params"]
    sides = [defs.filter(C("side") == s).drop("side") for s in ("before", "after")]
    value = F.when((C("a.kind") == "constant") & ~C("b.value").eqNullSafe(C("a.value")), True)
    out = diffs.snapshot_diff(*sides, ["pair", "name"], [("signature", "signature"), ("value", value), ("body", "body")], keep)
    blind = unreadable.select("pair", F.when(C("side") == "after", "removed").otherwise("added").alias("kind"), C("path").alias("where")).distinct()
    out = out.withColumn("where", F.coalesce(C("before.path"), C("after.path"))).join(blind, ["pair", "kind", "where"], "left_anti").drop("where")
    gone, new = (out.filter(C("kind") == k).select("pair", f"{s}.*").filter("kind <> 'constant'") for k, s in (("removed", "before"), ("added", "after")))
    pairs = diffs.unique_pairs(gone, new, ["pair", "kind", "signature", "body"], "name").select("pair", "old_key", "new_key")
    one = out.join(pairs.select("pair", C("old_key").alias("name")), ["pair", "name"], "left_anti").join(pairs.withColumnRenamed("new_key", "name"), ["pair", "name"], "left")
    old = out.filter("kind = 'removed'").select("pair", C("name").alias("old_key"), C("before").alias("was"))
    one = one.join(old, ["pair", "old_key"], "left")
    at = F.coalesce("after", "before")
    kind = F.when(C("old_key").isNotNull(), "renamed").otherwise(C("kind"))
    return one.select("pair", "name", kind.alias("kind"), C("old_key").alias("old_name"), at["path"].alias("path"), at["line"].alias("line"), at["end_line"].alias("end_line"), F.coalesce("was", "before").alias("before"), "after")


def edges(facts: DataFrame, defs: DataFrame) -> DataFrame:
    """Pair, side, src, dst, kind, path, line, guess, bound, positional, keywords, unpacked, smaller.

    Names are looked up in both versions, so that a use of something deleted keeps its edge. Each use meets one table of
    names: full ones, and behind them (as a guess) methods that alone have their short name; of what it meets the
    first in the use's own order stands."""
    sided = defs.groupBy("pair", "name").agg(F.max(F.when(C("side") == "before", C("kind"))).alias("before"), F.max(F.when(C("side") == "after", C("kind"))).alias("after"))
    known = sided.select("pair", "name", F.explode(F.array(F.struct(F.lit("before").alias("side"), F.coalesce("before", "after").alias("def_kind")), F.struct(F.lit("after").alias("side"), F.coalesce("after", "before").alias("def_kind")))).alias("x")).select("pair", "x.side", "name", "x.def_kind")
    short = F.substring_index("name", ".", -1)
    alone = known.filter("def_kind = 'method'").groupBy("pair", "side", short.alias("method")).agg(F.count("*").alias("n"), F.min("name").alias("name")).filter((C("n") == 1) & ~C("method").isin(*COMMON_METHODS))
    names = known.select("pair", "side", C("name").alias("key"), "name", "def_kind", F.lit(False).alias("guess")).unionByName(alone.select("pair", "side", F.concat(F.lit("."), "method").alias("key"), "name", F.lit("method").alias("def_kind"), F.lit(True).alias("guess")))
    uses = sources.table(facts, "use").distinct()
    tries = F.concat(F.transform(F.arrays_zip("candidates", "bound"), lambda c: F.struct(c["candidates"].alias("key"), c["bound"].alias("bound"))), F.when(C("method").isNotNull(), F.array(F.struct(F.concat(F.lit("."), "method").alias("key"), F.lit(True).alias("bound")))).otherwise(F.array().cast("array<struct<key:string,bound:boolean>>")))
    keep = ["pair", "side", "path", "src", "kind", "line", "candidates", "method", "positional", "keywords", "unpacked", "smaller"]
    tried = uses.select(*keep, F.posexplode(tries).alias("pos", "t")).select(*keep, "pos", "t.key", "t.bound").join(names, ["pair", "side", "key"])
    found = tried.groupBy(*keep).agg(F.min(F.struct("pos", "name", "bound", "def_kind", "guess")).alias("hit")).select(*keep, C("hit.name").alias("dst"), "hit.bound", "hit.def_kind", "hit.guess")
    return found.filter((C("dst") != C("src")) & ((C("kind") == "calls") | (C("def_kind") == "constant"))).drop("candidates", "method", "def_kind")


def affected(changes: DataFrame, edges_: DataFrame, defs_after: DataFrame) -> DataFrame:
    """G1: pair, name, path, line, hops, score: what the change did not touch and can break, the score unrounded."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    weight = F.element_at(table(STEPS), C("kind")) * F.when(C("guess"), GUESS).otherwise(1.0)
    score = F.element_at(table(SEEDS), C("kind"))
    names = changes.select(F.explode(F.array_compact(F.array("name", "old_name"))).alias("n"), "pair", F.when(C("kind") != "added", score).alias("score")).select(F.struct("pair", "n").alias("node"), "score")
    steps = edges_.filter("side = 'after'").groupBy(F.struct("pair", C("src").alias("n")).alias("src"), F.struct("pair", C("dst").alias("n")).alias("dst")).agg(F.max(weight).alias("weight"))
    out = graph.propagate(steps, names.filter("score IS NOT NULL"), names)
    return out.select("node.pair", C("node.n").alias("name"), "hops", "score").join(defs_after.select("pair", "name", "path", "line"), ["pair", "name"], "left").select("pair", "name", "path", "line", "hops", "score")


def asked_of_reader(rules: dict | None) -> frozenset[str] | None:
    """What these rules need of a reader beside definitions and uses; None, all, for rules other than the registry's own, which may ask
    for anything."""
    if rules is None or any(registry.RULES.get(k) is not r for k, r in rules.items()):
        return None
    return frozenset(rules) | {"nodes" for r in rules.values() if r.kind == "node"}


class Context:
    """What rules read. Tables are made when first asked for."""

    def __init__(self, files: DataFrame, pairs: DataFrame, history: DataFrame | None = None, rules: dict | None = None):
        sides = pairs.select("pair", F.explode(F.array(F.struct(F.lit("before").alias("side"), C("before").alias("snapshot")), F.struct(F.lit("after").alias("side"), C("after").alias("snapshot")))).alias("x")).select("pair", "x.side", "x.snapshot")
        sides = F.broadcast(sides)  # two rows a pair; by guesses of size what was read would be sent to them, and to one task
        files = files.join(F.broadcast(sides.select("snapshot").distinct()), "snapshot", "left_semi")
        self.files = files.join(sides, "snapshot").select("pair", "side", "path", "text")
        read = graph.cut(sources.facts(files, asked_of_reader(rules)))
        self.facts = read.join(sides, "snapshot").select("pair", "side", "path", "fact", "data")
        self.history = history
        # one row a kind of fact, one a rule that the reader judged, one if there are manifests
        judged = F.when(C("fact") == "finding", F.get_json_object("data", "$.rule"))
        there = read.select("fact", judged.alias("rule")).unionByName(files.filter(C("path").rlike(manifests.MANIFEST)).select(F.lit("manifest").alias("fact"), F.lit(None).cast("string").alias("rule"))).distinct().collect()
        self.facts_there, self.read_rules = {r[0] for r in there}, {r[1] for r in there}
        self.has_manifest = "manifest" in self.facts_there
        self._kept: dict = {}
        self._declared = lambda: graph.cut(manifests.declared(files).join(sides, "snapshot").drop("snapshot"))

    def table(self, fact: str) -> DataFrame:
        return sources.table(self.facts, fact)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several rules share, made by the first that asks."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @cached_property
    def defs(self) -> DataFrame:
        return graph.cut(definitions(self.facts))

    def defs_of(self, side: str) -> DataFrame:
        return self.defs.filter(C("side") == side)

    @cached_property
    def errors_of_files(self) -> DataFrame:
        return self.table("error").filter("rule IS NULL")

    @cached_property
    def changes(self) -> DataFrame:
        return graph.cut(changed(self.defs, self.errors_of_files))

    @cached_property
    def news(self) -> set[str]:
        """What there is of kinds of change, and whether there are names missing, imports, calls or edited loops that were not there
        before: a dozen words at most, in one job."""
        def fresh(df: DataFrame, word: str) -> DataFrame:
            keys = [c for c in df.columns if c != "side"]
            return df.groupBy(*keys).agg(F.max("side").alias("last")).filter("last = 'after'").select(F.lit(word).alias("word"))

        parts = [self.changes.select(C("kind").alias("word"))]
        if "asked" in self.facts_there:
            parts.append(fresh(self.table("asked").select("pair", "side", "path", "name").distinct(), "asked"))
        if "import" in self.facts_there:
            parts.append(fresh(self.table("import").select("pair", "side", "path", "target", "plain", "late").distinct(), "import"))
        calls = self.edges.filter("kind = 'calls' AND NOT guess").select("pair", "side", "src", "dst").distinct()
        parts.append(fresh(calls, "call"))
        if "cost" in self.facts_there:
            loops = self.table("cost").filter("side = 'after' AND (degree > 0 OR exists(calls, c -> c.degree > 0))").join(self.live.filter("kind IN ('body', 'signature')").select("pair", "name"), ["pair", "name"], "left_semi")
            parts.append(loops.select(F.lit("loop").alias("word")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return {r[0] for r in out.distinct().collect()}

    @cached_property
    def kinds(self) -> set[str]:
        return self.news & set(diffs.KINDS)

    @cached_property
    def live(self) -> DataFrame:
        """P10. Definitions that the change wrote: pair, name, kind, path, line, end_line."""
        return self.changes.filter("kind IN ('added', 'body', 'signature', 'value', 'renamed')").select("pair", "name", "kind", "path", "line", "end_line")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.cut(edges(self.facts, self.defs))

    @cached_property
    def imports(self) -> DataFrame:
        return self.table("import").filter("side = 'after'").drop("side")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.table("node").filter("side = 'after'").drop("side").join(self.edited_paths, ["pair", "path"], "left_semi")

    @cached_property
    def found_by_reader(self) -> DataFrame:
        return self.table("finding")

    @cached_property
    def manifests(self) -> DataFrame:
        return self._declared()

    @cached_property
    def edited_paths(self) -> DataFrame:
        """U2, of each pair: files of the new version whose text is another, line endings apart."""
        b, a = (self.files.filter(C("side") == s).select("pair", "path", F.regexp_replace("text", "\r\n?", "\n").alias(s)) for s in ("before", "after"))
        return a.join(b, ["pair", "path"], "left").filter(~C("after").eqNullSafe(C("before"))).select("pair", "path")


@dataclass
class Report:
    """Of one pair, or, with a column `pair`, of several. changes, edges and affected are made when first asked for."""

    make: dict[str, Callable[[], DataFrame]]
    findings: DataFrame
    suppressed: DataFrame
    errors: DataFrame
    verdict: DataFrame

    @cached_property
    def changes(self) -> DataFrame:
        return self.make["changes"]()

    @cached_property
    def edges(self) -> DataFrame:
        return self.make["edges"]()

    @cached_property
    def affected(self) -> DataFrame:
        return self.make["affected"]()

    def of(self, pair: str) -> Report:
        one = lambda df: df.filter(C("pair") == pair).drop("pair")
        return Report({k: lambda k=k: one(getattr(self, k)) for k in self.make}, *map(one, (self.findings, self.suppressed, self.errors, self.verdict)))


def checks(files: DataFrame, pairs: DataFrame, disabled: Sequence[str] = (), excluded: Sequence[str] = (), history: DataFrame | None = None, rules: dict | None = None) -> Report:
    """files(snapshot, path, text) and pairs(pair, before, after), snapshots each -> a report with a column `pair`. Settings
    take rules and paths out before the verdict; history(commit, path) lets co-change speak."""
    rules = registry.RULES if rules is None else rules
    ctx = Context(files, pairs, history, rules)
    of_files, of_changes, failed = registry.run(ctx, {k: r for k, r in rules.items() if k not in disabled})
    empty = "pair string, rule string, severity string, message string, path string, line int"
    found = files.sparkSession.createDataFrame([], empty)
    if of_files is not None:  # file rules speak only of what the change touched (J5)
        touched = ctx.live.select(F.struct("pair", "path").alias("at"), "line", "end_line")
        inside = spans.in_spans(of_files.withColumn("at", F.struct("pair", "path")), touched, "at", "line", "line", "end_line").drop("at")
        found = found.unionByName(inside)
    if of_changes is not None:
        found = found.unionByName(of_changes)
    found = graph.cut(found.distinct())
    marks = ctx.table("mark").filter("side = 'after'").select("pair", "path", "line", "rule", "alone")
    kept = unsuppressed(found, marks, "path", "line", "rule", by=["pair"])
    gone = found.join(kept, ["pair", "rule", "path", "line", "message"], "left_anti")
    paths = T.excluded(C("path"), list(excluded))
    blocking = [r.id for r in rules.values() if r.blocking]
    kept = kept.filter(~paths).withColumn("blocking", C("rule").isin(*blocking)).withColumn("rank", ranking.rank(C("severity")))
    errors = ctx.table("error").filter("side = 'after'").select("pair", "path", "rule", "message")
    if failed:
        broken = files.sparkSession.createDataFrame([(None, r, m) for r, m in failed], "path string, rule string, message string")
        errors = errors.unionByName(pairs.select("pair").join(F.broadcast(broken)))  # a row a rule that failed
    verdict = pairs.select("pair").join(ranking.verdict(kept, ["pair"]), "pair", "left").withColumn("verdict", F.coalesce("verdict", F.lit("ok")))
    later = {"changes": lambda: ctx.changes.filter(~paths), "edges": lambda: ctx.edges.filter("side = 'after'").drop("side"), "affected": lambda: affected(ctx.changes, ctx.edges, ctx.defs_of("after"))}
    return Report(later, kept.orderBy("rank", "path", "line", "rule"), gone, errors, verdict)


def check(files: DataFrame, before: str = "before", after: str = "after", disabled: Sequence[str] = (), excluded: Sequence[str] | None = None, history: DataFrame | None = None, rules: dict | None = None) -> Report:
    """files(snapshot, path, text) of two versions to a report."""
    pairs = files.sparkSession.createDataFrame([("", before, after)], "pair string, before string, after string")
    return checks(files, pairs, disabled, excluded or (), history, rules).of("")

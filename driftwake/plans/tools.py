"""Questions about a project as functions (K9, P6, P11, P17, A5, G3, G14, J41, K2, K5, S3, A16): the same answers that reports, agents and
editors ask for, over definitions, edges and files of one snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwake.functions import text as T
from driftwake.operators import graph, mining
from driftwake.plans import brief, check
from driftwake.rules import registry
from driftwake.sources import files as sources
from driftwake.sources import lines
from driftwake.values import GUESS, STEPS

C = F.col
CANDIDATES, REACHED, USES, UNUSED, NEAREST = 20, 40, 30, 50, 60


def load(spark: SparkSession, spec: str | dict, snapshot: str, repository: str | None = None) -> DataFrame:
    """S3. files(snapshot, path, text) of a dict of texts, a revision (git:REV) of a repository, or a folder."""
    if isinstance(spec, dict):
        return sources.in_memory(spark, {snapshot: spec})
    if spec.startswith("git:"):
        return sources.git_revision(spark, repository or ".", spec[4:], snapshot=snapshot)
    return sources.directory(spark, spec, snapshot).select("snapshot", "path", "text")


def share(files: DataFrame, home: str, member: str) -> None:
    """K5. A member's work in progress as a partition of a shared table, replaced as a whole."""
    files.select("path", "text").write.mode("overwrite").parquet(f"{home}/snapshot=wip%2F{member}")


def shared(spark: SparkSession, home: str) -> DataFrame:
    """snapshot (wip/<member>), path, text of all who share."""
    return spark.read.option("basePath", home).parquet(home).select("snapshot", "path", "text")


def short(name: Column) -> Column:
    """The last part of a name, without its language and parameters."""
    return F.substring_index(bare(name), ".", -1)


def bare(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^[^@]*@", ""), r"\(.*$", "")


def resolve(defs: DataFrame, query: str) -> dict:
    """P17. {definition} that a name or path:line means, else {candidates, more} of the first way to read it that fits any, else
    {did_you_mean}. Ways: exactly; without language; without parameters; as the last parts; as the short name; whatever its case."""
    q = query.strip()
    path, _, line = q.rpartition(":")
    if path and line.isdigit():
        here = defs.filter((C("path") == path.replace("\\", "/")) & F.lit(int(line)).between(C("line"), C("end_line")))
        one = here.orderBy(C("end_line") - C("line"), "line", "name").limit(1).collect()
        return {"definition": one[0].asDict()} if one else {"candidates": [], "more": 0}
    plain, low = bare(C("name")), q.lower()
    ways = [C("name") == q, F.regexp_replace("name", r"^[^@]*@", "") == q, plain == q, plain.endswith("." + q), short(C("name")) == q, (F.lower(plain) == low) | F.lower(plain).endswith("." + low)]
    tier = F.coalesce(*(F.when(w, F.lit(i)) for i, w in enumerate(ways)))
    told = defs.withColumn("tier", tier).filter("tier IS NOT NULL")
    first = told.join(told.agg(F.min("tier").alias("tier")), "tier", "left_semi").drop("tier")
    found = first.orderBy("path", "line", "name").limit(CANDIDATES + 1).collect()
    if len(found) == 1:
        return {"definition": found[0].asDict()}
    if found:
        more = first.count() - CANDIDATES if len(found) > CANDIDATES else 0
        return {"candidates": [{"name": r["name"], "kind": r["kind"], "where": f"{r['path']}:{r['line']}"} for r in found[:CANDIDATES]], "more": more}
    words = defs.select(F.explode(F.array(plain, short(C("name")))).alias("name")).distinct()
    close = lines.close_matches(defs.sparkSession.createDataFrame([(q,)], "name string"), words).head()
    return {"did_you_mean": close["close"] if close else []}


def steps(edges: DataFrame) -> DataFrame:
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv)), C("kind")) * F.when(C("guess"), GUESS).otherwise(1.0)
    return edges.groupBy("src", "dst").agg(F.max(weight).alias("weight"))


def reach(defs: DataFrame, edges: DataFrame, name: str, most: int = REACHED) -> tuple[DataFrame, DataFrame]:
    """E4. What a changed signature (or a constant's value) would reach: (name, hops, score, path, line), the likeliest first, and the
    roll-up by file (A17)."""
    seed = defs.filter(C("name") == name).select(C("name").alias("node"), F.when(C("kind") == "constant", 0.8).otherwise(0.95).alias("score"))
    got = graph.propagate(steps(edges), seed).join(defs.select(C("name").alias("node"), "path", "line"), "node").withColumnRenamed("node", "name")
    by_file = got.groupBy("path").agg(F.count("*").alias("definitions"), F.min("hops").alias("nearest"))
    return got.orderBy(F.desc("score"), "hops", "name").limit(most), by_file


def node(defs: DataFrame, edges: DataFrame, name: str, most: int = USES) -> dict[str, DataFrame]:
    """A definition, who uses it and what it uses."""
    order = [F.desc(F.size("sites")), "name", "kind"]
    return {"definition": defs.filter(C("name") == name), "used_by": brief.uses_of(edges, name).orderBy(*order).limit(most), "uses": brief.uses_of(edges, name, outward=True).orderBy(*order).limit(most)}


def is_test_source(path: Column) -> Column:
    """P6. A test as the search for unused code sees it."""
    return path.rlike(r"(^|/)(tests?/|test_[^/]*$|[^/]*_test\.py$|conftest\.py$)")


def unused(defs: DataFrame, files: DataFrame) -> DataFrame:
    """A5. Definitions whose name stands nowhere but where things of that name are defined, less what is found without being named:
    decorated ones, dunder methods, tests, subclasses and their members."""
    own = defs.withColumn("word", short(C("name")))
    quiet = mining.unmentioned(files.select(F.explode(T.tokens(C("text"))).alias("word")), own.select("word"), "word").select("word")
    sub = defs.filter((C("kind") == "class") & (F.trim("signature") != "") & (F.trim("signature") != "object")).select(C("name").alias("cls"))
    members = own.withColumn("cls", F.when(C("kind") == "class", C("name")).otherwise(F.regexp_replace("name", r"\.[^.]*$", "")))
    left = members.join(quiet, "word", "left_semi").join(sub, "cls", "left_anti")
    return left.filter(~C("decorated") & ~C("word").rlike("^__.*__$") & ~is_test_source(C("path"))).select("name", "kind", "path", "line")


def cursor_definition(defs: DataFrame, points: DataFrame) -> DataFrame:
    """J41. Of each point(id, path, line) the latest-starting definition that may hold it; one whose end is not known holds all that
    follows it."""
    d = defs.select(C("path").alias("p"), "name", C("line").alias("start"), "end_line")
    j = points.join(d, (C("path") == C("p")) & (C("start") <= C("line")) & (C("end_line").isNull() | (C("line") <= C("end_line"))), "left")
    return j.groupBy("id").agg(F.max_by("name", F.struct("start", "name")).alias("name"))


def flow_columns(nodes: DataFrame, edges: DataFrame, uses: int = 4) -> DataFrame:
    """G3. id, column: 0 for what changed or has a finding, the hop for what is reached, -1 for the `uses` things most used by column 0.
    nodes(id, change, finding, score, hops)."""
    level = F.when((C("score") > 0) & ~C("change"), C("hops")).when(C("change") | C("finding"), F.lit(0))
    shown = nodes.select("id", level.alias("column")).filter("column IS NOT NULL")
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    used = e.join(shown.filter("column = 0").select(C("id").alias("src")), "src", "left_semi").join(nodes.select(C("id").alias("dst")), "dst", "left_semi").join(shown.select(C("id").alias("dst")), "dst", "left_anti")
    top = used.groupBy(C("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(uses)
    return shown.unionByName(top.select("id", F.lit(-1).alias("column")))


def pruned(nodes: DataFrame, edges: DataFrame, limit: int = NEAREST, whole: bool = False) -> DataFrame:
    """G14. id of at most `limit` nodes: the core (changed, reached, with a finding), then its neighbours, then, with `whole`, the best
    connected others; in order of name within each. nodes(id, core)."""
    core = nodes.filter("core").select("id")
    e = edges.select("src", "dst").distinct()
    near = e.join(core.select(C("id").alias("dst")), "dst", "left_semi").select(C("src").alias("id")).unionByName(e.join(core.select(C("id").alias("src")), "src", "left_semi").select(C("dst").alias("id"))).distinct()
    degree = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    tier = F.when(C("core"), 0).when(C("near"), 1).otherwise(2)
    ranked = nodes.join(near.withColumn("near", F.lit(True)), "id", "left").join(degree, "id", "left").withColumn("tier", tier)
    order = [C("tier"), F.when(C("tier") == 2, -F.coalesce("degree", F.lit(0))).otherwise(0), C("id")]
    return (ranked if whole else ranked.filter("tier < 2")).orderBy(*order).limit(limit).select("id")


def subgraph(edges: DataFrame, start: DataFrame, back: int = 2, ahead: int = 1, cap: int = 300) -> DataFrame:
    """G2. node, hops: what start(node) is used by and uses, the nearest `cap` of it; ties to the lesser name."""
    near = graph.reach(edges, start, ahead).unionByName(graph.reach(edges, start, back, backward=True)).groupBy("node").agg(F.min("hops").alias("hops"))
    return near.orderBy("hops", "node").limit(cap)


def details(changes: DataFrame) -> DataFrame:
    """P11. changes with a text that says what happened."""
    was = lambda c: C(f"before.{c}")
    now = lambda c: C(f"after.{c}")
    text = (
        F.when(C("kind") == "renamed", F.concat(F.lit("was "), C("old_name")))
        .when(C("kind") == "signature", F.concat(F.coalesce(was("signature"), F.lit("")), F.lit(" -> "), F.coalesce(now("signature"), F.lit(""))))
        .when(C("kind") == "value", F.concat(was("value"), F.lit(" -> "), now("value")))
        .when(C("kind") == "body", "same signature, another body")
        .when(C("kind") == "added", "new")
        .otherwise("gone")
    )
    return changes.withColumn("detail", text)


def text(report: check.Report, against: str = "before") -> str:
    """K2. A report as a terminal shows it, with capped lists and how much more there is."""
    b = brief.brief(report)
    out = [f"driftwake: {b['verdict'].upper()} (against {against})"]

    def more(n: int) -> list[str]:
        return [f"    ... and {n} more"] if n else []

    if b["changes"]:
        out += ["", "  changes", *(f"    {c['kind']:<9}  {c['name']}  {c['path']}:{c['line']}" for c in b["changes"]), *more(b["omitted"]["changes"])]
    if b["affected"]:
        out += ["", "  reaches", *(f"    {a['score']:.2f}  {a['hops']} hop{'s' * (a['hops'] != 1):<1}  {a['name']}  {a['path']}:{a['line']}" for a in b["affected"]), *more(b["omitted"]["affected"])]
    out += ["", "  checklist", *([] if b["findings"] else ["    nothing to check in what this change touched"])]
    for f in b["findings"]:
        fix = registry.RULES[f["rule"]].fix if f["rule"] in registry.RULES else ""
        out += [f"    [ ] {f['severity'].upper():<8} {f['rule']}  {f['path']}:{f['line']}", f"        {f['message']}", *([f"        fix: {fix}"] if fix else [])]
    errors = report.errors.orderBy("path").limit(20).collect()
    return "\n".join(out + more(b["omitted"]["findings"]) + (["", "  not checked", *(f"    {e['path'] or e['rule']}: {e['message']}" for e in errors)] if errors else []))


def scoreboard(steps_: DataFrame) -> DataFrame:
    """A16. incident, status of each, and how many of each status: CAUGHT if all that is expected was found and nothing that is not
    to be, MISSED if some expected one was not, NOISY otherwise. steps_(incident, expected array, unexpected array, found array)."""
    missing = F.size(F.array_except("expected", "found"))
    noise = F.size(F.array_intersect("unexpected", "found"))
    per = steps_.groupBy("incident").agg(F.sum(missing).alias("missed"), F.sum(noise).alias("noise"))
    status = F.when(C("missed") > 0, "MISSED").when(C("noise") > 0, "NOISY").otherwise("CAUGHT")
    return per.select("incident", status.alias("status")).withColumn("of_status", F.count("*").over(Window.partitionBy("status")))


def suppressed(findings: DataFrame, marks: DataFrame, globs: list[str], accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P8. (kept, gone with a reason): by a mark on the line or alone above it (an empty rule silences all), a glob of an ignore file, or
    an accepted fingerprint. findings(rule, path, line, message), marks(path, line, rule, alone), accepted(fingerprint)."""
    m = marks.select("path", "line", C("rule").alias("of")).unionByName(marks.filter("alone").select("path", (C("line") + 1).alias("line"), C("rule").alias("of")))
    hit = findings.join(m, ["path", "line"]).filter((C("of") == "") | (C("of") == C("rule"))).select("rule", "path", "line", "message").distinct().withColumn("marked", F.lit(True))
    f = findings.join(hit, ["rule", "path", "line", "message"], "left").withColumn("fingerprint", T.short_hash("rule", "path", "message"))
    f = f.join(accepted.select("fingerprint", F.lit(True).alias("known")).distinct(), "fingerprint", "left")
    reason = F.when(C("marked"), "mark").when(T.excluded(C("path"), globs), "ignored path").when(C("known"), "accepted")
    f = f.withColumn("reason", reason).drop("marked", "known", "fingerprint")
    return f.filter("reason IS NULL").drop("reason"), f.filter("reason IS NOT NULL")


def ago(seconds: Column) -> Column:
    """F15. just now, 5 min ago, 3 h ago, 2 d ago."""
    n = lambda d: F.floor(seconds / d).cast("string")
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(n(60), F.lit(" min ago"))).when(seconds < 86400, F.concat(n(3600), F.lit(" h ago"))).otherwise(F.concat(n(86400), F.lit(" d ago")))


def listing(items: Column, most: int) -> Column:
    """F15. a, b and 3 more."""
    rest = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(""))

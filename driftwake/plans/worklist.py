"""Plan, progress, done (E3): edits placed and made in memory, what they need besides, and what is left.

A plan is a row of JSON in a store that is a folder of versions (K6), so that what was planned outlives the session."""

from __future__ import annotations

import difflib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwake.functions import text as T
from driftwake.operators import spans
from driftwake.plans import check
from driftwake.sources import lines

C = F.col
REBUILD = ("copybook-layout-changed", "struct-layout-change")
RULED_OUT, LEAST_SHOWN = 40, 3


class PlanError(ValueError):
    """An edit that cannot be placed."""


def placed(texts: dict[str, str], edits: list[dict]) -> dict[str, str]:
    """The edited files' texts: each edit's old text must stand exactly once in its file, as it is or with the file's line ends."""
    out = dict(texts)
    for e in edits:
        path, old, new = e["path"], e["old"], e["new"]
        if path not in out:
            raise PlanError(f"{path} is not in the project")
        crlf = old.replace("\n", "\r\n")
        fits = [o for o in dict.fromkeys((old, crlf)) if o and out[path].count(o) == 1]
        if not fits:
            n = max(out[path].count(o) if o else 0 for o in (old, crlf))
            rows = [x.strip() for x in out[path].splitlines()]
            near = difflib.get_close_matches((old.strip().splitlines() or [""])[0], rows, 3, 0.6)
            raise PlanError(f"the old text stands {n} times in {path}" + (f"; lines like it: {' | '.join(near)}" if near and not n else ""))
        out[path] = out[path].replace(fits[0], new.replace("\n", "\r\n") if fits[0] != old else new)
    return out


def unchanged_uses(changes: DataFrame, edges: DataFrame, defs_after: DataFrame, covered: DataFrame) -> DataFrame:
    """J38. path, line, who, uses, how: uses of what changed that no item of the plan covers (covered: path, first, last) and that need
    nothing."""
    there = changes.join(defs_after.select("name"), "name", "left_semi").select(C("name").alias("dst")).distinct()
    used = edges.join(there, "dst").groupBy("path", "line", C("dst").alias("uses")).agg(F.min(F.struct(C("src").alias("who"), F.concat("kind", F.when(C("guess"), " (a guess)").otherwise("")).alias("how"))).alias("u"))
    used = used.select("path", "line", "u.who", "uses", "u.how")
    inside = spans.in_spans(used, covered.select("path", C("first").alias("start"), C("last").alias("end")), "path", "line")
    return used.join(inside.select("path", "line").distinct(), ["path", "line"], "left_anti")


def include_targets(includes: DataFrame, files: DataFrame) -> DataFrame:
    """J39. path, line, target: the file that an include line names, by its last part whatever its case; of several the one under the
    includer's own folder, then the shortest. includes(path, line, named), files(path)."""
    base = lambda c: F.lower(F.substring_index(F.regexp_replace(c, r"\\", "/"), "/", -1))
    there = files.select(C("path").alias("target"), base(C("path")).alias("base")).distinct()
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    j = includes.withColumn("base", base(C("named"))).join(there, "base")
    near = F.struct((~C("target").startswith(folder)).alias("far"), F.char_length("target").alias("n"), "target")
    return j.groupBy("path", "line").agg(F.min_by("target", near).alias("target"))


def declarations(fields: DataFrame, names: DataFrame) -> DataFrame:
    """J39. name, path, line: where a field's own line is; fields(name, path, line), the first of equal ones."""
    return names.select("name").distinct().join(fields, "name").groupBy("name").agg(F.min(F.struct("path", "line")).alias("at")).select("name", "at.path", "at.line")


def ruled_out(sites: DataFrame, budget: int = RULED_OUT, least: int = LEAST_SHOWN) -> tuple[DataFrame, DataFrame]:
    """A13. (why, count, where), greatest groups first, that share a budget of places shown, `least` each at any rate; and how many are
    not shown. sites(why, path, line)."""
    groups = sites.groupBy("why").agg(F.count("*").alias("size"))
    w = Window.orderBy(F.desc("size"), "why").rowsBetween(Window.unboundedPreceding, -1)  # a row a reason, a dozen at most
    # places shown count against the budget, not the sizes, so the number left is worked out group by group
    spent = F.coalesce(F.sum(F.least("size", F.lit(budget))).over(w), F.lit(0))
    shown = groups.withColumn("shown", F.least("size", F.greatest(F.lit(budget) - spent, F.lit(least))))
    place = Window.partitionBy("why").orderBy("path", "line")
    kept = sites.withColumn("n", F.row_number().over(place)).join(shown, "why").filter(C("n") <= C("shown"))
    out = kept.groupBy("why", "size").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("p")).select("why", C("size").alias("count"), F.transform("p", lambda x: F.concat(x["path"], F.lit(":"), x["line"].cast("string"))).alias("where"))
    return out.orderBy(F.desc("count"), "why"), shown.agg(F.sum(C("size") - C("shown")).alias("not_shown"))


def coverage(files: DataFrame) -> DataFrame:
    """A8. language, files."""
    return files.groupBy(F.coalesce(T.language(C("path")), F.lit("python")).alias("language")).agg(F.count("*").alias("files"))


def ranges(numbers: DataFrame, by: str, n: str) -> DataFrame:
    """W7. by, lines: runs of numbers as text, such as 3-5,9."""
    runs = spans.islands(numbers, n, [by])
    text = F.when(C("first") == C("last"), C("first").cast("string")).otherwise(F.concat(C("first").cast("string"), F.lit("-"), C("last").cast("string")))
    return runs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("first", text.alias("t")))).alias("r")).select(by, F.array_join(F.transform("r", lambda x: x["t"]), ",").alias("lines"))


def _snapshot(files: DataFrame, name: str) -> DataFrame:
    return files.filter(C("snapshot") == name).select("path", "text")


def edited(files: DataFrame, base: str, edits: list[dict], as_: str = "planned") -> DataFrame:
    """The base's files and, under another snapshot, the same with the edits made."""
    spark = files.sparkSession
    names = sorted({e["path"] for e in edits})
    texts = {r["path"]: r["text"] for r in _snapshot(files, base).filter(C("path").isin(*names)).collect()}  # the files a plan names
    made = spark.createDataFrame(list(placed(texts, edits).items()), "path string, text string")
    rest = _snapshot(files, base).join(made.select("path"), "path", "left_anti").unionByName(made)
    return _snapshot(files, base).select(F.lit(base).alias("snapshot"), "path", "text").unionByName(rest.select(F.lit(as_).alias("snapshot"), "path", "text"))


def plan(files: DataFrame, base: str, edits: list[dict], **settings) -> dict:
    """What the edits need besides: places to edit, to rebuild, notes, uses that need nothing, mentions that are no uses, coverage."""
    both = edited(files, base, edits)
    report = check.check(both, base, "planned", **settings)
    found = report.findings.collect()  # a plan's findings are a worklist, read whole
    item = lambda r: {k: r[k] for k in ("rule", "path", "line", "message")}
    todo = [item(r) for r in found if r["rule"] not in REBUILD and r["severity"] in ("critical", "high")]
    spark = files.sparkSession
    cover = spark.createDataFrame([(t["path"], t["line"], t["line"]) for t in todo], "path string, first int, last int")
    names = report.changes.filter("kind <> 'added'").select("name", "path", "line", "end_line")
    uses = unchanged_uses(report.changes, report.edges, names, cover)
    after = _snapshot(both, "planned")
    short = names.select(F.substring_index("name", ".", -1).alias("name"), C("path").alias("own"), "line", "end_line")
    said = lines.mentions(after, short.select("name"))
    known = report.edges.select("path", "line").unionByName(cover.select("path", C("first").alias("line"))).distinct()
    comment = lines.masked(after).select("path", F.posexplode(F.split("text", "\n")).alias("at", "row")).select("path", (C("at") + 1).alias("line"), "row")
    left = said.join(known, ["path", "line"], "left_anti").join(short, (C("own") == said["path"]) & (short["name"] == said["name"]) & said["line"].between(short["line"], short["end_line"]), "left_anti").join(comment, ["path", "line"])
    why = F.when(F.regexp_like("row", lines.whole_word(C("name"), F.lit("python"))), F.concat(F.lit("no reference to "), "name", F.lit(" is read here"))).otherwise("a comment or a text")
    reasons, more = ruled_out(left.select(why.alias("why"), "path", "line"))
    return {
        "against": base, "edits": edits, "verdict": report.verdict.head()["verdict"], "edit": todo, "recompile": [item(r) for r in found if r["rule"] in REBUILD],
        "notes": [item(r) for r in found if r["rule"] not in REBUILD and r["severity"] not in ("critical", "high")],
        "unchanged": [r.asDict() for r in uses.orderBy("path", "line", "uses").collect()], "ruled_out": [r.asDict() for r in reasons.collect()], "not_shown": more.head()[0] or 0,
        "by_language": {r["language"]: r["files"] for r in coverage(after).collect()}, "not_read": [r["path"] for r in report.errors.collect()],
    }


def save(spark: SparkSession, store: str, name: str, plan_: dict) -> None:
    """K6. The store is a folder of JSON tables, one a plan's name, replaced as a whole."""
    spark.createDataFrame([(json.dumps(plan_),)], "plan string").coalesce(1).write.mode("overwrite").text(f"{store}/plan={name}")


def load(spark: SparkSession, store: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{store}/plan={name}").head()[0])


def progress(files: DataFrame, now: str, saved: dict, **settings) -> dict:
    """Where the working files stand: planned edits not made yet, and what a check of base to now (with these made) still asks for."""
    names = sorted({e["path"] for e in saved["edits"]})
    texts = {r["path"]: r["text"] for r in _snapshot(files, now).filter(C("path").isin(*names)).collect()}
    waiting = [e for e in saved["edits"] if e["new"] not in texts.get(e["path"], "") and e["old"] in texts.get(e["path"], "")]
    made = edited(files, now, waiting, "made").filter("snapshot = 'made'") if waiting else _snapshot(files, now).select(F.lit("made").alias("snapshot"), "path", "text")
    base = _snapshot(files, saved["against"]).select(F.lit("base").alias("snapshot"), "path", "text")
    report = check.check(base.unionByName(made), "base", "made", **settings)
    left = [{k: r[k] for k in ("rule", "path", "line", "message")} for r in report.findings.filter("severity IN ('critical', 'high')").collect()]
    return {"planned_not_made": waiting, "left": left, "done": not waiting and not left}


def done(files: DataFrame, now: str, saved: dict, **settings) -> dict:
    """progress, and, once nothing is left, every line that changed, by file."""
    out = progress(files, now, saved, **settings)
    if out["done"]:
        changed = lines.changed_lines(_snapshot(files, saved["against"]), _snapshot(files, now))
        rows = changed.select("path", F.explode(F.when(C("last") >= C("first"), F.sequence("first", "last")).otherwise(F.array().cast("array<int>"))).alias("n"))
        text = {r["path"]: r["lines"] for r in ranges(rows, "path", "n").collect()}
        out["changed"] = {r["path"]: text.get(r["path"], "deleted lines only") for r in changed.select("path").distinct().collect()}
    return out

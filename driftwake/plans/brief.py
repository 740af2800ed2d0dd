"""Short lists and outputs of a report (A2, A3, A6, A7, A17, J23, 2.7, K1-K4)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.functions import text as T
from driftwake.operators import graph, ranking
from driftwake.plans.check import Report
from driftwake.values import VAGUE

DO_FIRST, CHANGES_SHOWN, AFFECTED_SHOWN, FILES_SHOWN = 8, 12, 10, 200
FEW_WORDS = 100_000


def python_round(x: float, digits: int = 2) -> float:
    """Scores are shown as Python rounds them (0.855 is 0.85), which SQL's rounding is not."""
    return round(x, digits)


def first(df: DataFrame, k: int, *order) -> tuple[list, int]:
    """The first k rows and how many more there are; k rows and a count come to the driver."""
    rows = df.orderBy(*order).limit(k).collect()
    return rows, max(0, df.count() - len(rows)) if len(rows) == k else 0


def brief(report: Report) -> dict:
    """K1. What to look at first, as plain data."""
    kind = F.array_position(F.array(*(F.lit(k) for k in ("removed", "renamed", "signature", "value", "body", "added"))), F.col("kind"))
    found, more = first(report.findings, DO_FIRST, "rank", ~F.col("blocking"), "path", "line", "rule")
    changed, more_changes = first(report.changes, CHANGES_SHOWN, kind, "path", "line")
    hit, more_hit = first(report.affected, AFFECTED_SHOWN, F.desc("score"), "hops", "name")
    paths, more_paths = first(report.changes.select("path").distinct(), FILES_SHOWN, "path")
    return {
        "verdict": report.verdict.head()["verdict"],
        "counts": ranking.severity_counts(report.findings).head().asDict(),
        "files_changed": [r["path"] for r in paths],
        "findings": [{k: r[k] for k in ("rule", "severity", "path", "line", "message")} for r in found],
        "changes": [{k: r[k] for k in ("kind", "name", "path", "line")} for r in changed],
        "affected": [{"name": r["name"], "path": r["path"], "line": r["line"], "hops": r["hops"], "score": python_round(r["score"])} for r in hit],
        "suppressed": report.suppressed.count(),
        "omitted": {"findings": more, "changes": more_changes, "affected": more_hit, "files": more_paths},
    }


def markdown(b: dict) -> str:
    """K3. A task list; text outside code spans is escaped."""
    safe = lambda s: "".join("\\" + c if c in "\\`*_{}[]<>#|" else c for c in s)
    lines = [f"**{b['verdict']}** " + ", ".join(f"{n} {s}" for s, n in b["counts"].items() if n)]
    lines += [f"- [ ] **{f['severity']}** {safe(f['message'])} (`{f['path']}:{f['line']}`, {f['rule']})" for f in b["findings"]]
    if b["omitted"]["findings"]:
        lines.append(f"- ... and {b['omitted']['findings']} more")
    if b["affected"]:
        lines += ["", f"<details><summary>{len(b['affected'])} affected</summary>", ""]
        lines += [f"- `{a['name']}` {a['score']:.2f}, {a['hops']} hop{'s' * (a['hops'] != 1)}" for a in b["affected"]] + ["", "</details>"]
    return "\n".join(lines) + "\n"


def sarif(findings: DataFrame) -> DataFrame:
    """K4. One JSON result a row, with a fingerprint that does not depend on the line's number."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(T.short_hash("rule", "path", "message").alias("primary")).alias("partialFingerprints"))
    return findings.select(F.to_json(result).alias("result"))


SARIF_SHOWN = 5000


def sarif_log(findings: DataFrame, tool: str = "driftwake") -> str:
    """One log of the gravest findings, SARIF_SHOWN at most, as readers of such logs bound them too; all of them are in sarif()."""
    from driftwake.operators.ranking import rank

    gravest = findings.orderBy(rank(F.col("severity")), "path", "line", "rule").limit(SARIF_SHOWN)
    results = [json.loads(r["result"]) for r in sarif(gravest).collect()]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool}}, "results": results}]})


def reached_files(edges: DataFrame, defs: DataFrame, name: str, hops: int = 6) -> DataFrame:
    """A17. Of each file that a change of `name` can reach: how many definitions, and the nearest hop."""
    start = edges.sparkSession.createDataFrame([(name,)], "node string")
    got = graph.reach(edges.select("src", "dst"), start, hops, backward=True).filter("hops > 0")
    return got.join(defs.select(F.col("name").alias("node"), "path"), "node").groupBy("path").agg(F.count("*").alias("definitions"), F.min("hops").alias("nearest"))


def uses_of(edges: DataFrame, name: str, outward: bool = False) -> DataFrame:
    """J23. Who uses a name (or what it uses), by kind, with the places; guess only if every edge is one."""
    one, other = ("src", "dst") if outward else ("dst", "src")
    place = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    return edges.filter(F.col(one) == name).groupBy(F.col(other).alias("name"), "kind").agg(F.array_sort(F.collect_set(place)).alias("sites"), F.bool_and("guess").alias("guess"))


def look_for(defs: DataFrame) -> DataFrame:
    """word and context of definitions(name, kind, path): the name that a test would use, and, where that is too short or common to
    mean this one alone, the class or module that has to be named too."""
    parts = F.split(F.regexp_replace(F.regexp_replace("name", r"^[^@]*@", ""), r"\(.*$", ""), r"\.")
    word, owner = F.element_at(parts, -1), F.when(F.size(parts) > 1, F.element_at(parts, -2))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\..*$", "")
    module = F.when(F.col("path").endswith(".py"), F.substring_index(T.module_name(F.col("path")), ".", -1)).otherwise(stem)
    context = F.when((F.col("kind") == "method") & owner.isNotNull(), owner).otherwise(module)
    special, vague = word.rlike("^__.*__$|^<"), (F.char_length(word) < 4) | F.lower(word).isin(*VAGUE)
    return defs.withColumn("word", F.when(special, context).otherwise(word)).withColumn("context", F.when(special, "").when(vague, context).otherwise(""))


def tests_to_run(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """A7. Test files that name what changed or is reached: path, tier (0 changed, 1 reached), the words they name.

    files(path, text) of one snapshot; wanted(word, tier[, context]): a word with a context counts only where that is named too."""
    if "context" not in wanted.columns:
        wanted = wanted.withColumn("context", F.lit(""))
    asked = graph.cut(wanted.groupBy("word", "context").agg(F.min("tier").alias("tier")))
    few = (lambda df: F.broadcast(df)) if asked.count() <= FEW_WORDS else (lambda df: df)
    # words that anything asks for, one row each; a row of files is known by its path and the hash of its text
    needed = asked.select(F.explode(F.array("word", "context")).alias("word")).distinct()
    words = files.filter(T.is_test_file(F.col("path"))).select("path", F.xxhash64("text").alias("own"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    said = graph.cut(words.join(few(needed), "word", "left_semi"))
    hit = said.join(few(asked), "word")
    within = hit.filter("context <> ''").join(said.select("path", "own", F.col("word").alias("context")), ["path", "own", "context"], "left_semi")
    hit = hit.filter("context = ''").select("path", "tier", "word").unionByName(within.select("path", "tier", "word"))
    return hit.groupBy("path").agg(F.min("tier").alias("tier"), F.array_sort(F.collect_set("word")).alias("names"))

"""Work of several people put together (U1-U4, J21, J22, E2): what only the combination breaks.

All members and all pairs of members go through one check; `pair` tells them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwake.operators import changes, graph
from driftwake.plans import check

KEY = ["rule", "path", "line", "message"]
C = F.col


def pairs(members: DataFrame, name: str = "name") -> DataFrame:
    """J21. Each two members once: as many rows as the square of the team, which is people, not data."""
    a, b = members.select(C(name).alias("a")).distinct(), members.select(C(name).alias("b")).distinct()
    return a.join(b, C("a") < C("b"))


def _lines(text: str = "text"):
    return F.regexp_replace(text, "\r\n", "\n")


def joined(files: DataFrame, base: str, mine: str, theirs: str, as_: str) -> DataFrame:
    """U3. Files of two members over one base: mine, and what only they changed; snapshot, path, text."""
    side = lambda s: files.filter(C("snapshot") == s).select("path", _lines().alias("text"))
    out = changes.overlay(side(base), side(mine), side(theirs), "path", "text")
    return out.select(F.lit(as_).alias("snapshot"), "path", "text")


def both_edited(files: DataFrame, base: str, mine: str, theirs: str) -> DataFrame:
    """U4. Paths that both changed, to different texts."""
    side = lambda s: files.filter(C("snapshot") == s).select("path", _lines().alias("text"))
    return changes.overlay(side(base), side(mine), side(theirs), "path", "text").filter("conflict").select("path")


def edits(files: DataFrame, base: str, members: DataFrame) -> DataFrame:
    """name, path, text: what each of members(name) changed against the base; a null text is a deletion."""
    old = files.filter(C("snapshot") == base).select("path", _lines().alias("was"))
    own = files.join(members.select(C("name").alias("snapshot")), "snapshot", "left_semi").select(C("snapshot").alias("name"), "path", _lines().alias("text"))
    changed = own.join(old, "path", "left").filter(~C("was").eqNullSafe(C("text"))).select("name", "path", "text")
    # who lacks a file of the base: of each path the team less those who have it
    team = members.agg(F.collect_set("name").alias("team"))  # one row, of people
    have = own.groupBy("path").agg(F.collect_set("name").alias("have"))
    lack = F.array_except("team", F.coalesce("have", F.array().cast("array<string>")))
    gone = old.select("path").join(have, "path", "left").join(F.broadcast(team)).select(F.explode(lack).alias("name"), "path", F.lit(None).cast("string").alias("text"))
    return changed.unionByName(gone)


def joint_files(files: DataFrame, base: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, pairs(a, b, snapshot)): the base's files and, for each two members, a's work with what only b changed."""
    two = graph.cut(pairs(members).withColumn("snapshot", F.concat("a", F.lit("+"), "b")))
    work = graph.cut(edits(files, base, members))
    mine = two.join(work.withColumnRenamed("name", "a"), "a").select("snapshot", "path", "text")
    theirs = two.join(work.withColumnRenamed("name", "b"), "b").select("snapshot", "path", "text").join(mine.select("snapshot", "path"), ["snapshot", "path"], "left_anti")
    both = mine.unionByName(theirs)
    still = two.select("snapshot").join(files.filter(C("snapshot") == base).select("path", "text")).join(both.select("snapshot", "path"), ["snapshot", "path"], "left_anti")
    return still.unionByName(both.filter("text IS NOT NULL")).select("snapshot", "path", "text"), two


def live(files: DataFrame, base: str, members: list[str], **settings) -> DataFrame:
    """E2. a, b, and the findings that only their combination has, for all pairs."""
    spark = files.sparkSession
    people = spark.createDataFrame([(m,) for m in sorted(set(members))], "name string")
    joint, two = joint_files(files, base, people)
    every = files.filter(C("snapshot").isin(base, *members)).select("snapshot", "path", "text").unionByName(joint)
    asked = people.select(C("name").alias("pair")).unionByName(two.select(C("snapshot").alias("pair")))
    report = check.checks(graph.cut(every), asked.select("pair", F.lit(base).alias("before"), C("pair").alias("after")), **settings)
    found = report.findings.join(two.withColumnRenamed("snapshot", "pair"), "pair")
    alone = report.findings.join(people.withColumnRenamed("name", "pair"), "pair").select("pair", *KEY)
    for who in ("a", "b"):
        found = found.join(alone.withColumnRenamed("pair", who), [who, *KEY], "left_anti")
    return found.select("a", "b", "rule", "severity", "path", "line", "message")


def combination(files: DataFrame, base: str, mine: str, theirs: str) -> tuple[check.Report, DataFrame]:
    """The joint report, and the findings that neither has alone."""
    spark = files.sparkSession
    both = graph.cut(files.filter(C("snapshot").isin(base, mine, theirs)).select("snapshot", "path", "text").unionByName(joined(files, base, mine, theirs, "joint")))
    asked = spark.createDataFrame([(s, base, s) for s in (mine, theirs, "joint")], "pair string, before string, after string")
    report = check.checks(both, asked)
    one = report.of("joint")
    return one, changes.only_in(one.findings, *(report.of(s).findings for s in (mine, theirs)), on=KEY)


def all_together(files: DataFrame, base: str, members: list[str]) -> DataFrame:
    """J22/W2. Every changed path with its text by the first member, in order of names, that changed it; overlap tells
    that others did too."""
    old = files.filter(C("snapshot") == base).select("path", C("text").alias("base_text"))
    mine = files.filter(C("snapshot").isin(*members)).join(old, "path", "left").filter(~C("text").eqNullSafe(C("base_text")))
    w = Window.partitionBy("path").orderBy("snapshot")
    ranked = mine.withColumn("n", F.row_number().over(w)).withColumn("overlap", F.count("*").over(Window.partitionBy("path")) > 1)
    return ranked.filter("n = 1").select("path", C("snapshot").alias("owner"), "text", "overlap")

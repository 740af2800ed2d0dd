"""Where versions of a code base come from."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.functions.text import SKIPPED, in_skipped_dir, language

FILES = "snapshot string, path string, text string"


def in_memory(spark: SparkSession, snapshots: dict[str, dict[str, str]]) -> DataFrame:
    """S3. {snapshot: {path: text}}"""
    return spark.createDataFrame([(s, p, t) for s, files in snapshots.items() for p, t in files.items()], FILES)


def directory(spark: SparkSession, folder: str, snapshot: str) -> DataFrame:
    """S1/S9. A working tree by Spark's own reader, with each file's stamp; directories that scans leave out are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    at = F.locate(root + "/", "path")
    path = F.substr("path", at + len(root) + 1)
    df = raw.filter(at > 0).select(F.lit(snapshot).alias("snapshot"), path.alias("path"), "content", "modificationTime", "length")
    df = df.filter(~in_skipped_dir(F.col("path")) & language(F.col("path")).isNotNull())
    return df.select("snapshot", "path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"), "modificationTime", "length")


def changed_stamps(now: DataFrame, last: DataFrame) -> DataFrame:
    """S9/T7. Files whose stamp is not the one of the last run: all that needs reading again."""
    return now.join(last.select("path", "modificationTime", "length"), ["path", "modificationTime", "length"], "left_anti")


def git_revision(spark: SparkSession, repository: str, revision: str, prefix: str = "", snapshot: str | None = None, per_task: int = 500) -> DataFrame:
    """S2. A revision of a git repository that all executors can read. Names are listed once and filtered by prefix, suffix and
    directory before any blob is read; each task reads its blobs through one `git cat-file --batch`."""
    listed = subprocess.run(["git", "-C", repository, "ls-tree", "-r", "-z", revision, "--", *([prefix] if prefix else [])], capture_output=True, check=True).stdout.decode()
    names = [(e.split("\t", 1)[0].split()[2], e.split("\t", 1)[1]) for e in listed.split("\0") if e and e.split()[1] == "blob"]
    rows = spark.createDataFrame(names or [("", "")], "sha string, path string").filter(language(F.col("path")).isNotNull() & ~in_skipped_dir(F.col("path")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = subprocess.run(["git", "-C", repository, "cat-file", "--batch"], input="\n".join(part["sha"]).encode() + b"\n", capture_output=True, check=True).stdout
            texts, at = [], 0
            for _ in range(len(part)):
                end = got.index(b"\n", at)
                size = int(got[at:end].split()[2])
                texts.append(got[end + 1 : end + 1 + size].decode("utf-8-sig", "replace"))
                at = end + size + 2
            yield pd.DataFrame({"snapshot": snapshot or revision, "path": [p.removeprefix(prefix).lstrip("/") if prefix else p for p in part["path"]], "text": texts})

    return rows.repartition(max(1, len(names) // per_task)).mapInPandas(run, FILES)


def git_history(spark: SparkSession, repository: str, most: int = 300) -> DataFrame:
    """S4. (commit, path) of the last commits that are no merges: a bounded list, as `most` says."""
    log = subprocess.run(["git", "-C", repository, "log", "--no-merges", f"-{most}", "--name-only", "--format=%x1e%H"], capture_output=True, check=True).stdout.decode()
    raw = spark.createDataFrame([(r,) for r in log.split("\x1e") if r.strip()] or [("",)], "record string")
    lines = raw.select(F.filter(F.split("record", "\n"), lambda x: x != "").alias("l")).filter(F.size("l") > 1)
    return lines.select(F.get("l", F.lit(0)).alias("commit"), F.explode(F.slice("l", 2, 100000)).alias("path"))


def refs(spark: SparkSession, repository: str, prefix: str = "refs/wip/") -> DataFrame:
    """S7. name, sha of the refs under a prefix: what a feed polls (T1) and keeps the last sha of."""
    told = subprocess.run(["git", "-C", repository, "for-each-ref", "--format=%(refname) %(objectname)", prefix], capture_output=True, check=True).stdout.decode()
    rows = [(line.split()[0].removeprefix(prefix), line.split()[1]) for line in told.splitlines()]
    return spark.createDataFrame(rows, "name string, sha string")


def moved(now: DataFrame, last: DataFrame) -> DataFrame:
    """T2. Refs that are new or point elsewhere than at the last poll: all that has to be read again."""
    return now.join(last.select("name", "sha"), ["name", "sha"], "left_anti")


def changed_paths(files: DataFrame, before: str, after: str) -> DataFrame:
    """U2. Paths that differ between two snapshots, line endings apart."""
    side = lambda s, c: files.filter(F.col("snapshot") == s).select("path", F.regexp_replace("text", "\r\n", "\n").alias(c))
    return side(before, "b").join(side(after, "a"), "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path")


__all__ = ["FILES", "SKIPPED", "changed_paths", "changed_stamps", "directory", "git_history", "git_revision", "in_memory", "moved", "refs"]

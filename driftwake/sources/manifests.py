"""Dependency manifests and settings."""

from __future__ import annotations

import ast
import configparser
import re
import sys
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.functions.text import distribution
from driftwake.values import OTHER_NAMES

MANIFEST = r"(^|/)(pyproject\.toml|requirements[^/]*\.(txt|in)|requirements/[^/]+\.(txt|in)|setup\.cfg|setup\.py|Pipfile|environment\.ya?ml)$"
NAME = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)")


def names_in(path: str, text: str) -> tuple[list[str], bool]:
    """Distributions that a manifest declares, and whether that is all of them."""
    base = path.rsplit("/", 1)[-1]
    try:
        if base == "pyproject.toml":
            d = tomllib.loads(text)
            p = d.get("project", {})
            poetry = d.get("tool", {}).get("poetry", {})
            specs = [*p.get("dependencies", []), *(x for v in p.get("optional-dependencies", {}).values() for x in v), *(x for v in d.get("dependency-groups", {}).values() for x in v if isinstance(x, str))]
            specs += [k for g in [poetry, *poetry.get("group", {}).values()] for k in (*g.get("dependencies", {}), *g.get("dev-dependencies", {})) if k != "python"]
            return specs, "dependencies" not in p.get("dynamic", [])
        if re.fullmatch(r"requirements.*\.(txt|in)", base) or re.search(r"(^|/)requirements/[^/]+\.(txt|in)$", path):
            lines = [x.split("#")[0].strip() for x in text.splitlines()]
            return [x for x in lines if x and not x.startswith("-")], not any(x.startswith(("-r", "-c")) for x in lines)
        if base == "setup.cfg":
            c = configparser.ConfigParser()
            c.read_string(text)
            return [x for s in ("options", "options.extras_require") if c.has_section(s) for k, v in c.items(s) if s != "options" or k == "install_requires" for x in v.splitlines() if x.strip()], True
        if base == "Pipfile":
            d = tomllib.loads(text)
            return [*d.get("packages", {}), *d.get("dev-packages", {})], True
        if base == "setup.py":
            out, sure = [], True
            for n in ast.walk(ast.parse(text)):
                if isinstance(n, ast.keyword) and n.arg == "install_requires":
                    try:
                        out += ast.literal_eval(n.value)
                    except ValueError:
                        sure = False
            return out, sure
    except Exception:  # noqa: BLE001  what cannot be read declares nothing for certain
        return [], False
    return [], base not in ("environment.yml", "environment.yaml")


def declared(files: DataFrame) -> DataFrame:
    """snapshot, path, name, certain: a row a declared distribution; one with a null name tells of the manifest alone."""
    found = files.filter(F.col("path").rlike(MANIFEST)).select("snapshot", "path", "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for s, p, t in part.itertuples(index=False):
                names, sure = names_in(p, t)
                rows += [(s, p, m[1], sure) for x in names if (m := NAME.match(x))] or [(s, p, None, sure)]
            yield pd.DataFrame(rows, columns=["snapshot", "path", "name", "certain"])

    read = found.mapInPandas(run, "snapshot string, path string, name string, certain boolean")
    return read.withColumn("name", distribution(F.col("name")))


def third_party(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports with root and the distribution it should come from, less the standard library and the project's own."""
    root = F.substring_index("target", ".", 1)
    keys = [c for c in modules.columns if c != "module"]
    own = modules.select(*keys, F.substring_index("module", ".", 1).alias("root")).distinct()
    out = imports.withColumn("root", root).filter(~F.col("root").isin(*sorted(sys.stdlib_module_names)) & ~F.col("root").startswith("_")).join(own, [*keys, "root"], "left_anti")
    name = F.col("root")
    for module, dist in OTHER_NAMES.items():
        name = F.when(F.lower("root") == module, dist).otherwise(name)
    return out.withColumn("distribution", distribution(name))


TOOLING = r"(^|/)(tests?|docs?|examples?|scripts?|tools?|benchmarks?)/|(^|/)(conftest|setup|noxfile|tasks)\.py$"


def findings(imports: DataFrame, declared_: DataFrame) -> DataFrame:
    """U6 and U7, of each pair: new imports that no manifest declares (medium if only tooling needs them); dependencies taken
    out and still imported. Silent where a manifest is not certain, or there is none.

    imports(pair, side, path, line, root, distribution), declared_(pair, side, name, certain)."""
    now, old = (declared_.filter(F.col("side") == s) for s in ("after", "before"))
    sure = now.groupBy("pair").agg(F.bool_and("certain").alias("sure")).filter("sure").select("pair")
    here, there = (imports.filter(F.col("side") == s) for s in ("after", "before"))
    named = now.filter("name IS NOT NULL").select("pair", F.col("name").alias("distribution")).distinct()
    new = here.join(there.select("pair", "root").distinct(), ["pair", "root"], "left_anti")
    # A distribution may be named like a part of its module, or the other way round; manifests are short
    missing = new.join(named, ["pair", "distribution"], "left_anti").join(sure, "pair", "left_semi")
    near = named.withColumnRenamed("distribution", "listed")
    missing = missing.join(near, (missing["pair"] == near["pair"]) & (F.col("listed").startswith(F.concat("distribution", F.lit("-"))) | F.col("distribution").startswith(F.concat("listed", F.lit("-")))), "left_anti")
    lost = old.filter("name IS NOT NULL").select("pair", F.col("name").alias("distribution")).distinct().join(named, ["pair", "distribution"], "left_anti").join(sure, "pair", "left_semi")
    still = here.join(lost, ["pair", "distribution"], "left_semi")
    cols = lambda df, rule, severity, said: df.groupBy("pair", "path", "root").agg(F.min("line").alias("line")).select("pair", F.lit(rule).alias("rule"), severity.alias("severity"), F.concat("root", F.lit(said)).alias("message"), "path", "line")
    undeclared = cols(missing, "dependency-undeclared", F.when(F.col("path").rlike(TOOLING), "medium").otherwise("high"), " is imported and no manifest declares it")
    return undeclared.unionByName(cols(still, "dependency-removed-still-used", F.lit("critical"), " is no longer declared and still imported"))


def settings(text: str, table: str = "driftwake") -> dict:
    """S6. disable, exclude and fail-on of [tool.<table>] in a pyproject file."""
    got = tomllib.loads(text).get("tool", {}).get(table, {})
    listed = lambda k: [got[k]] if isinstance(got.get(k), str) else list(got.get(k, []))
    if not all(isinstance(x, str) for k in ("disable", "exclude") for x in listed(k)) or got.get("fail-on", "block") not in ("ok", "review", "block", "never"):
        raise ValueError(f"[tool.{table}]: disable and exclude are lists of strings; fail-on is ok, review, block or never")
    return {"disabled": tuple(listed("disable")), "excluded": listed("exclude"), "fail_on": got.get("fail-on", "block")}


def nearest_settings(files: DataFrame, folder: str, table: str = "driftwake") -> dict:
    """S6. Settings of the nearest pyproject file from a folder up to the top that has the table; none where none has."""
    at = folder.strip("/")
    ups = [at.rsplit("/", i)[0] if i else at for i in range(at.count("/") + 1)] if at else []
    paths = [*(f"{u}/pyproject.toml" for u in ups), "pyproject.toml"]
    texts = {r["path"]: r["text"] for r in files.filter(F.col("path").isin(*paths)).select("path", "text").collect()}  # one a folder on the way up
    for p in paths:
        if p in texts and table in tomllib.loads(texts[p]).get("tool", {}):
            return settings(texts[p], table)
    return settings("")

"""The registry of rules (2.14). A rule has an id, a severity, whether it can block, and a builder.

`@node_rule` builders return (condition, message, line) columns over the nodes of a file (line None: the node's own); all of
them are one pass over one table. `@rule` builders get a Context and return findings of the new version. Findings of both are
kept inside changed spans. `@change_rule` builders see both versions and their findings are kept as they are; they return
None where they have nothing to do. DataFrames have the keys of the context (pair), message, path, line, and severity if
it differs from the rule's. Ids are unique and severities known; a builder that raises costs its own findings alone and leaves
a row of errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.operators.ranking import SEVERITIES


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    build: Callable
    blocking: bool = False
    kind: str = "file"  # node, file, change
    fix: str = ""


RULES: dict[str, Rule] = {}


def _register(id_: str, severity: str, blocking: bool, fix: str, kind: str, into: dict[str, Rule]):
    if severity not in SEVERITIES:
        raise ValueError(f"{id_}: a severity is one of {', '.join(SEVERITIES)}, not {severity!r}")
    if id_ in into:
        raise ValueError(f"there is a rule {id_!r} already")

    def keep(build: Callable) -> Callable:
        into[id_] = Rule(id_, severity, build, blocking, kind, fix)
        return build

    return keep


def node_rule(id_: str, severity: str, blocking: bool = False, fix: str = "", into: dict[str, Rule] = RULES):
    return _register(id_, severity, blocking, fix, "node", into)


def rule(id_: str, severity: str, blocking: bool = False, fix: str = "", into: dict[str, Rule] = RULES):
    return _register(id_, severity, blocking, fix, "file", into)


def change_rule(id_: str, severity: str, blocking: bool = False, fix: str = "", into: dict[str, Rule] = RULES):
    return _register(id_, severity, blocking, fix, "change", into)


def of_nodes(nodes: DataFrame, rules: list[Rule], failed: list[tuple[str, str]]) -> DataFrame | None:
    """Every node's findings, by all rules at once."""
    hits = []
    for r in rules:
        try:
            own = [F.when(condition, F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), message.alias("message"), (F.col("line") if line is None else line).alias("line"))) for condition, message, line in r.build()]
            nodes.select(F.array(*own)).schema  # analysed here, so that a wrong column is this rule's own error
            hits += own
        except Exception as e:  # noqa: BLE001  see above
            failed.append((r.id, said(e)))
    if not hits:
        return None
    found = nodes.select("pair", "path", F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return found.select("pair", "f.rule", "f.severity", "f.message", "path", "f.line")


def said(e: Exception) -> str:
    return f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}"


def run(context, rules: dict[str, Rule] = RULES) -> tuple[DataFrame | None, DataFrame | None, list[tuple[str, str]]]:
    """(findings of rules of a file, findings of rules of a change, (rule, message) of those that failed)."""
    failed: list[tuple[str, str]] = []
    out: dict[str, DataFrame | None] = {"file": of_nodes(context.nodes, [r for r in rules.values() if r.kind == "node"], failed), "change": None}
    for r in rules.values():
        if r.kind == "node":
            continue
        try:
            found = r.build(context)
            if found is None:
                continue
            severity = F.col("severity") if "severity" in found.columns else F.lit(r.severity)
            id_ = F.col("rule") if "rule" in found.columns else F.lit(r.id)
            found = found.select("pair", id_.alias("rule"), severity.alias("severity"), "message", "path", "line")
            found.schema
        except Exception as e:  # noqa: BLE001  see above
            failed.append((r.id, said(e)))
            continue
        out[r.kind] = found if out[r.kind] is None else out[r.kind].unionByName(found)
    return out["file"], out["change"], failed

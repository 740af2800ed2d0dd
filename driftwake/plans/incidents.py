"""Queries over source files kept here: small versions of a project whose check has a known outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.plans import check
from driftwake.sources import facts, files

#: A decoder of rows gains a required parameter; one caller follows, one does not and would hide the error.
GAUGE = {
    "before": {
        "gauge/rows.py": "LAYOUT = 'v1'\n\n\ndef decode(raw):\n    return dict(zip(('id', 'value'), raw.split(',')))\n",
        "gauge/live.py": "from gauge.rows import decode\n\n\ndef newest(feed):\n    return decode(feed.last())\n",
        "gauge/store.py": "from gauge.rows import decode\n\n\ndef keep_all(lines):\n    kept = []\n    for line in lines:\n        try:\n            kept.append(decode(line))\n        except Exception:\n            pass\n    return kept\n\n\ndef nightly(lines):\n    return len(keep_all(lines))\n",
    },
    "after": {},
}
GAUGE["after"] = GAUGE["before"] | {
    "gauge/rows.py": "LAYOUT = 'v2'\n\n\ndef decode(raw, layout):\n    return dict(zip(layout, raw.split(',')))\n",
    "gauge/live.py": GAUGE["before"]["gauge/live.py"].replace("feed.last())", "feed.last(), ('id', 'value'))"),
}


def check_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, verdict on every row."""
    r = check.check(files.in_memory(spark, GAUGE))
    return r.findings.select("rule", "severity", "path", "line", "message").crossJoin(F.broadcast(r.verdict))


def check_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.check(files.in_memory(spark, GAUGE)).affected.withColumn("score", F.round("score", 4))


def s_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, imports and calls that the reader sees."""
    told = facts.facts(files.in_memory(spark, GAUGE)).filter("snapshot = 'after'")
    defs = facts.table(told, "def").select(F.lit("def").alias("fact"), "path", "line", F.concat_ws(" ", "kind", "name", "signature").alias("said"))
    imports = facts.table(told, "import").select(F.lit("import").alias("fact"), "path", "line", F.col("target").alias("said"))
    calls = facts.table(told, "use").filter("kind = 'calls' AND size(candidates) > 0").select(F.lit("call").alias("fact"), "path", "line", F.concat("src", F.lit(" "), F.get("candidates", F.lit(0)), F.lit(" "), F.col("positional").cast("string")).alias("said"))
    return defs.unionByName(imports).unionByName(calls)


QUERIES = {"check_incident": check_incident, "check_affected": check_affected, "s_facts": s_facts}

#: What the check must say of these files, written out.
ORACLE = {
    "s_facts": """SELECT fact, path, CAST(line AS INTEGER) AS line, said FROM (VALUES
        ('def', 'gauge/rows.py', 1, 'constant gauge.rows.LAYOUT '), ('def', 'gauge/rows.py', 4, 'function gauge.rows.decode (raw, layout)'), ('def', 'gauge/live.py', 4, 'function gauge.live.newest (feed)'),
        ('def', 'gauge/store.py', 4, 'function gauge.store.keep_all (lines)'), ('def', 'gauge/store.py', 14, 'function gauge.store.nightly (lines)'), ('import', 'gauge/live.py', 1, 'gauge.rows.decode'), ('import', 'gauge/store.py', 1, 'gauge.rows.decode'),
        ('call', 'gauge/rows.py', 5, 'gauge.rows.decode gauge.rows.dict 1'), ('call', 'gauge/rows.py', 5, 'gauge.rows.decode gauge.rows.zip 2'), ('call', 'gauge/live.py', 5, 'gauge.live.newest gauge.rows.decode 2'),
        ('call', 'gauge/store.py', 8, 'gauge.store.keep_all gauge.rows.decode 1'), ('call', 'gauge/store.py', 15, 'gauge.store.nightly gauge.store.len 1'), ('call', 'gauge/store.py', 15, 'gauge.store.nightly gauge.store.keep_all 1')
    ) AS t(fact, path, line, said)""",
    "check_incident": """SELECT * FROM (VALUES
        ('signature-break', 'critical', 'gauge/store.py', CAST(8 AS INTEGER), 'gauge.store.keep_all calls gauge.rows.decode the old way: it now requires layout, which the call does not pass', 'block')
    ) AS t(rule, severity, path, line, message, verdict)""",
    "check_affected": """SELECT * FROM (VALUES
        ('gauge.store.keep_all', 'gauge/store.py', CAST(4 AS INTEGER), CAST(1 AS INTEGER), CAST(0.855 AS DOUBLE)),
        ('gauge.store.nightly', 'gauge/store.py', 14, 2, 0.7695)
    ) AS t(name, path, line, hops, score)""",
}

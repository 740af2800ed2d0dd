"""Streams over the events table, run to their end, beside the batch SQL that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.operators.graph import shared_folder
from driftwake.streaming import feed


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def t1_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = feed.arrivals(spark, f"{sf_dir}/events.parquet")
    return feed.run_to_end(feed.latest(s, "user_id", ["ts", "event_id"], ["event_id", "event_type"]), _home(spark), "complete")


def t3_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = feed.arrivals(spark, f"{sf_dir}/events.parquet").select("user_id", "ts")
    return feed.run_to_end(feed.debounced(s, "user_id", "ts", "6 hours"), _home(spark), "complete")


def t5_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = feed.arrivals(spark, f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    return feed.run_to_end(feed.admitted(s, "user_id", "ts", 3, 86400), _home(spark))


def t4_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bursts of a day that can get no more events; the last day of each key may be open, so days are those before the end."""
    s = feed.arrivals(spark, f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = feed.run_to_end(feed.throttled(s, "user_id", "ts", "1 hour", "1 day"), _home(spark))
    return out.filter("period < TIMESTAMP '2024-01-20'").select("user_id", F.col("period").cast("timestamp_ntz").alias("period"), "n")


QUERIES = {"t4_throttle": t4_throttle, "t1_stream_latest": t1_stream_latest, "t3_debounce": t3_debounce, "t5_rate_limit": t5_rate_limit}

ORACLE = {
    "t4_throttle": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), b AS (SELECT user_id, max(ts) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND AS last, count(*) AS n FROM s GROUP BY user_id, s)
SELECT user_id, date_trunc('day', last)::TIMESTAMP AS period, CAST(sum(n) AS BIGINT) AS n FROM b WHERE last < TIMESTAMP '2024-01-20' GROUP BY 1, 2
""",
    "t5_rate_limit": """
WITH RECURSIVE e AS (SELECT user_id, ts, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, n, kept, ok) AS (
  SELECT user_id, n, [t], true FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, CASE WHEN len(list_filter(kept, lambda x: x > e.t - 86400)) < 3 THEN list_append(list_filter(kept, lambda x: x > e.t - 86400), e.t) ELSE list_filter(kept, lambda x: x > e.t - 86400) END,
    len(list_filter(kept, lambda x: x > e.t - 86400)) < 3
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT e.user_id, ts, event_id FROM r JOIN e USING (user_id, n) WHERE ok
""",
    "t1_stream_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "t3_debounce": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s
""",
}

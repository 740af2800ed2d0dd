"""What happens as work arrives (T1-T7), in Structured Streaming.

State lives in Spark's state store; results are written in foreachBatch or by a file sink under a folder the caller
gives, with the query's own checkpoint beside them, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a table's files, admitted so many a time (T6). The path may be a folder of files or one file; as a
    pattern it is not taken for the base of partitions, which a file cannot be."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(df: DataFrame, home: str, mode: str = "append") -> DataFrame:
    """All that has arrived, through the stream df and back as a table: complete results replace the last ones."""
    spark = df.sparkSession
    if mode == "append":
        q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    else:
        q = each_batch(df, lambda b, _: b.write.mode("overwrite").parquet(f"{home}/out"), home, mode)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{home}/out")


def each_batch(df: DataFrame, do: Callable[[DataFrame, int], None], home: str, mode: str = "append") -> StreamingQuery:
    """T1. df's batches through `do`, a batch check for instance, each once it has arrived."""
    return df.writeStream.outputMode(mode).foreachBatch(do).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()


def latest(stream: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """T1/T2. Of each key the row that is last in order; an upsert, as an aggregation with one row of state a key."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(key, "_v.*")


def unchanged_dropped(stream: DataFrame, key: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """T2. A key (name and version) goes through once; state older than the watermark is forgotten."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def debounced(stream: DataFrame, key: str, ts: str, rest: str) -> DataFrame:
    """T3/T4. One row for each burst: events closer than `rest` are one session; start, last event, how many."""
    s = stream.groupBy(key, F.session_window(ts, rest).alias("_s")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return s.select(key, "first", "last", "n")


def throttled(stream: DataFrame, key: str, ts: str, settle: str, every: str) -> DataFrame:
    """T4. Bursts that have settled, at most one a period: key, period, first, last, n. Events closer than `settle` are one burst;
    of a key's bursts that end in the same period of length `every`, the last is shared, with all their events counted. The
    watermark lets go of a period once it can get no more, so state doesn't grow with the stream."""
    bursts = stream.withWatermark(ts, every).groupBy(key, F.session_window(ts, settle).alias("_s")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return bursts.groupBy(key, F.window(F.window_time("_s"), every).alias("_w")).agg(F.max("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).select(key, F.col("_w.start").alias("period"), "first", "last", "n")


def admitted(stream: DataFrame, key: str, ts: str, most: int, seconds: int, idle: bool = False) -> DataFrame:
    """T5, exactly: an event is admitted if fewer than `most` admitted ones of its key lie in the trailing window.

    The state of a key is the times of its last admitted events in the window, `most` at most. With `idle`, a key whose last one
    is out of the window is forgotten (the stream then needs event times with a zone, and a watermark is set on them); that
    changes no answer, as a forgotten key has no event in the window."""
    if idle:
        stream = stream.withWatermark(ts, f"{seconds} seconds")
    schema = stream.schema

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if idle and state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        part = pd.concat(list(parts))  # the new events of one key in one batch, which files a trigger bound
        part = part.sort_values([ts, *[c for c in part.columns if c != ts]], kind="stable")
        keep, at = [], 0
        for t in (part[ts].astype("int64") / 10 ** {"s": 0, "ms": 3, "us": 6, "ns": 9}[part[ts].dt.unit]).tolist():
            while at < len(times) and times[at] <= t - seconds:  # times are in order: what is out of the window stays out
                at += 1
            keep.append(len(times) - at < most)
            if keep[-1]:
                times.append(t)
        state.update((times[at:][-most:],))
        if idle and times:
            state.setTimeoutTimestamp(max(int(times[-1] * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield part[keep]

    return stream.groupBy(key).applyInPandasWithState(step, schema, "times array<double>", "append", "EventTimeTimeout" if idle else "NoTimeout")

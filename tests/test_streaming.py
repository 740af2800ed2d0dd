import datetime as dt

from pyspark.sql import functions as F

from driftwake.streaming import feed

T0 = dt.datetime(2024, 1, 1)


def write(spark, path, rows):
    for i, part in enumerate(rows):
        spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), n) for k, s, n in part], "k string, ts timestamp_ntz, n int").coalesce(1).write.mode("append").parquet(path)


def test_rate_limit_counts_admitted_only(spark, tmp_path):
    rows = [("a", s, i) for i, s in enumerate([0, 1, 2, 3, 11, 12, 13, 14, 25])] + [("b", 0, 100), ("b", 5, 101)]
    write(spark, f"{tmp_path}/in", [rows])
    got = feed.run_to_end(feed.admitted(feed.arrivals(spark, f"{tmp_path}/in"), "k", "ts", 2, 10), f"{tmp_path}/home")
    times, want = [], []
    for k, s, n in rows[:9]:
        times = [x for x in times if x > s - 10]
        if len(times) < 2:
            times.append(s)
            want.append(n)
    assert sorted(r.n for r in got.collect()) == sorted([*want, 100, 101])


def test_latest_over_batches_and_restart(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [[("a", 0, 1), ("b", 5, 2)], [("a", 9, 3)]])
    run = lambda: {r.k: r.n for r in feed.run_to_end(feed.latest(feed.arrivals(spark, path, 1), "k", ["ts"], ["n"]), f"{tmp_path}/home", "complete").collect()}
    assert run() == {"a": 3, "b": 2}
    write(spark, path, [[("b", 20, 7), ("c", 1, 8)]])
    assert run() == {"a": 3, "b": 7, "c": 8}


def test_debounce(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[("a", s, s) for s in (0, 1, 2, 10, 11, 30)]])
    got = feed.run_to_end(feed.debounced(feed.arrivals(spark, f"{tmp_path}/in"), "k", "ts", "5 seconds"), f"{tmp_path}/home", "complete")
    assert sorted((r.first - T0).seconds * 100 + r.n for r in got.collect()) == [3, 1002, 3001]


def test_same_version_goes_through_once(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [[("a", 0, 1), ("a", 1, 1), ("a", 2, 2)]])
    s = feed.arrivals(spark, f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in feed.run_to_end(feed.unchanged_dropped(s, ["k", "n"], "ts"), f"{tmp_path}/home").collect()) == [1, 2]

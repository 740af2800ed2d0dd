"""What the operators of this subpackage share: reading tables, cutting lineage, ASCII case."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset one is made, but only if driver and
    executors are one process; on a cluster a folder of the driver's would lose what executors write."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    out.folder = out._jdf.logicalPlan().rdd().getCheckpointFile().get()
    return out


def cut_in_loop(df: DataFrame) -> DataFrame:
    """cut, for loops. A cut table passes on the optimizer's guess of its size, which each join squares; after some dozen
    rounds that number alone has more digits than can be worked with. Here the guess is forgotten."""
    spark, done = df.sparkSession, cut(df)
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
    out.folder = done.folder
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what cut wrote for these tables, once nothing that is still to run reads them."""
    for t in tables:
        if getattr(t, "folder", None):
            delete(t.sparkSession, t.folder)
            t.folder = None


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df as a Parquet table in the shared folder, for what is too large to keep uncompressed, and a call that
    deletes it, once nothing that is still to run reads it."""
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    try:
        df.write.parquet(home)
    except BaseException:
        delete(spark, home)
        raise
    return spark.read.schema(df.schema).parquet(home), lambda: delete(spark, home)


CROWD = 1000


def joined_to_one(rows: DataFrame, one: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined with one, which has a row a key and in n how many of the `total` rows have that key.

    Keys of more than CROWD rows, or a thousandth of all, are few (1,000 at most, whatever the table), so
    their side is broadcast and their rows stay where they are; all others meet in a shuffle. rows is read twice."""
    most = max(CROWD, total // 1000)
    if total <= most:
        return rows.join(one.drop(n), on)
    if (one.agg(F.max(n)).head()[0] or 0) <= most:
        return rows.join(one.drop(n), on)
    heavy = F.broadcast(cut(one.filter(F.col(n) > most).drop(n)))
    light = rows.join(heavy.select(*on), on, "left_anti").join(one.filter(F.col(n) <= most).drop(n), on)
    return light.unionByName(rows.join(heavy, on))


BATCH_ROWS = 1000


def in_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most BATCH_ROWS rows from here on in its session. Texts are long: batches of the
    usual 10,000 rows are tens of MB, held several times over on both sides of the Python boundary."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. lower() is the cheap way for texts of ASCII alone, where both agree."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))

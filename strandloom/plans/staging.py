"""Stages written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none and driver and
    executors are one process; on a cluster a missing folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _store(spark, path)
    fs.deleteOnExit(at)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; a table used often is then computed once.

    The files go when the driver ends, or with ``unstage``.
    """
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def stage_bucketed(df: DataFrame, name: str, *by: str) -> DataFrame:
    """A stage laid out by ``by``: joins and aggregates on these columns don't shuffle it, however often they read it.

    There are as many buckets as shuffles have partitions.
    """
    spark = df.sparkSession
    path, n = own_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, *by).write.option("path", path).bucketBy(n, *by).sortBy(*by).saveAsTable(table)
    out = spark.table(table)
    out.staged_at, out.staged_as = path, table
    return out


def large(df: DataFrame) -> DataFrame:
    """``df``, to be joined by shuffles alone and never sent to every task by way of the driver.

    Spark judges a table by its files, which are a small part of its rows where values repeat.
    """
    return df.hint("merge")


def unstage(*staged: DataFrame) -> None:
    """Delete the files of stages that nothing reads any more."""
    for df in staged:
        if hasattr(df, "staged_as"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.staged_as}")
        at, fs = _store(df.sparkSession, df.staged_at)
        fs.delete(at, True)

"""Session helpers: a tuned session, the shared folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row bound is at most this many rows (110 years of days).
BROADCAST_ROW_LIMIT = 40_000
# Independent fits that may share the cluster at one time.
CONCURRENT_FITS = 4

# Columns up to which Spark compiles a stage as one function. That of the feature table is too long
# for the compiler of the JVM and stays interpreted; operator by operator it runs three times faster.
CODEGEN_FIELDS = 50


def build_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("daybook")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.maxFields", str(CODEGEN_FIELDS))
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def split_wide_stages(spark: SparkSession) -> None:
    """Lower the column limit of whole-stage code generation below the feature table."""
    key = "spark.sql.codegen.maxFields"
    if int(spark.conf.get(key)) > CODEGEN_FIELDS:
        spark.conf.set(key, str(CODEGEN_FIELDS))


def join_where_dealt(spark: SparkSession) -> None:
    """Let rows dealt by series stay in a join on series and date; only the other side moves.

    A series has one row a day, so dealing by series alone is no skew beyond that of its windows.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is missing it is a folder of the warehouse, which executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a result that several later jobs read, and read it back.

    The table in the shared folder cuts the lineage, survives the loss of executors, and keeps
    column pruning and filter pushdown for its readers. Zstandard keeps texts on disk short.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete a stage of ``materialise`` that nothing reads any more, so that the disk holds what is still needed."""
    spark = stored.sparkSession
    folders = spark._jvm.org.apache.hadoop.fs
    for file in stored.inputFiles()[:1]:
        folder = folders.Path(spark._jvm.java.net.URI.create(file)).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_if_sound(df: DataFrame, checks: dict[str, Column], name: str) -> DataFrame:
    """Write a stage while its checks are observed, and read it back if all of them are zero.

    A check counts offending rows. The counts are taken by the tasks that write, so no second scan
    is needed; a stage with offenders is an error that names them all.
    """
    watch = Observation(f"{name}-{uuid.uuid4().hex}")
    counts = [F.coalesce(count, F.lit(0)).alias(label) for label, count in checks.items()]
    stored = materialise(df.observe(watch, *counts), name)
    offenders = {label: n for label, n in watch.get.items() if n}
    if offenders:
        raise ValueError(f"{name}: {offenders}")
    return stored


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for a broadcast join if ``max_rows``, its proven bound, is small enough.

    Beyond the limit the frame is returned as it is and the join shuffles both sides.
    """
    return F.broadcast(df) if max_rows <= BROADCAST_ROW_LIMIT else df


def concurrently(task: Callable, settings: Iterable) -> list:
    """Run independent fits a few at a time from driver threads; the work is on the executors."""
    with ThreadPool(CONCURRENT_FITS) as pool:
        return pool.map(task, list(settings), chunksize=1)

"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of the files read that one task of `dealt_by` stands for.
SHARE = 1 << 23
#: Spark's estimate for rows that lie in no file is about this or more.
UNKNOWN = 1 << 60


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt out by keys to a number of tasks that grows with the files it reads, so that a task's rows, and what sorts and groups of them need, don't.

    The session's number of shuffle partitions is the least.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaf.stats().sizeInBytes())) for leaf in map(leaves.apply, range(leaves.size()))]
    read = sum(n for n in sizes if n < UNKNOWN)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, ceil(read / SHARE)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`.

    Where none is set, a local session (tests) gets a temporary folder; any other fails,
    because executors could not read what is written to a folder of one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's written tables lie, apart from those of others."""
    return f"{shared_dir(spark)}/corpusloom-{spark.sparkContext.applicationId}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote with `stash`; to be called once its results are stored."""
    delete_folder(spark, scratch_dir(spark))


def stash(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # its shuffle files go once the table is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Deletes what `stash` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)

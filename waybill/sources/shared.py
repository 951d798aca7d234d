"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder of the cluster.

    Without one, a local session takes a folder of this machine (as in tests); on a cluster that is an
    error, since executors would scatter the table over their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="waybill-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = f"{base.rstrip('/')}/waybill/{uuid.uuid4().hex}"
    _made.append(made)
    return f"{made}/{name}"


_made: list[str] = []


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this driver has written to the shared folder; for the end of a job, when no result is still to be read."""
    paths, context = list(_made), spark.sparkContext
    _made.clear()
    for path in paths:
        held = context._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(context._jsc.hadoopConfiguration()).delete(held, True)
    return len(paths)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows, cut from their lineage by a Parquet table in the shared folder."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, with the path of the table, for those who drop it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that nobody reads any more."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)
    swept(spark)


def swept(spark: SparkSession) -> None:
    """Has Spark delete shuffles that nobody reads any more; else they stay until the driver happens to collect its garbage."""
    spark._jvm.System.gc()


SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt over all cores; a file with one row group would keep them all but one idle.

    Larger inputs are left as they are scanned, so nothing is shuffled at scale.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df

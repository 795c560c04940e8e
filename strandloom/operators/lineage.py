"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where it is unset and all tasks run in the driver's process, a new local
    folder is set; on a cluster such a folder would be another one on each
    machine, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not is_local(sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        named = "file://" + tempfile.mkdtemp(prefix="strandloom-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def durable(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder and read from there, so that a lost executor costs no recomputation.

    Spark deletes the files once no plan refers to them when
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """As ``durable``, for wide rows: compressed by column, in a folder that ``remove`` can delete when nothing reads them any more."""
    path = path or f"{shared_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no plan refers to any more: it does so when the driver's garbage has been collected (mostly for the second time)."""
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

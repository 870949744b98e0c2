"""Cutting lineage by files that outlive executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from rowframe.errors import RowFrameError


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local master may do without the setting, as in tests; there a temporary folder is made. On a cluster that
    would be another folder on every machine.
    """
    context = spark.sparkContext
    set_ = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if set_:
        return set_
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RowFrameError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

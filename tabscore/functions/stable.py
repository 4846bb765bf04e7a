"""Rows that are read several times and have to be the same each time, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one in use, or the setting. A session in one JVM without either gets a
    temporary folder; on a cluster, whose executors wouldn't share it, that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not at:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="tabscore-")
        context.setCheckpointDir(at)
    return context.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the session's checkpoint folder, so that a lost executor changes none of its rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share, for files that a query writes and reads again."""
    return checkpoint_dir(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in that folder: computed once, read again by columns, and the same when an executor is lost."""
    path = f"{scratch(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever its file system is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has kept so, once its results have been written: lazy results still read it."""
    at = spark.sparkContext.getCheckpointDir()
    if at:
        delete(spark, at)

"""What several operators share: texts, words, tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a class of a regular expression.
WS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row: lambda variables are never inlined, columns may be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and all else as it is. Texts without other letters take the fast way, as lower() agrees there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words between ASCII white space, as an array; no words for an empty text."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Where it names none, a session in one JVM gets a temporary one; on a cluster, whose executors don't share such a
    folder, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tabscore-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def work_dir(spark: SparkSession) -> str:
    """This application's own folder for tables between passes, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tabscore/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, and lost executors lose nothing of it."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table or folder, wherever its file system is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables between passes of this application, once its results have been written."""
    delete(spark, work_dir(spark))


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            delete(df.sparkSession, name.rsplit("/", 1)[0])


def spread_join(left: DataFrame, right: DataFrame, counts: DataFrame, key: str, how: str = "left", hot: int = 1000) -> DataFrame:
    """left joined with right, which has one row a key, where one key may hold a third of left's rows.

    counts: (key, count) of left's rows. Keys that hold more than 1 / hot of all rows, of which there are at most hot,
    are joined by broadcast where their rows lie; all others, null keys too, by a shuffle. right's other columns come
    after left's.
    """
    total = counts.agg(F.sum("count")).first()[0] or 0
    heavy = F.broadcast(counts.filter(F.col("count") * hot > total).select(F.col(key).alias("_hot")))
    own = left.join(heavy, F.col(key) == F.col("_hot"), "left")
    few = F.broadcast(right.join(heavy.withColumnRenamed("_hot", key), key, "left_semi"))
    return own.filter("_hot is null").drop("_hot").join(right, key, how).unionByName(own.filter("_hot is not null").drop("_hot").join(few, key, how))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""Row numbers over a whole table, by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.functions.stable import stable


def row_numbers(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with n, from 1: the global order by `order`, numbered by ranges, whose sizes are added up (one row a range)."""
    ranged = stable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(sizes.select("_part", "_before")), "_part").withColumn("n", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).drop("_part", "_before")

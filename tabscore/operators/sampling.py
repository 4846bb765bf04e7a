"""Samples and folds. What is drawn follows from keys that tell rows apart, or, without keys, from Spark's seeded draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.functions.stable import stable
from tabscore.operators.order import row_numbers


def chance(keys: Sequence[str] | None, seed: int = 42) -> Column:
    """A number from 0 to 1 for each row: of the keys' MD5, whatever the partitions; for no keys, drawn row by row.

    Keys have to tell rows apart: equal rows would be taken all or none.
    """
    if not keys:
        return F.rand(seed)
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def most_of(quota: Column | float, n: Column | float) -> Column | float:
    """A share of n that holds quota rows at least but for a chance of about one in 10 ** 9: six deviations above it."""
    spare = quota + 6 * quota**0.5 + 10 if isinstance(quota, (int, float)) else quota + 6 * F.sqrt(quota) + 10
    return spare / n


def uniform_sample(df: DataFrame, max_rows: int, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """max_rows rows, or df itself if it has no more: those with the smallest chances.

    Rows that can't be among them are left out where they lie, so about max_rows rows, not max_rows of each partition,
    are ordered in the end.
    """
    n = df.count()
    if n <= max_rows:
        return df
    drawn = df.withColumn("_chance", chance(keys, seed)).filter(F.col("_chance") <= most_of(max_rows, n))
    return stable(drawn.orderBy("_chance", *(keys or ())).limit(max_rows).drop("_chance"))


def ranked_in(df: DataFrame, strat_col: str, order: list) -> DataFrame:
    """df with _rank, from 1 in each stratum in the order given, and _n, its rows. A missing value is a stratum.

    Rows are numbered by ranges of (stratum, order), and what comes before a stratum is taken off: no task numbers a
    whole stratum.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    stratum = F.col(f"`{strat_col}`")
    numbered = row_numbers(df.withColumn("_null", stratum.isNull()), [F.col("_null"), stratum, *order])
    sizes = numbered.groupBy(stratum.alias("_stratum")).agg(F.min("n").alias("_first"), F.count("*").alias("_n"))
    joined = numbered.join(sizes, stratum.eqNullSafe(F.col("_stratum"))).withColumn("_rank", F.col("n") - F.col("_first") + 1)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "_rank", "_n")


def stratified_sample(df: DataFrame, fraction_num: int, fraction_den: int, strat_col: str, order: list[str]) -> DataFrame:
    """Of each stratum ceil(n * num / den) rows, the first in the order given."""
    return ranked_in(df, strat_col, order).filter(F.col("_rank") * fraction_den < F.col("_n") * fraction_num + fraction_den).drop("_n", "_rank")


def stratified_subsample(df: DataFrame, max_rows: int, strat_col: str | None = None, random_state: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """About max_rows rows, of each stratum its share, one row at least; df itself if it has no more than max_rows.

    A stratum of n of all N rows gives max(1, floor(max_rows * n / N)) rows, those with the smallest chances. Rows that
    can't be among them are left out before they are ranked, so no task orders more of a stratum than about its share.
    A missing value is a stratum. Without strat_col the sample is uniform.
    """
    if strat_col is None or strat_col not in df.columns:
        return uniform_sample(df, max_rows, random_state, keys)
    sizes = df.groupBy(F.col(f"`{strat_col}`").alias("_stratum")).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    if total <= max_rows:
        return df
    quota = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_n") * max_rows / total))
    sizes = sizes.withColumn("_quota", quota).withColumn("_share", most_of(quota, F.col("_n")))
    drawn = df.withColumn("_chance", chance(keys, random_state)).join(sizes, F.col(f"`{strat_col}`").eqNullSafe(F.col("_stratum"))).filter(F.col("_chance") <= F.col("_share"))
    rank = F.row_number().over(Window.partitionBy("_stratum").orderBy("_chance", *(keys or ())))
    return stable(drawn.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_quota")).select(*[F.col(f"`{c}`") for c in df.columns]))


def fold_of(df: DataFrame, k: int, strat_col: str | None, order: list, name: str = "fold") -> DataFrame:
    """df with the column name, 0 to k - 1: rows of a stratum (all rows without strat_col) dealt out in turn, in the order given."""
    if strat_col:
        return ranked_in(df, strat_col, order).withColumn(name, (F.col("_rank") - 1) % k).drop("_rank", "_n")
    return row_numbers(df, [F.col(c) if isinstance(c, str) else c for c in order]).withColumn(name, (F.col("n") - 1) % k).drop("n")


def hash_fold(df: DataFrame, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """df with the column name, 0 to k - 1, by a hash of all columns: no shuffle, whatever the size."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), F.lit(k)).cast("int"))

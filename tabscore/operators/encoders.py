"""Expressions that turn columns into features; what they need is fitted once, by aggregations over the real table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.canon import canon
from tabscore.operators.schema import DataSchema

NA = "__NA__"


def moments(real: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """mean, population deviation, min, max and median of each column, from one scan."""
    f = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5))}
    row = real.agg(*[g(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, g in f.items()]).first()
    return {c: {k: row[f"{k}{i}"] for k in f} for i, c in enumerate(columns)}


def zero_filled_bounds(real: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = real.agg(*[g(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))).alias(f"{k}{i}") for i, c in enumerate(columns) for k, g in (("min", F.min), ("max", F.max))]).first()
    return {c: (row[f"min{i}"] or 0.0, row[f"max{i}"] or 0.0) for i, c in enumerate(columns)}


def standardised(c: Column, stats: dict[str, float]) -> Column:
    """Mean-imputed, centred, over the population deviation (1 for a constant)."""
    return (F.coalesce(c.cast("double"), F.lit(stats["mean"])) - F.lit(stats["mean"])) / F.lit(stats["std"] or 1.0)


def min_max(c: Column, bounds: tuple[float, float]) -> Column:
    """Zero-imputed, scaled by the real bounds, not clipped; 0 for a constant."""
    lo, hi = bounds
    return (F.coalesce(c.cast("double"), F.lit(0.0)) - F.lit(lo)) / F.lit((hi - lo) or 1.0)


def one_hot(text: Column, categories: list[str]) -> list[Column]:
    """One column a category, in their order; an unknown value is all zeros."""
    return [F.when(text == w, 1.0).otherwise(0.0) for w in categories]


def ordinal(text: Column, categories: list[str]) -> Column:
    """The place among the sorted categories, -1 for an unknown value."""
    table = F.create_map(*[F.lit(x) for i, w in enumerate(sorted(categories)) for x in (w, float(i))]) if categories else None
    return F.coalesce(F.try_element_at(table, text), F.lit(-1.0)) if categories else F.lit(-1.0)


def most_frequent(real: DataFrame, columns: list[str]) -> dict[str, str]:
    row = real.agg(*[F.mode(canon(F.col(f"`{c}`"), real.schema[c].dataType, None), True).alias(f"m{i}") for i, c in enumerate(columns)]).first() if columns else ()
    return {c: row[i] for i, c in enumerate(columns)}


def coded_by(df: DataFrame, schema: DataSchema, column: str, text: Column, name: str) -> DataFrame:
    """df with the column name: the place of text among the column's sorted categories, -1 for an unknown one.

    A small vocabulary is a table in the expression, a large one is joined.
    """
    words = schema[column].categories
    if words is not None:
        return df.withColumn(name, ordinal(text, list(words)))
    index = schema.index(column).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(index, text == F.col("_value"), "left").withColumn(name, F.coalesce("_code", F.lit(-1.0))).drop("_value", "_code")


@dataclass
class FeatureEncoder:
    """Standardised numbers, then one-hot categories (missing is one), in three forms that mean the same.

    features(df) adds an array of them all, vectors(df) a sparse vector, and compact(df) the numbers and, in place of
    one-hot columns, a code for each category, -1 for an unknown one, whose columns are all zeros.
    """

    schema: DataSchema
    stats: dict[str, dict[str, float]]
    #: Columns and how many one-hot columns each has; the last stands for a missing value, if the real table has some.
    sizes: dict[str, int]
    missing: dict[str, bool]

    @property
    def width(self) -> int:
        return len(self.stats) + sum(self.sizes.values())

    def compact(self, df: DataFrame, nums: str = "nums", codes: str = "codes") -> DataFrame:
        kinds, own = {f.name: f.dataType for f in df.schema.fields}, df.columns
        for i, c in enumerate(self.sizes):
            df = coded_by(df, self.schema, c, canon(F.col(f"`{c}`"), kinds[c], None), f"_c{i}")
            if self.missing[c]:
                df = df.withColumn(f"_c{i}", F.when(F.col(f"`{c}`").isNull(), float(self.sizes[c] - 1)).otherwise(F.col(f"_c{i}")))
        numbers = [standardised(F.col(f"`{c}`"), s) for c, s in self.stats.items()]
        return df.select(*[F.col(f"`{c}`") for c in own], F.array(*numbers).cast("array<double>").alias(nums), F.array(*[F.col(f"_c{i}") for i in range(len(self.sizes))]).cast("array<double>").alias(codes))

    def features(self, df: DataFrame, name: str = "features") -> DataFrame:
        out = self.compact(df, "_nums", "_codes")

        def columns(i: int, n: int) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == F.get("_codes", F.lit(i)), 1.0).otherwise(0.0))

        hot = [columns(i, n) for i, n in enumerate(self.sizes.values()) if n]
        return out.withColumn(name, F.concat("_nums", *hot)).drop("_nums", "_codes")

    def vectors(self, df: DataFrame, name: str = "features") -> DataFrame:
        """As features, but a vector that holds only what isn't 0: room for vocabularies of any size."""
        out, parts = self.compact(df, "_nums", "_codes"), []
        if self.stats:
            out, parts = out.withColumn("_numbers", array_to_vector("_nums")), ["_numbers"]
        hot = {f"_k{i}": n for i, n in enumerate(self.sizes.values()) if n}
        if hot:
            # An unknown value is the place after the last one, which is dropped: all zeros.
            for i, n in enumerate(self.sizes.values()):
                if n:
                    code = F.get("_codes", F.lit(i))
                    out = out.withColumn(f"_k{i}", F.when(code < 0, float(n)).otherwise(code))
            most = df.sparkSession.createDataFrame([tuple(map(float, hot.values()))], ", ".join(f"{k} double" for k in hot))
            out = OneHotEncoder(inputCols=list(hot), outputCols=[f"{k}_hot" for k in hot], dropLast=True).fit(most).transform(out)
            parts += [f"{k}_hot" for k in hot]
        return VectorAssembler(inputCols=parts, outputCol=name).transform(out).drop("_nums", "_codes", "_numbers", *hot, *[f"{k}_hot" for k in hot])


def build_feature_encoder(schema: DataSchema, real_df: DataFrame) -> FeatureEncoder:
    if not len(schema):
        raise ValueError("the schema has no columns")
    cont, cat = schema.continuous_columns, schema.categorical_columns
    stats = moments(real_df, cont) if cont else {}
    nulls = real_df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in cat]).first() if cat else {}
    missing = {c: bool(nulls[c]) for c in cat}
    return FeatureEncoder(schema, stats, {c: schema.size(c) + missing[c] for c in cat}, missing)

"""Canonical text of values, guarded parsing of numbers, and one rule for missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"
TRUE, FALSE = ("true", "t", "1", "1.0", "yes"), ("false", "f", "0", "0.0", "no")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def ingest(df: DataFrame) -> DataFrame:
    """Decimals become doubles and NaN becomes null: from here on null is the only missing value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(out)


def canon(c: Column, kind: T.DataType, missing: str | None = "nan") -> Column:
    """A value's text, the same for 4, 4.0 and '4' of a number column: digits only where a number is whole."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        text = F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
        text = F.when(~F.isnan(d), text)
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "True").when(~c, "False")
    else:
        text = c.cast("string")
    return text if missing is None else F.coalesce(text, F.lit(missing))


def parse_number(text: Column) -> Column:
    """The number that a text spells, null if it spells none: no type suffixes, separators or hexadecimals."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def parse_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)

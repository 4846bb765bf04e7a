"""The schema of a real table, inferred once and then fixed."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.functions.canon import canon, ingest, is_numeric
from tabscore.functions.stable import stable
from tabscore.operators.order import row_numbers

CATEGORICAL_THRESHOLD = 20
#: Larger vocabularies stay tables and are joined, never gathered on the driver. Results are the same either way.
DRIVER_VOCABULARY = 1000


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    col_type: str
    dtype: T.DataType
    min_val: float | None = None
    max_val: float | None = None
    #: Canonical texts; None for a vocabulary too large for the driver.
    categories: frozenset[str] | None = None

    def __post_init__(self):
        if self.col_type not in ("continuous", "categorical"):
            raise ValueError(f"col_type of {self.name} is {self.col_type!r}")
        if self.col_type == "continuous" and (self.min_val is None or self.max_val is None):
            raise ValueError(f"{self.name} is continuous and has no bounds")


class DataSchema:
    """Columns of real_df with their kinds, bounds and vocabularies.

    Two aggregations: one scan gives bounds and approximate distinct counts of all columns; the second counts and
    gathers, exactly, only the columns whose vocabulary may be small.
    """

    def __init__(self, real_df: DataFrame, categorical_columns: list[str] = (), continuous_columns: list[str] = (), categorical_threshold: int = CATEGORICAL_THRESHOLD):
        both = set(categorical_columns) & set(continuous_columns)
        unknown = (set(categorical_columns) | set(continuous_columns)) - set(real_df.columns)
        if both or unknown:
            raise ValueError(f"columns of both kinds: {sorted(both)}; unknown columns: {sorted(unknown)}")
        self.real_df = ingest(real_df)
        kinds = {f.name: f.dataType for f in self.real_df.schema.fields}
        for name, kind in kinds.items():
            if not isinstance(kind, (T.NumericType, T.StringType, T.BooleanType)):
                raise ValueError(f"{name} is a {kind.simpleString()}: only numbers, texts and booleans have a rule")
        if not kinds:
            raise ValueError("the table has no columns")
        col = {c: F.col(f"`{c}`") for c in kinds}
        first = self.real_df.agg(*[f(col[c]).alias(f"{tag}{i}") for i, c in enumerate(kinds) for tag, f in (("n", F.approx_count_distinct), ("lo", F.min), ("hi", F.max))]).first()
        about = {c: first[f"n{i}"] for i, c in enumerate(kinds)}
        small = [c for c in kinds if c not in continuous_columns and about[c] <= 2 * max(categorical_threshold, DRIVER_VOCABULARY if not is_numeric(kinds[c]) or c in categorical_columns else categorical_threshold)]
        sets = self.real_df.agg(*[F.collect_set(canon(col[c], kinds[c], None)).alias(f"s{i}") for i, c in enumerate(small)]).first() if small else ()
        exact = {c: frozenset(sets[i]) for i, c in enumerate(small)}
        self._columns: dict[str, ColumnSchema] = {}
        self._index: dict[str, DataFrame] = {}
        for i, (c, kind) in enumerate(kinds.items()):
            few = c in exact and len(exact[c]) <= categorical_threshold
            if c in continuous_columns or (c not in categorical_columns and is_numeric(kind) and not few):
                if first[f"lo{i}"] is None:
                    raise ValueError(f"{c} is continuous and has no values")
                self._columns[c] = ColumnSchema(c, "continuous", kind, float(first[f"lo{i}"]), float(first[f"hi{i}"]))
            else:
                words = exact.get(c)
                self._columns[c] = ColumnSchema(c, "categorical", kind, categories=words if words is not None and len(words) <= DRIVER_VOCABULARY else None)

    @property
    def columns(self) -> dict[str, ColumnSchema]:
        return dict(self._columns)

    @property
    def column_names(self) -> list[str]:
        return list(self._columns)

    @property
    def continuous_columns(self) -> list[str]:
        return [c for c, s in self._columns.items() if s.col_type == "continuous"]

    @property
    def categorical_columns(self) -> list[str]:
        return [c for c, s in self._columns.items() if s.col_type == "categorical"]

    def vocabulary(self, name: str) -> DataFrame:
        """The column's categories as a table (value), canonical texts."""
        return self.real_df.select(canon(F.col(f"`{name}`"), self[name].dtype, None).alias("value")).filter("value is not null").distinct()

    def index(self, name: str) -> DataFrame:
        """(value, code) of the column's categories: their places, from 0.0, in the order of the texts."""
        if name not in self._index:
            self._index[name] = stable(row_numbers(self.vocabulary(name), [F.col("value")]).select("value", (F.col("n") - 1).cast("double").alias("code")))
        return self._index[name]

    def size(self, name: str) -> int:
        """How many categories the column has."""
        words = self[name].categories
        return len(words) if words is not None else self.index(name).count()

    def __getitem__(self, name: str) -> ColumnSchema:
        return self._columns[name]

    def __len__(self) -> int:
        return len(self._columns)

    def __repr__(self) -> str:
        return f"DataSchema({len(self)} columns: {len(self.continuous_columns)} continuous, {len(self.categorical_columns)} categorical)"

    def table(self) -> DataFrame:
        """One row a column: position, name, col_type, min_val, max_val, n_categories."""
        rows = [(i, s.name, s.col_type, s.min_val, s.max_val, self.size(s.name) if s.col_type == "categorical" else None) for i, s in enumerate(self._columns.values())]
        return self.real_df.sparkSession.createDataFrame(rows, "position int, name string, col_type string, min_val double, max_val double, n_categories int")


def schema_fingerprint(schema: DataSchema) -> str:
    """MD5 of the sorted name:kind pairs: stable under changes of data and of column order."""
    return hashlib.md5("|".join(sorted(f"{s.name}:{s.col_type}" for s in schema.columns.values())).encode()).hexdigest()

"""Distributional fidelity. Both tables travel together with a side flag, all columns in long form: one shuffle for
all Kolmogorov-Smirnov statistics, one for all category distances, one for all contingency tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.functions.canon import canon, ratio
from tabscore.functions.stable import stable
from tabscore.operators.schema import DataSchema


def stacked(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both tables with `side`: 1 for real, 0 for synthetic."""
    cols = [F.col(f"`{c}`") for c in columns]
    return real.select(*cols, F.lit(1).alias("side")).unionByName(synth.select(*cols, F.lit(0).alias("side")))


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(side, column, v) of the values that aren't null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    return df.select("side", F.inline(cells)).filter("v is not null and not isnan(v)")


def long_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), canon(F.col(f"`{c}`"), kinds[c], None).alias("v")) for c in columns])
    return df.select("side", F.inline(cells)).filter("v is not null")


def ks_per_column(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ks, n_real, n_synth): the largest distance of the two distribution functions.

    Equal values are counted before anything is ordered. The running counts are then taken in ranges of values: within
    a range by a window, across ranges by the totals of the ranges, so no column is sorted by one task.
    """
    counts = long_numbers(stacked(real, synth, columns), columns).groupBy("column", "v").agg(F.sum("side").alias("r"), F.sum(1 - F.col("side")).alias("s"))
    ranged = stable(counts.repartitionByRange("column", "v").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part", "column").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    parts = ranged.groupBy("column", "part").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    parts = parts.select("column", "part", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in "rs"], *[F.sum(x).over(whole).alias(f"{x}_all") for x in "rs"])
    run = ranged.select("column", "part", *[F.sum(x).over(here).alias(f"{x}_here") for x in "rs"]).join(parts, ["column", "part"])
    gap = F.abs(ratio(F.col("r_before") + F.col("r_here"), F.col("r_all")) - ratio(F.col("s_before") + F.col("s_here"), F.col("s_all")))
    return run.groupBy("column").agg(F.max(gap).alias("ks"), F.max("r_all").alias("n_real"), F.max("s_all").alias("n_synth"))


def tvd_per_column(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(column, tvd): half the sum of the differences of category shares; null if a side has no values."""
    counts = long_texts(stacked(real, synth, columns), columns).groupBy("column", "v").agg(F.sum("side").alias("r"), F.sum(1 - F.col("side")).alias("s"))
    totals = counts.groupBy("column").agg(F.sum("r").alias("r_all"), F.sum("s").alias("s_all"))
    return counts.join(totals, "column").groupBy("column").agg((F.sum(F.abs(ratio(F.col("r"), F.col("r_all")) - ratio(F.col("s"), F.col("s_all")))) / 2).alias("tvd"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of the rows where both are there, null for a constant: from moments around a shift, in one aggregate."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    var = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(var > 0, F.covar_pop(x, y) / F.when(var > 0, var))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, from one scan."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[correlation(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def matrix_error(real: DataFrame, synth: DataFrame, value: str) -> DataFrame:
    """(error): mean absolute difference off the diagonal; null as soon as one cell is."""
    both = real.alias("x").join(synth.alias("y"), ["a", "b"])
    gap = F.abs(F.col(f"x.{value}") - F.col(f"y.{value}"))
    return both.agg(F.when(F.count(gap) == F.count("*"), F.avg(gap)).alias("error"))


def contingency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, x, y, n): the counts of all pairs' contingency tables, from one shuffle of pre-aggregated cells."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = lambda c: canon(F.col(f"`{c}`"), kinds[c], None)
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), text(a).alias("x"), text(b).alias("y")) for a, b in pairs])
    return df.select(F.inline(cells)).filter("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))


def cramers_v_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, v): bias-corrected Cramér's V of all pairs, with Yates' correction for 2 x 2 tables."""
    return cramers_v(contingency(df, list(combinations(columns, 2))))


def cramers_v(cells: DataFrame) -> DataFrame:
    by = ["a", "b"]
    xs = cells.groupBy(*by, "x").agg(F.sum("n").alias("nx"))
    ys = cells.groupBy(*by, "y").agg(F.sum("n").alias("ny"))
    sizes = xs.groupBy(*by).agg(F.count("*").alias("r"), F.sum("nx").alias("n")).join(ys.groupBy(*by).agg(F.count("*").alias("k")), by)
    # Empty cells matter to a 2 x 2 table only, so only these get their full grid.
    grid = xs.join(ys, by).join(sizes.filter("r = 2 and k = 2"), by)
    grid = grid.join(cells.withColumnRenamed("n", "o"), [*by, "x", "y"], "left")
    e = F.col("nx") * F.col("ny") / F.col("n")
    d = F.abs(F.coalesce("o", F.lit(0)) - e)
    yates = grid.groupBy(*by).agg(F.sum(F.pow(d - F.least(F.lit(0.5), d), 2) / e).alias("chi_yates"))
    plain = cells.join(xs, [*by, "x"]).join(ys, [*by, "y"]).groupBy(*by).agg(F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))).alias("s"))
    out = sizes.join(plain, by).join(yates, by, "left")
    n, r, k = F.col("n").cast("double"), F.col("r").cast("double"), F.col("k").cast("double")
    phi = F.coalesce("chi_yates", n * (F.col("s") - 1)) / n
    least = F.least(k - ratio((k - 1) * (k - 1), n - 1) - 1, r - ratio((r - 1) * (r - 1), n - 1) - 1)
    v = F.sqrt(F.greatest(F.lit(0.0), phi - ratio((k - 1) * (r - 1), n - 1)) / F.when(least > 0, least))
    return out.select(*by, F.when((r < 2) | (k < 2) | least.isNull() | (least <= 0), 0.0).otherwise(v).alias("v"))


@dataclass
class Dim1Result:
    ks: dict[str, float] = field(default_factory=dict)
    tvd: dict[str, float] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    mean_ks: float | None = None
    mean_tvd: float | None = None
    pearson_matrix_error: float | None = None
    cramerv_matrix_error: float | None = None
    alpha_precision: float | None = None
    beta_recall: float | None = None
    c2st_auc: dict[str, float] = field(default_factory=dict)
    c2st_auc_mean: float | None = None
    mean_ks_ci: tuple[float, float] | None = None
    mean_tvd_ci: tuple[float, float] | None = None
    alpha_precision_ci: tuple[float, float] | None = None
    beta_recall_ci: tuple[float, float] | None = None

    @property
    def summary(self) -> str:
        return f"fidelity: mean KS {self.mean_ks}, mean TVD {self.mean_tvd}, correlation error {self.pearson_matrix_error}, association error {self.cramerv_matrix_error}, precision {self.alpha_precision}, recall {self.beta_recall}, C2ST {self.c2st_auc_mean}"


#: Why a column is left out.
SKIPPED = {(False, False): "all-NaN in both real and synthetic data", (False, True): "all-NaN in real data", (True, False): "all-NaN in synthetic data"}


class FidelityEvaluator:
    """Scores a synthetic table against the real one; k, max_samples, n_splits and random_state bound the two costly parts."""

    def __init__(self, real_df: DataFrame, schema: DataSchema, k: int = 5, max_samples: int = 50_000, n_splits: int = 5, random_state: int = 42, n_boot: int = 0, ci: float = 0.95, trees: int = 300):
        self.real, self.schema = schema.real_df if real_df is None else real_df, schema
        self.k, self.max_samples, self.n_splits, self.seed, self.n_boot, self.ci, self.trees = k, max_samples, n_splits, random_state, n_boot, ci, trees

    def skip_reasons(self, synth: DataFrame) -> dict[str, str]:
        rows = stacked(self.real, synth, self.schema.column_names).groupBy("side").agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in self.schema.column_names]).collect()
        n = {r["side"]: r for r in rows}
        has = lambda side, c: side in n and n[side][c] > 0
        return {c: SKIPPED[has(1, c), has(0, c)] for c in self.schema.column_names if not (has(1, c) and has(0, c))}

    def marginals(self, synth: DataFrame) -> DataFrame:
        """(metric, key, value): ks and tvd of every column."""
        parts = []
        if cont := self.schema.continuous_columns:
            parts.append(ks_per_column(self.real, synth, cont).select(F.lit("ks").alias("metric"), F.col("column").alias("key"), F.col("ks").alias("value")))
        if cat := self.schema.categorical_columns:
            parts.append(tvd_per_column(self.real, synth, cat).select(F.lit("tvd").alias("metric"), F.col("column").alias("key"), F.col("tvd").alias("value")))
        return reduce(DataFrame.unionByName, parts)

    def evaluate(self, synth: DataFrame, manifold: bool = True, c2st: bool = True) -> Dim1Result:
        from tabscore.operators.bootstrap import bootstrap_mean, proportion_interval
        from tabscore.operators.neighbors import manifold as manifold_of
        from tabscore.operators.utility import c2st_auc

        out = Dim1Result(skipped=self.skip_reasons(synth))
        for r in self.marginals(synth).collect():
            if r["key"] not in out.skipped:
                (out.ks if r["metric"] == "ks" else out.tvd)[r["key"]] = r["value"]
        mean = lambda d: sum(d.values()) / len(d) if d else None
        out.mean_ks, out.mean_tvd = mean(out.ks), mean(out.tvd)
        cont, cat = self.schema.continuous_columns, self.schema.categorical_columns
        if len(cont) > 1:
            out.pearson_matrix_error = matrix_error(pearson_pairs(self.real, cont), pearson_pairs(synth, cont), "r").first()["error"]
        if len(cat) > 1:
            # The cells are read for each sum that is made of them.
            out.cramerv_matrix_error = matrix_error(*(cramers_v(stable(contingency(d, list(combinations(cat, 2))))) for d in (self.real, synth)), "v").first()["error"]
        if manifold:
            found = manifold_of(self.real, synth, self.schema, self.k, self.max_samples, self.seed)
            out.alpha_precision, out.beta_recall = found.alpha_precision, found.beta_recall
            if self.n_boot and found.alpha_precision is not None:
                out.alpha_precision_ci = proportion_interval(round(found.alpha_precision * found.n_synth), found.n_synth, self.n_boot, self.ci, self.seed + 2)
                out.beta_recall_ci = proportion_interval(round(found.beta_recall * found.n_real), found.n_real, self.n_boot, self.ci, self.seed + 3)
        if c2st:
            out.c2st_auc = c2st_auc(self.real, synth, self.schema, self.n_splits, self.max_samples, self.seed, self.trees)
            known = [v for v in out.c2st_auc.values() if v is not None]
            out.c2st_auc_mean = sum(known) / len(known) if known else None
        if self.n_boot:
            out.mean_ks_ci = bootstrap_mean(list(out.ks.values()), self.n_boot, self.ci, self.seed)
            out.mean_tvd_ci = bootstrap_mean(list(out.tvd.values()), self.n_boot, self.ci, self.seed + 1)
        return out

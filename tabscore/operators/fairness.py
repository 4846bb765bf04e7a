"""Fairness: mutual information of protected columns with the target, and gaps between groups' predictions."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscore.functions.canon import canon, ratio
from tabscore.operators.bootstrap import group_mean_replicates, resampled_counts
from tabscore.operators.schema import DataSchema
from tabscore.operators.specs import FairSpec, GroupCollapseWarning, TaskType

MIN_NMI_ROWS = 10


def quantile_edges(real: DataFrame, column: str, bins: int = 5) -> list[float]:
    """The distinct inner edges of equal-frequency bins, with linear interpolation."""
    c = F.col(f"`{column}`").cast("double")
    row = real.agg(F.count(c).alias("n"), F.percentile(c, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("p")).first()
    if row["n"] < bins:
        bins = max(2, row["n"])
        row = real.agg(F.percentile(c, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("p")).first()
    edges = []
    for e in row["p"] or []:
        if not edges or e - edges[-1] > 1e-8:
            edges.append(e)
    return edges[1:-1]


def binned(c: Column, edges: list[float]) -> Column:
    """0 to len(edges): the bin [lo, hi) that c is in; values beyond the ends are in the end bins."""
    hits = [F.when(c.cast("double") >= e, 1).otherwise(0) for e in edges]
    total = F.lit(0)
    for h in hits:
        total = total + h
    return F.when(c.isNotNull(), total)


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, value): mutual information over the mean of the entropies, of text columns a and b; null below 10 rows."""
    joint = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    xs, ys = joint.groupBy("a").agg(F.sum("n").alias("na")), joint.groupBy("b").agg(F.sum("n").alias("nb"))
    total = joint.agg(F.sum("n").alias("t"))
    h = lambda d, c: d.agg(F.sum(F.col(c) * F.log(F.col(c).cast("double"))).alias(f"s_{c}"))
    mi = joint.join(xs, "a").join(ys, "b").agg(F.sum(F.col("n") * F.log(F.col("n").cast("double") / (F.col("na").cast("double") * F.col("nb")))).alias("s"))
    # One row from each of the four aggregates.
    row = total.join(h(xs, "na")).join(h(ys, "nb")).join(mi)
    t = F.col("t").cast("double")
    entropy = lambda c: F.log(t) - F.col(f"s_{c}") / t
    information = F.greatest(F.lit(0.0), F.col("s") / t + F.log(t))
    mean = (entropy("na") + entropy("nb")) / 2
    value = F.when(F.col("t") < MIN_NMI_ROWS, None).when(mean < 1e-12, 1.0).when(information < 1e-12, 0.0).otherwise(information / F.when(mean > 0, mean))
    return row.select(F.coalesce("t", F.lit(0)).alias("n"), value.alias("value"))


def cells(df: DataFrame, group: str, y: str | None, pred: str) -> DataFrame:
    """(g, y, p, n): all that the gaps need, a few rows whatever the size of df."""
    return df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), (F.col(y) if y else F.lit(None)).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def valid_groups(cell: DataFrame, min_group_size: int) -> tuple[DataFrame, DataFrame]:
    """The cells of groups that are large enough, and (g, n) of the others."""
    sizes = cell.groupBy("g").agg(F.sum("n").alias("size"))
    small = sizes.filter(F.col("size") < min_group_size).select("g", F.col("size").alias("n"))
    return cell.join(sizes.filter(F.col("size") >= min_group_size).select("g"), "g"), small


def collapse_message(column: str, group: str, n: int, k: int) -> str:
    return f"'{column}'='{group}': {n} samples < min_group_size={k}; excluded (NaN)."


def gap(rates: DataFrame, rate: str, by: list[str]) -> DataFrame:
    """max - min of the rates that aren't null, null for fewer than two."""
    return rates.groupBy(*by).agg(F.when(F.count(rate) >= 2, F.max(rate) - F.min(rate)).alias("gap"))


def class_rates(cell: DataFrame, classes: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, g, c, positive, tpr, fpr): for each group and class the rates of predicting it."""
    c = F.explode(F.array(*[F.lit(k) for k in classes])).alias("c")
    x = cell.select(*by, "g", "y", "p", "n", c)
    n_if = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    hit, is_c = F.col("p") == F.col("c"), F.col("y") == F.col("c")
    return x.groupBy(*by, "g", "c").agg(ratio(n_if(hit), F.sum("n")).alias("positive"), ratio(n_if(hit & is_c), n_if(is_c)).alias("tpr"), ratio(n_if(hit & ~is_c), n_if(~is_c)).alias("fpr"))


METRICS = ("delta_dp", "delta_eop", "delta_eo")


def gaps_of(cell: DataFrame, classes: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, metric, value): delta_dp, delta_eop, delta_eo; the mean over classes of the gaps that are defined."""
    rates = class_rates(cell, classes, by)
    g = lambda r: F.when(F.count(r) >= 2, F.max(r) - F.min(r))
    per = rates.groupBy(*by, "c").agg(g("positive").alias("dp"), g("tpr").alias("eop"), g("fpr").alias("fp"))
    row = per.groupBy(*by).agg(F.avg("dp").alias("delta_dp"), F.avg("eop").alias("delta_eop"), F.avg(F.greatest("eop", "fp")).alias("delta_eo"))
    return row.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))


def disparities(cell: DataFrame, classes: list[str], min_group_size: int = 30) -> DataFrame:
    """(metric, value) over the groups that are large enough."""
    return gaps_of(valid_groups(cell, min_group_size)[0], classes)


def disparity_intervals(replicates: DataFrame, classes: list[str], ci: float = 0.95) -> DataFrame:
    """(metric, lo, hi) of resampled cells (replicate, g, y, p, n): percentiles of the replicates' gaps."""
    at = F.percentile("value", F.array(F.lit((1 - ci) / 2), F.lit(1 - (1 - ci) / 2)))
    return gaps_of(replicates, classes, ("replicate",)).groupBy("metric").agg(at.alias("p")).select("metric", F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))


def stat_parity_gap(df: DataFrame, group: str, pred: str, min_group_size: int = 30) -> DataFrame:
    """(value): the gap of the groups' mean predictions."""
    means = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(pred).alias("m")).filter(F.col("n") >= min_group_size)
    return means.agg(F.when(F.count("m") >= 2, F.max("m") - F.min("m")).alias("value"))


def crossed(columns: list[str]) -> Column:
    """The combined group of several protected columns; a missing one is the group 'nan'."""
    return F.concat_ws("×", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


@dataclass
class Dim5Result:
    nmi: dict[str, float | None] = field(default_factory=dict)
    delta_dp: dict[str, float | None] = field(default_factory=dict)
    delta_eop: dict[str, float | None] | None = None
    delta_eo: dict[str, float | None] | None = None
    stat_parity_gap: dict[str, float | None] = field(default_factory=dict)
    intersectional_delta_dp: float | None = None
    delta_dp_ci: dict[str, tuple[float, float] | None] = field(default_factory=dict)
    delta_eop_ci: dict[str, tuple[float, float] | None] | None = None
    delta_eo_ci: dict[str, tuple[float, float] | None] | None = None
    stat_parity_gap_ci: dict[str, tuple[float, float] | None] = field(default_factory=dict)
    intersectional_delta_dp_ci: tuple[float, float] | None = None
    warnings: list[str] = field(default_factory=list)
    #: Why the probe failed: then all but the information measures is missing.
    error: str | None = None

    @property
    def summary(self) -> str:
        if self.error:
            return f"fairness: NMI {self.nmi}, the probe failed: {self.error}"
        return f"fairness: NMI {self.nmi}, DP {self.delta_dp}, EOP {self.delta_eop}, EO {self.delta_eo}, SPG {self.stat_parity_gap}"


class FairnessEvaluator:
    def __init__(self, real_df: DataFrame, schema: DataSchema, spec: FairSpec, trees: int = 100, random_state: int = 42, n_boot: int = 0, ci: float = 0.95):
        self.real, self.schema, self.spec, self.trees, self.seed = real_df, schema, spec, trees, random_state
        self.n_boot, self.ci = n_boot, ci
        unknown = {*spec.protected_cols, spec.target_col} - set(schema.column_names)
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        numbers = set(schema.continuous_columns)
        self.edges = {c: quantile_edges(real_df, c, spec.n_bins_continuous) for c in {*spec.protected_cols, spec.target_col} & numbers}

    def group(self, df: DataFrame, column: str) -> Column:
        c = F.col(f"`{column}`")
        return binned(c, self.edges[column]).cast("string") if column in self.edges else canon(c, df.schema[column].dataType, None)

    def _rate_intervals(self, cell: DataFrame, classes: list[str]) -> dict[str, tuple[float, float] | None]:
        """The intervals of a column's gaps, from resampled counts of its cells; groups that are too small stay out."""
        ok = valid_groups(cell, self.spec.min_group_size)[0]
        rows = disparity_intervals(resampled_counts(ok, self.n_boot, self.seed), classes, self.ci).collect()
        return dict.fromkeys(METRICS) | {r["metric"]: (r["lo"], r["hi"]) for r in rows if r["lo"] is not None}

    def _mean_interval(self, scored: DataFrame, group: str) -> tuple[float, float] | None:
        sizes = scored.filter(F.col(group).isNotNull()).groupBy(group).count().filter(F.col("count") >= self.spec.min_group_size).select(group)
        means = group_mean_replicates(scored.join(F.broadcast(sizes), group), group, "prediction", self.n_boot, self.seed)
        each = [[m for m in at if m is not None] for at in zip(*means.values(), strict=True)]
        gaps = [max(m) - min(m) for m in each if len(m) > 1]
        return tuple(float(x) for x in np.percentile(gaps, [50 * (1 - self.ci), 100 - 50 * (1 - self.ci)])) if gaps else None

    def evaluate(self, synth: DataFrame, test_real: DataFrame) -> Dim5Result:
        from tabscore.operators.utility import classes_of, fit_predict

        spec, out = self.spec, Dim5Result()
        tagged = synth.select(self.group(synth, spec.target_col).alias("t"), *[self.group(synth, c).alias(f"g{i}") for i, c in enumerate(spec.protected_cols)])
        for i, c in enumerate(spec.protected_cols):
            out.nmi[c] = nmi(tagged, f"g{i}", "t").first()["value"]
        try:
            scored = fit_predict(synth, test_real, self.schema, spec.target_col, spec.task_type, self.trees, self.seed)
            scored = scored.select("label", "prediction", *[self.group(test_real, c).alias(f"g{i}") for i, c in enumerate(spec.protected_cols)]).persist()
            regression = spec.task_type is TaskType.REGRESSION
            classes = [] if regression else classes_of(scored)
            if spec.task_type is TaskType.BINARY:
                classes = classes[-1:]
            if not regression:
                out.delta_eop, out.delta_eo, out.delta_eop_ci, out.delta_eo_ci = {}, {}, {}, {}
            for i, c in enumerate(spec.protected_cols):
                if regression:
                    out.stat_parity_gap[c] = stat_parity_gap(scored, f"g{i}", "prediction", spec.min_group_size).first()["value"]
                    if self.n_boot:
                        out.stat_parity_gap_ci[c] = self._mean_interval(scored, f"g{i}")
                    small = scored.filter(f"g{i} is not null").groupBy(F.col(f"g{i}").alias("g")).count().withColumnRenamed("count", "n").filter(F.col("n") < spec.min_group_size)
                else:
                    cell = cells(scored, f"g{i}", "label", "prediction")
                    values = {r["metric"]: r["value"] for r in disparities(cell, classes, spec.min_group_size).collect()}
                    out.delta_dp[c], out.delta_eop[c], out.delta_eo[c] = (values.get(m) for m in METRICS)
                    if self.n_boot:
                        spans = self._rate_intervals(cell, classes)
                        out.delta_dp_ci[c], out.delta_eop_ci[c], out.delta_eo_ci[c] = (spans[m] for m in METRICS)
                    small = valid_groups(cell, spec.min_group_size)[1]
                for r in small.orderBy("g").collect():
                    out.warnings.append(collapse_message(c, r["g"], r["n"], spec.min_group_size))
                    warnings.warn(out.warnings[-1], GroupCollapseWarning, stacklevel=2)
            if spec.intersectional and len(spec.protected_cols) > 1:
                both = scored.withColumn("g", crossed([f"g{i}" for i in range(len(spec.protected_cols))]))
                if regression:
                    out.intersectional_delta_dp = stat_parity_gap(both, "g", "prediction", spec.min_group_size).first()["value"]
                    out.intersectional_delta_dp_ci = self._mean_interval(both, "g") if self.n_boot else None
                else:
                    cell = cells(both, "g", "label", "prediction")
                    out.intersectional_delta_dp = {r["metric"]: r["value"] for r in disparities(cell, classes, spec.min_group_size).collect()}.get("delta_dp")
                    out.intersectional_delta_dp_ci = self._rate_intervals(cell, classes)["delta_dp"] if self.n_boot else None
            scored.unpersist()
        except Exception as e:  # the information measures stand without a probe
            out.error = f"{type(e).__name__}: {e}"
        return out

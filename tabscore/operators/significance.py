"""Whether two models differ: paired tests over runs, interval overlap for single runs, Holm's correction."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: metric: (path in a bundle, higher is better, path of its interval)
REGISTRY = {
    "irr": ("result0.irr", False, None),
    "mean_ks": ("result1.mean_ks", False, "result1.mean_ks_ci"),
    "mean_tvd": ("result1.mean_tvd", False, "result1.mean_tvd_ci"),
    "pearson_matrix_error": ("result1.pearson_matrix_error", False, None),
    "cramerv_matrix_error": ("result1.cramerv_matrix_error", False, None),
    "alpha_precision": ("result1.alpha_precision", True, None),
    "beta_recall": ("result1.beta_recall", True, None),
    "c2st_auc_mean": ("result1.c2st_auc_mean", False, None),
    "icvr": ("result2.icvr_overall", False, None),
    "hcs": ("result2.hcs_overall", False, None),
    "mdi_mean": ("result2.mdi_mean", False, None),
    "dsi_gap": ("result2.dsi_gap", False, None),
    "mle_tstr_primary": ("result3.tstr", True, None),
    "dcr_5th": ("result4.dcr_5th", True, None),
    "dcr_95th": ("result4.dcr_95th", True, None),
    "exact_match_rate": ("result4.exact_match_rate", False, None),
    "delta_dp": ("result5.delta_dp", False, None),
    "delta_eop": ("result5.delta_eop", False, None),
    "delta_eo": ("result5.delta_eo", False, None),
}


def holm_adjust(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df (.., p) with p_adjusted: step-down products, made monotone, capped at 1; null p-values stay null.

    The window runs over the tests of a comparison (one row a metric), not over data.
    """
    by = by or []
    keyed = df.withColumn("_null", F.col("p").isNull())
    w = Window.partitionBy(*by, "_null")
    ranked = keyed.withColumn("_rank", F.row_number().over(w.orderBy("p", "metric"))).withColumn("_m", F.count("*").over(w))
    product = F.least(F.lit(1.0), F.col("p") * (F.col("_m") - F.col("_rank") + 1))
    running = F.max(product).over(w.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_adjusted", F.when(~F.col("_null"), running)).drop("_null", "_rank", "_m")


def paired(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, run, d): b's value less a's in the runs that both have."""
    side = lambda m, n: runs.filter((F.col("model") == m) & F.col("value").isNotNull()).select("metric", "run", F.col("value").alias(n))
    return side(a, "x").join(side(b, "y"), ["metric", "run"]).select("metric", "run", (F.col("y") - F.col("x")).alias("d"))


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """(metric, n, n_nonzero, w_plus, w_minus, effect): ranks of |d| with ties averaged, zeros left out of them."""
    ranked = pairs.withColumn("_zero", F.col("d") == 0).withColumn("_abs", F.abs("d"))
    ties = Window.partitionBy("metric", "_zero", "_abs")
    rank = F.rank().over(Window.partitionBy("metric", "_zero").orderBy("_abs")) + (F.count("*").over(ties) - 1) / 2
    ranked = ranked.withColumn("_rank", F.when(~F.col("_zero"), rank))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_rank"))), F.lit(0.0))
    out = ranked.groupBy("metric").agg(F.count("*").alias("n"), F.count("_rank").alias("n_nonzero"), total(F.col("d") > 0).alias("w_plus"), total(F.col("d") < 0).alias("w_minus"))
    return out.withColumn("effect", 1 - 2 * F.least("w_plus", "w_minus") / (F.col("n") * (F.col("n") + 1) / 2))


def paired_t(pairs: DataFrame) -> DataFrame:
    """(metric, n, mean, t, effect); null t and effect for a deviation of 0."""
    out = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("s"))
    s = F.when(F.col("s") > 0, F.col("s"))
    return out.select("metric", "n", "mean", (F.col("mean") / (s / F.sqrt(F.col("n").cast("double")))).alias("t"), (F.col("mean") / s).alias("effect"))


def ci_overlap(intervals: DataFrame) -> DataFrame:
    """(metric, overlap, significant) from (metric, lo_a, hi_a, lo_b, hi_b): touching intervals don't overlap."""
    both = F.greatest("lo_a", "lo_b") < F.least("hi_a", "hi_b")
    return intervals.select("metric", both.alias("overlap"), (~both).alias("significant"))


def wilcoxon_p(ranks: list[float], w: float) -> float:
    """Exact two-sided chance that the smaller rank sum is w or less, by counting the signs' sums; 1 for no ranks."""
    if not ranks:
        return 1.0
    doubled = [round(2 * r) for r in ranks]
    ways = [1.0] + [0.0] * sum(doubled)
    for r in doubled:
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return min(1.0, 2 * sum(ways[: round(2 * w) + 1]) / 2 ** len(doubled))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p(t: float, df: int) -> float:
    """Two-sided chance of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


@dataclass
class MetricTestResult:
    metric: str
    mean_a: float | None
    mean_b: float | None
    difference: float | None
    method: str
    p_value: float | None = None
    p_adjusted: float | None = None
    effect: float | None = None
    significant: bool = False


@dataclass
class SignificanceReport:
    model_a: str
    model_b: str
    alpha: float
    results: list[MetricTestResult] = field(default_factory=list)

    @property
    def summary(self) -> str:
        lines = [f"{self.model_a} against {self.model_b}, alpha {self.alpha}"]
        return "\n".join(lines + [f"  {r.metric}: {r.difference} ({r.method}, p {r.p_adjusted if r.p_adjusted is not None else r.p_value})" + " *" * r.significant for r in self.results])


class SignificanceTester:
    """Compares the bundles of two models (dictionaries of metric: value, and of metric: (lo, hi) for single runs)."""

    def __init__(self, alpha: float = 0.05):
        if not 0 < alpha < 1:
            raise ValueError("alpha must be between 0 and 1")
        self.alpha = alpha

    def test(self, metric: str, a: list[float | None], b: list[float | None]) -> MetricTestResult:
        both = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None and not math.isnan(x + y)]
        n = len(both)
        mean = lambda v: sum(v) / len(v) if v else None
        ma, mb = mean([x for x, _ in both]), mean([y for _, y in both])
        out = MetricTestResult(metric, ma, mb, mb - ma if n else None, "na")
        if n < 2:
            return out
        d = [y - x for x, y in both]
        if n >= 5:
            size = sorted(abs(x) for x in d if x)
            rank = lambda v: sum(i + 1 for i, s in enumerate(size) if s == v) / size.count(v)
            plus, minus = sum(rank(abs(x)) for x in d if x > 0), sum(rank(abs(x)) for x in d if x < 0)
            out.method, out.p_value, out.effect = "wilcoxon", wilcoxon_p([rank(s) for s in size], min(plus, minus)), 1 - 2 * min(plus, minus) / (n * (n + 1) / 2)
        else:
            m = sum(d) / n
            s = math.sqrt(sum((x - m) ** 2 for x in d) / (n - 1))
            out.method, out.p_value, out.effect = "paired_t", t_p(m / (s / math.sqrt(n)), n - 1) if s else (1.0 if m == 0 else 0.0), m / s if s else None
        out.significant = out.p_value < self.alpha
        return out

    def compare(self, bundles_a: list, bundles_b: list, model_a: str = "a", model_b: str = "b", metrics: list[str] | None = None, correction: str | None = "holm") -> SignificanceReport:
        from tabscore.plans.bundle import extract, extract_interval

        if not bundles_a or not bundles_b:
            raise ValueError("each model needs a bundle")
        many = len(bundles_a) > 1 and len(bundles_b) > 1
        if many and len(bundles_a) != len(bundles_b):
            raise ValueError("runs are paired: both models need as many")
        out = SignificanceReport(model_a, model_b, self.alpha)
        for m in metrics or REGISTRY:
            if m not in REGISTRY:
                continue
            path, _, interval = REGISTRY[m]
            if many:
                out.results.append(self.test(m, [extract(x, path) for x in bundles_a], [extract(x, path) for x in bundles_b]))
                continue
            a, b = extract(bundles_a[0], path), extract(bundles_b[0], path)
            r = MetricTestResult(m, a, b, b - a if None not in (a, b) else None, "na")
            ia, ib = (extract_interval(x[0], interval) if interval else None for x in (bundles_a, bundles_b))
            if ia and ib:
                r.method, r.significant = "ci_overlap", not max(ia[0], ib[0]) < min(ia[1], ib[1])
            out.results.append(r)
        if correction == "holm":
            tested = sorted((r for r in out.results if r.p_value is not None), key=lambda r: r.p_value)
            top = 0.0
            for i, r in enumerate(tested):
                top = max(top, min(1.0, r.p_value * (len(tested) - i)))
                r.p_adjusted, r.significant = top, top < self.alpha
        return out

"""Profiles of a dataset: one wide aggregation for all columns, one long one for all pairs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.functions.canon import canon, ingest, parse_number, ratio
from tabscore.functions.exact import ordered_sum
from tabscore.operators.fidelity import cramers_v_pairs, pearson_pairs
from tabscore.operators.logic import fd_scan, fd_violation_rate

NUMERIC_SHARE, BIMODAL = 0.9, 5 / 9


def as_number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    c = F.col(f"`{column}`")
    return parse_number(c) if kind == "string" else c.cast("int").cast("double") if kind == "boolean" else c.cast("double")


def numeric_columns(df: DataFrame, share: float = NUMERIC_SHARE) -> list[str]:
    """Columns of whose non-null values at least share are numbers, however few different ones."""
    row = df.agg(*[f.alias(f"{t}{i}") for i, c in enumerate(df.columns) for t, f in (("n", F.count(F.col(f"`{c}`"))), ("k", F.count(as_number(df, c))))]).first()
    return [c for i, c in enumerate(df.columns) if row[f"n{i}"] and row[f"k{i}"] >= share * row[f"n{i}"]]


def bimodality(skew: Column, kurt: Column, n: Column) -> Column:
    """(skew² + 1) / (excess kurtosis + 3 (n - 1)² / ((n - 2) (n - 3))), null below four rows."""
    x = n.cast("double")
    return F.when(n > 3, (skew * skew + 1) / F.when(n > 3, kurt + 3 * (x - 1) * (x - 1) / F.when(n > 3, (x - 2) * (x - 3))))


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing_rate, mean, std, min, max, skew, kurtosis, bimodality, is_multimodal), from two scans: the first
    gets the sizes by which the second adds up means that don't depend on the rows' order."""
    size = df.agg(*[g.alias(f"{k}{i}") for i, c in enumerate(columns) for k, g in (("k", F.count(as_number(df, c))), ("m", F.max(F.abs(as_number(df, c)))))]).first()
    means = {c: ordered_sum(as_number(df, c), size[f"m{i}"], size[f"k{i}"]) / F.nullif(F.count(as_number(df, c)), F.lit(0)) for i, c in enumerate(columns)}
    f = {"n": F.count, "std": F.stddev_samp, "min": F.min, "max": F.max, "skew": F.skewness, "kurtosis": F.kurtosis}
    row = df.agg(F.count("*").alias("rows"), *[v.alias(f"{k}{i}") for i, c in enumerate(columns) for k, v in (*((k, g(as_number(df, c))) for k, g in f.items()), ("mean", means[c]))])
    cells = [F.struct(F.lit(c).alias("column"), F.col("rows"), *[F.col(f"{k}{i}").alias(k) for k in (*f, "mean")]) for i, c in enumerate(columns)]
    out = row.select(F.inline(F.array(*cells)))
    out = out.withColumns({"skew": F.when(F.col("n") >= 3, F.col("skew")), "kurtosis": F.when(F.col("n") >= 4, F.col("kurtosis"))})
    out = out.withColumn("bimodality", bimodality(F.col("skew"), F.col("kurtosis"), F.col("n")))
    return out.select("column", "n", (1 - ratio(F.col("n"), F.col("rows"))).alias("missing_rate"), "mean", "std", "min", "max", "skew", "kurtosis", "bimodality", (F.col("bimodality") > BIMODAL).alias("is_multimodal"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, n) of all columns, from one shuffle of pre-aggregated cells."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), canon(F.col(f"`{c}`"), kinds[c], None).alias("v")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "v").agg(F.count("*").alias("n"))


def profile_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing_rate, n_unique, top, top_share); of equally frequent values the smallest is the top."""
    counts = value_counts(df, columns)
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    out = counts.groupBy("column").agg(F.coalesce(F.sum(known), F.lit(0)).alias("n"), F.sum("n").alias("rows"), F.count("v").alias("n_unique"), F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("k"), "v"))).alias("t"))
    return out.select("column", "n", (1 - ratio(F.col("n"), F.col("rows"))).alias("missing_rate"), "n_unique", F.col("t.v").alias("top"), ratio(-F.col("t.k"), F.col("n")).alias("top_share"))


def missing_rate(df: DataFrame) -> DataFrame:
    cells = sum((F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in df.columns), F.lit(0))
    return df.agg(cells.alias("n_missing"), F.count("*").alias("n_rows")).select("n_rows", "n_missing", ratio(F.col("n_missing"), F.col("n_rows") * len(df.columns)).alias("value"))


def top_pairs(pairs: DataFrame, value: str, columns: list[str], k: int = 5) -> DataFrame:
    """The k pairs with the largest absolute values, ties in the order of the columns."""
    place = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    return pairs.filter(F.col(value).isNotNull()).orderBy(F.abs(F.col(value)).desc(), place[F.col("a")], place[F.col("b")]).limit(k)


def class_imbalance(df: DataFrame, candidates: list[str], least: int = 2, most: int = 20) -> DataFrame:
    """(target, value): the largest class over the smallest, of the candidate with the fewest missing values (the first
    of several) and least to most classes."""
    per = value_counts(df, candidates).groupBy("column").agg(F.count("v").alias("k"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("hi"), F.min(F.when(F.col("v").isNotNull(), F.col("n"))).alias("lo"))
    place = F.create_map(*[F.lit(x) for i, c in enumerate(candidates) for x in (c, i)])
    best = per.filter((F.col("k") >= least) & (F.col("k") <= most)).agg(F.min(F.struct("missing", place[F.col("column")].alias("place"), F.col("column").alias("target"), ratio(F.col("hi"), F.col("lo")).alias("value"))).alias("b"))
    return best.select("b.target", "b.value")


@dataclass
class ColumnProfile:
    name: str
    kind: str
    stats: dict


@dataclass
class DatasetProfile:
    name: str
    n_rows: int
    n_columns: int
    missing_rate: float | None
    columns: dict[str, ColumnProfile] = field(default_factory=dict)
    pearson_pairs: list[tuple] = field(default_factory=list)
    cramer_pairs: list[tuple] = field(default_factory=list)
    fds: list[tuple] = field(default_factory=list)
    target: str | None = None
    class_imbalance: float | None = None

    @property
    def summary(self) -> str:
        lines = [f"{self.name}: {self.n_rows} rows x {self.n_columns} columns, {self.missing_rate or 0:.2%} missing"]
        lines += [f"  {c.name} ({c.kind}): " + ", ".join(f"{k} {v}" for k, v in c.stats.items()) for c in self.columns.values()]
        lines += [f"  r({a}, {b}) = {r:.3f}" for a, b, r in self.pearson_pairs] + [f"  V({a}, {b}) = {v:.3f}" for a, b, v in self.cramer_pairs]
        return "\n".join(lines + [f"  {a} -> {b} (violations {r:.2%})" for a, b, r in self.fds])


class DatasetProfiler:
    def __init__(self, top_k_pairs: int = 5, fd_max_violation_rate: float = 0.05, fd_min_support: int = 10, infer_target_col: bool = True):
        self.k, self.most, self.support, self.infer = top_k_pairs, fd_max_violation_rate, fd_min_support, infer_target_col

    def profile(self, df: DataFrame, name: str = "dataset") -> DatasetProfile:
        df = ingest(df).persist()
        try:
            cont = numeric_columns(df)
            cat = [c for c in df.columns if c not in cont]
            m = missing_rate(df).first()
            out = DatasetProfile(name, m["n_rows"], len(df.columns), m["value"])
            found = {}
            for kind, rows in (("continuous", profile_numeric(df, cont).collect() if cont else []), ("categorical", profile_categorical(df, cat).collect() if cat else [])):
                found |= {r["column"]: ColumnProfile(r["column"], kind, {k: v for k, v in r.asDict().items() if k != "column"}) for r in rows}
            out.columns = {c: found[c] for c in df.columns}
            numbers = df.select(*[as_number(df, c).alias(c) for c in cont])
            if len(cont) > 1:
                out.pearson_pairs = [tuple(r) for r in top_pairs(pearson_pairs(numbers, cont), "r", cont, self.k).collect()]
            if len(cat) > 1:
                out.cramer_pairs = [tuple(r) for r in top_pairs(cramers_v_pairs(df, cat), "v", cat, self.k).collect()]
            for r in fd_scan(df, df.columns).collect():
                rate = fd_violation_rate(df, r["det"], r["dep"], self.support).first()["value"]
                if rate is not None and rate <= self.most:
                    out.fds.append((r["det"], r["dep"], rate))
            if self.infer and cat and (r := class_imbalance(df, cat).first()):
                out.target, out.class_imbalance = r["target"], r["value"]
            return out
        finally:
            df.unpersist()


# Comparison of marginals


def coverage_rate(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, value): the share of synthetic values that are in the real column."""
    known = value_counts(real, columns).filter("v is not null").select("column", "v", F.lit(1).alias("hit"))
    seen = value_counts(synth, columns).filter("v is not null").join(known, ["column", "v"], "left")
    return seen.groupBy("column").agg(F.sum("n").alias("n"), ratio(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)), F.sum("n")).alias("value"))


def mean_std_error(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean_error, std_error): relative errors of the synthetic mean and deviation."""
    side = lambda d, t: d.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{t}{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    row = side(real, "r").join(side(synth, "s"))  # one row each
    err = lambda k, i: F.abs(F.col(f"s{k}{i}") - F.col(f"r{k}{i}")) / (F.abs(F.col(f"r{k}{i}")) + 1e-8)
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), err("m", i).alias("mean_error"), err("s", i).alias("std_error")) for i, c in enumerate(columns)])))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(column, v, n, rank) of each column's k most frequent values, ties by text."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "v"))
    return value_counts(df, columns).filter("v is not null").withColumn("rank", rank).filter(F.col("rank") <= k)


def top_overlap(real: DataFrame, synth: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(column, n_common) of the k most frequent values of each side."""
    a, b = top_values(real, columns, k).select("column", "v"), top_values(synth, columns, k).select("column", "v", F.lit(1).alias("hit"))
    return a.join(b, ["column", "v"], "left").groupBy("column").agg(F.count("hit").alias("n_common"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """(v, n, share)."""
    counts = value_counts(df, [column]).filter("v is not null").select("v", "n")
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(total).select("v", "n", ratio(F.col("n"), F.col("t")).alias("share"))  # one row to each


def quality_score(coverage: DataFrame, errors: DataFrame) -> DataFrame:
    """(value): 0.6 of the mean coverage, 0.4 of one less the mean error (1 at most)."""
    c = coverage.agg(F.avg("value").alias("c"))
    e = errors.select(F.explode(F.array("mean_error", "std_error")).alias("e")).agg(F.avg("e").alias("e"))
    return c.join(e).select((0.6 * F.coalesce("c", F.lit(0.0)) + 0.4 * (1 - F.least(F.coalesce("e", F.lit(0.0)), F.lit(1.0)))).alias("value"))

"""Nearest records: k-NN radius, precision and recall of the manifold, distance to the closest record, exact copies.

Searches are by name and give the same results. `arrow` prunes by an index and is exact (see `search`). `sql` compares
all pairs by a nested-loop join with one side broadcast, and is taken only where that side has no more than SQL_ROWS
rows. Another search can be registered under a name of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.functions.canon import canon, ingest, ratio
from tabscore.functions.stable import stable, written
from tabscore.operators.bootstrap import percentile_positions, proportion_interval
from tabscore.operators.encoders import NA, build_feature_encoder, min_max, zero_filled_bounds
from tabscore.operators.sampling import uniform_sample
from tabscore.operators.schema import DataSchema
from tabscore.operators.search import Metric, by_index

SQL_ROWS = 5_000
EXACT, WARN_RATE = 1e-5, 0.01


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squares(a, b))


def squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _differ(a: Column, b: Column, cost: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0.0).otherwise(cost(x, y))), F.lit(0.0), lambda s, x: s + x)


def _euclidean(v: Column, w: Column, c: Column, d: Column) -> Column:
    return F.sqrt(squares(v, w) + _differ(c, d, lambda x, y: F.when((x < 0) | (y < 0), 1.0).otherwise(2.0)))


def mixed_distance(na: Column, nb: Column, ca: Column, cb: Column) -> Column:
    """Sum of absolute differences of numbers, plus the number of differing categories."""
    return F.aggregate(F.zip_with(na, nb, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) + _differ(ca, cb, lambda x, y: F.lit(1.0))


#: Euclidean over numbers and one-hot categories, which are codes here: two known ones differ by 2, one of them unknown
#: (-1, all zeros) by 1. Mixed: absolute differences of numbers, and 1 for each differing category.
EUCLIDEAN = Metric(_euclidean, 2, 2.0, 1.0)
MIXED = Metric(mixed_distance, 1, 1.0, 1.0)


def by_broadcast(left: DataFrame, right: DataFrame, k: int, skip_self: bool, metric: Metric) -> DataFrame:
    """(id, nearest, distance) of all pairs, or of the nearest ones for k = 1."""
    pairs = left.alias("l").join(F.broadcast(right).alias("r"), (F.col("l.id") != F.col("r.id")) if skip_self else F.lit(True))
    found = metric.column(F.col("l.v"), F.col("r.v"), F.col("l.c"), F.col("r.c"))
    return pairs.select(F.col("l.id").alias("id"), F.col("r.id").alias("nearest"), found.alias("distance"))


#: name -> search(left, right, k, skip_self, metric), which returns (id, nearest, distance) with the k nearest among
#: them, or (id, rank, nearest, distance) with these alone.
SEARCHES: dict[str, Callable[..., DataFrame]] = {"sql": by_broadcast, "arrow": by_index}


def register_search(name: str, search: Callable[..., DataFrame]) -> None:
    if name == "auto":
        raise ValueError("auto chooses among the others")
    SEARCHES[name] = search


def route(strategy: str, n_right: int | None = None) -> str:
    """The name of the search to take: sql is taken only for a right side that may be broadcast."""
    if strategy != "auto" and strategy not in SEARCHES:
        raise ValueError(f"strategy is auto or one of {sorted(SEARCHES)}, not {strategy!r}")
    if strategy == "auto" or strategy == "sql" and (n_right is None or n_right > SQL_ROWS):
        return "arrow"
    return strategy


def _as_rows(df: DataFrame) -> DataFrame:
    """(id, v, c) of rows with numbers in v or x, and codes in c, if there are any."""
    v = F.col("v") if "v" in df.columns else F.col("x")
    return df.select("id", v.cast("array<double>").alias("v"), (F.col("c") if "c" in df.columns else F.array()).cast("array<bigint>").alias("c"))


def nearest(left: DataFrame, right: DataFrame, k: int = 1, skip_self: bool = False, strategy: str = "auto", metric: Metric = EUCLIDEAN) -> DataFrame:
    """(id, rank, nearest, distance): for each left row its k nearest right rows, ties by id.

    Rows are (id, x) with an array of numbers, or (id, v, c) with category codes too; ids tell rows apart.
    """
    same = left is right
    left, right = _as_rows(left), _as_rows(right)
    name = route(strategy, right.count() if strategy == "sql" else None)
    best = SEARCHES[name](right if same else left, right, k, skip_self, metric)
    if "rank" in best.columns:
        return best.select("id", "rank", "nearest", "distance")
    if k == 1:
        return best.groupBy("id").agg(F.min(F.struct("distance", "nearest")).alias("m")).select("id", F.lit(1).alias("rank"), "m.nearest", "m.distance")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "nearest"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "nearest", "distance")


def knn_radius(real: DataFrame, k: int = 5, strategy: str = "auto") -> DataFrame:
    """(id, radius): the distance of each row's k-th neighbour, itself not counted."""
    return nearest(real, real, k, True, strategy).filter(F.col("rank") == k).select("id", F.col("distance").alias("radius"))


def alpha_precision(real: DataFrame, synth: DataFrame, radii: DataFrame, strategy: str = "auto") -> DataFrame:
    """(n, value): synthetic rows within the radius of their nearest real row."""
    near = nearest(synth, real, 1, False, strategy).join(radii.withColumnRenamed("id", "nearest"), "nearest")
    return near.agg(F.count("*").alias("n"), F.avg((F.col("distance") <= F.col("radius")).cast("double")).alias("value"))


def beta_recall(real: DataFrame, synth: DataFrame, radii: DataFrame, strategy: str = "auto") -> DataFrame:
    """(n, value): real rows with a synthetic row within their radius."""
    near = nearest(real, synth, 1, False, strategy).join(radii, "id")
    return near.agg(F.count("*").alias("n"), F.avg((F.col("distance") <= F.col("radius")).cast("double")).alias("value"))


@dataclass
class Manifold:
    """Precision and recall, and how many rows they are shares of."""

    alpha_precision: float | None = None
    beta_recall: float | None = None
    n_synth: int = 0
    n_real: int = 0


def manifold(real: DataFrame, synth: DataFrame, schema: DataSchema, k: int = 5, max_samples: int = 50_000, seed: int = 42) -> Manifold:
    """Over max_samples rows of each side; rows and their ids are kept, so that a lost executor changes none."""
    encoder = build_feature_encoder(schema, real)
    sides = []
    for df in (real, synth):
        rows = encoder.compact(uniform_sample(ingest(df), max_samples, seed), "v", "c").select("v", F.col("c").cast("array<bigint>").alias("c"))
        sides.append(stable(rows.withColumn("id", F.monotonically_increasing_id())))
    n, m = sides[0].count(), sides[1].count()
    k = min(k, n - 1)
    if k < 1 or not m:
        return Manifold()
    radii = stable(knn_radius(sides[0], k))
    return Manifold(alpha_precision(*sides, radii).first()["value"], beta_recall(*sides, radii).first()["value"], m, n)


def manifold_metrics(real: DataFrame, synth: DataFrame, schema: DataSchema, k: int = 5, max_samples: int = 50_000, seed: int = 42) -> tuple[float | None, float | None]:
    found = manifold(real, synth, schema, k, max_samples, seed)
    return found.alpha_precision, found.beta_recall


# Distance to the closest record


def dcr_form(df: DataFrame, schema: DataSchema, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(nums, cats) of each row: scaled numbers and canonical texts."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nums = F.array(*[min_max(F.col(f"`{c}`"), bounds[c]) for c in schema.continuous_columns]).cast("array<double>")
    cats = F.array(*[canon(F.col(f"`{c}`"), kinds[c], NA) for c in schema.categorical_columns]).cast("array<string>")
    return df.select("*", nums.alias("nums"), cats.alias("cats"))


def _coded(df: DataFrame, schema: DataSchema, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """df with v, its scaled numbers, and c, the codes of its categories."""
    codes = F.transform("cats", lambda x: F.xxhash64(x)).cast("array<bigint>")
    return dcr_form(df, schema, bounds).withColumns({"v": F.col("nums"), "c": codes})


def dcr_rows(real: DataFrame, synth: DataFrame, schema: DataSchema, id_col: str = "id", strategy: str = "auto") -> DataFrame:
    """(id, dcr): each synthetic row's distance to the closest real one."""
    bounds = zero_filled_bounds(real, schema.continuous_columns) if schema.continuous_columns else {}
    r = _coded(real, schema, bounds).select("v", "c").distinct().withColumn("id", F.xxhash64("v", "c"))
    s = _coded(synth, schema, bounds).select(F.col(id_col).alias("id"), "v", "c")
    return nearest(s, r, 1, False, strategy, MIXED).select("id", F.col("distance").alias("dcr"))


def dcr_counts(real: DataFrame, synth: DataFrame, schema: DataSchema, strategy: str = "auto") -> DataFrame:
    """(dcr, n): the distances of `dcr_rows` and how many rows have each, for what is said about all rows together.

    Equal rows are looked for once, so no id has to be kept for each, and what is written are the different rows.
    """
    bounds = zero_filled_bounds(real, schema.continuous_columns) if schema.continuous_columns else {}
    r = written(_coded(real, schema, bounds).select("v", "c").distinct().withColumn("id", F.xxhash64("v", "c")), "real")
    s = written(_coded(synth, schema, bounds).groupBy("v", "c").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "synth")
    found = nearest(s, r, 1, False, strategy, MIXED).join(s.select("id", "n"), "id")
    return found.groupBy(F.col("distance").alias("dcr")).agg(F.sum("n").alias("n"))


def _times(rows: DataFrame) -> Column:
    return F.col("n") if "n" in rows.columns else F.lit(1).cast("bigint")


def dcr_percentiles(rows: DataFrame) -> DataFrame:
    """Of rows (dcr), or of counts (dcr, n)."""
    n = _times(rows)
    return rows.agg(F.percentile("dcr", F.array(F.lit(0.05), F.lit(0.95)), n).alias("p"), F.coalesce(F.sum(n), F.lit(0)).alias("n")).select("n", F.get("p", F.lit(0)).alias("dcr_5th"), F.get("p", F.lit(1)).alias("dcr_95th"))


def dcr_intervals(rows: DataFrame, n_boot: int, ci: float = 0.95, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Bootstrap intervals of the two percentiles: from the ranks that they have in resamples, by one aggregation."""
    n = rows.agg(F.sum(_times(rows))).first()[0] or 0
    spans = {name: percentile_positions(n, q, n_boot, ci, seed + i) for i, (name, q) in enumerate((("dcr_5th", 0.05), ("dcr_95th", 0.95)))}
    at = [p for span in spans.values() for p in span]
    found = rows.agg(F.percentile("dcr", F.array(*[F.lit(p) for p in at]), _times(rows))).first()[0] if n else None
    return {name: (found[2 * i], found[2 * i + 1]) for i, name in enumerate(spans)} if found else {}


def exact_match_rate(rows: DataFrame, eps: float = EXACT) -> DataFrame:
    n = _times(rows)
    hits = F.sum(F.when(F.col("dcr") < eps, n).otherwise(0))
    return rows.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), ratio(hits, F.sum(n)).alias("value"))


def copy_ratio(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """(n, n_copies, value): synthetic rows that equal a real one in all columns, nulls equal to nulls."""
    a, b = synth.select(*columns).alias("a"), real.select(*columns).distinct().alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    found = a.join(b.withColumn("_hit", F.lit(1)).alias("b"), same, "left")
    return found.agg(F.count("*").alias("n"), F.count("_hit").alias("n_copies")).withColumn("value", F.when(F.col("n") > 0, F.col("n_copies") / F.col("n")))


@dataclass
class Dim4Result:
    dcr_5th: float | None = None
    dcr_95th: float | None = None
    exact_match_rate: float | None = None
    dlt_gap: float | None = None
    dcr_5th_ci: tuple[float, float] | None = None
    dcr_95th_ci: tuple[float, float] | None = None
    exact_match_rate_ci: tuple[float, float] | None = None

    @property
    def summary(self) -> str:
        return f"privacy: DCR 5 % {self.dcr_5th}, 95 % {self.dcr_95th}, exact {self.exact_match_rate}"


class PrivacyEvaluator:
    def __init__(self, real_df: DataFrame, schema: DataSchema, strategy: str = "auto", max_rows: int | None = None, seed: int = 42, n_boot: int = 0, ci: float = 0.95):
        self.real, self.schema, self.strategy, self.max_rows, self.seed = ingest(real_df), schema, strategy, max_rows, seed
        self.n_boot, self.ci = n_boot, ci

    def evaluate(self, synth: DataFrame) -> Dim4Result:
        import warnings

        from tabscore.operators.specs import DataCopyingWarning

        real, synth = self.real, ingest(synth)
        if self.max_rows:
            real, synth = uniform_sample(real, self.max_rows, self.seed), uniform_sample(synth, self.max_rows, self.seed)
        rows = stable(dcr_counts(real, synth, self.schema, self.strategy))
        p, exact = dcr_percentiles(rows).first(), exact_match_rate(rows).first()
        rate = exact["value"]
        if rate is not None and rate > WARN_RATE:
            warnings.warn(f"{rate:.1%} of the synthetic rows copy a real one", DataCopyingWarning, stacklevel=2)
        out = Dim4Result(p["dcr_5th"], p["dcr_95th"], rate)
        if self.n_boot and exact["n"]:
            spans = dcr_intervals(rows, self.n_boot, self.ci, self.seed)
            out.dcr_5th_ci, out.dcr_95th_ci = spans["dcr_5th"], spans["dcr_95th"]
            out.exact_match_rate_ci = proportion_interval(round(rate * exact["n"]), exact["n"], self.n_boot, self.ci, self.seed + 2)
        return out

"""Reading and writing tables, and bringing two of them to the same columns."""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.operators.sampling import chance


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, as_text: bool = False) -> DataFrame:
    """A CSV with a header: typed by schema, all texts, or inferred."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", not as_text).csv(path)


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV with a header; doubles with so many decimals if given."""
    if decimals is not None:
        df = df.select(*[F.format_string(f"%.{decimals}f", F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])
    df.write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; those that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_to_csv(spark: SparkSession, source: str, target: str, schema: T.StructType | str) -> None:
    write_csv(read_jsonl(spark, source, schema), target)


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def find_source(spark: SparkSession, pattern: str) -> str:
    """The first path, by name, that a glob matches, in whatever file system Spark reads."""
    p, fs = _hadoop_path(spark, pattern)
    found = sorted(s.getPath().toString() for s in fs.globStatus(p) or [])
    if not found:
        raise FileNotFoundError(pattern)
    return found[0]


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return bool(fs.exists(p))


def listing(spark: SparkSession, paths: list[str]) -> str:
    """A hash of the files under some paths (names, sizes, times of change), in whatever file system they are."""
    digest = hashlib.sha256()
    for path in sorted(paths):
        p, fs = _hadoop_path(spark, path)
        files = fs.listFiles(p, True)
        rows = []
        while files.hasNext():
            f = files.next()
            rows.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        digest.update("\n".join([path, *sorted(rows)]).encode())
    return digest.hexdigest()


def cached_table(spark: SparkSession, path: str, make, inputs: list[str] = (), key: str = "") -> DataFrame:
    """A Parquet table under path, made and published first if it isn't there for these inputs and this key.

    The table is written aside, and renamed when it is whole, so a write that failed is never read as a result. Its name
    tells the inputs' files and the key (a schema's fingerprint, parameters): if one changes, it is made anew. Of two
    that make it at once, the first to rename publishes it.
    """
    name = hashlib.sha256("\n".join([listing(spark, list(inputs)), key]).encode()).hexdigest()[:32]
    at = f"{path.rstrip('/')}/{name}"
    if not exists(spark, f"{at}/_SUCCESS"):
        aside = f"{path.rstrip('/')}/.making-{uuid.uuid4().hex}"
        make().write.parquet(aside)
        (p, fs), (q, _) = _hadoop_path(spark, aside), _hadoop_path(spark, at)
        if not fs.exists(q):
            fs.rename(p, q)
        if fs.exists(p):
            fs.delete(p, True)
        if not exists(spark, f"{at}/_SUCCESS"):
            raise OSError(f"{at} could not be published")
    return spark.read.parquet(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in whatever file system Spark writes: written aside and renamed, so it is whole or not there."""
    p, fs = _hadoop_path(spark, path)
    aside, _ = _hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"{path} could not be published")


def read_text(spark: SparkSession, path: str) -> str:
    found = spark.read.text(path, wholetext=True).collect()
    if len(found) != 1:
        raise FileNotFoundError(path)
    return found[0][0]


def align_columns(df: DataFrame, real: DataFrame) -> DataFrame:
    """The columns of real in its order: missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in real.schema.fields])


def drop_time_index(df: DataFrame, name: str = "t") -> DataFrame:
    return df.drop(name)


def configured_columns(df: DataFrame, order: list[str] | None = None, drop: list[str] = ()) -> DataFrame:
    """Without the columns to drop, the ordered ones first."""
    rest = [c for c in df.columns if c not in drop]
    first = [c for c in order or [] if c in rest]
    return df.select(*first, *[c for c in rest if c not in first])


def drop_empty(*frames: DataFrame) -> list[DataFrame]:
    """Each frame without all-null columns, then without all-null rows, then with the columns that all have."""
    out = []
    for df in frames:
        n = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
        out.append(df.select(*[F.col(f"`{c}`") for c in df.columns if n[c]]).dropna(how="all"))
    common = [c for c in out[0].columns if all(c in d.columns for d in out)]
    return [d.select(*common) for d in out]


def rounded_coordinates(df: DataFrame, columns: list[str] = ("lat", "lon"), digits: int = 2) -> DataFrame:
    """df with the columns rounded, halves to the even digit."""
    return df.withColumns({c: F.bround(F.col(f"`{c}`").cast("double"), digits) for c in columns if c in df.columns})


def scenario_means(df: DataFrame, scenario: str, columns: list[str]) -> DataFrame:
    """(scenario, n, and each column's mean) by scenario."""
    return df.groupBy(F.col(scenario).alias("scenario")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def write_config(spark: SparkSession, path: str, name: str, settings: dict[str, dict]) -> None:
    """A Python module with one assignment, `name = {data set: settings}`, in whatever file system Spark writes."""
    lines = [f"{name} = {{", *[f"    {k!r}: {{{', '.join(f'{a!r}: {b!r}' for a, b in v.items())}}}," for k, v in settings.items()], "}", ""]
    write_text(spark, path, "\n".join(lines))


def causal_rows(df: DataFrame, keys: list[str], scenario: str = "normal", shock: Column | None = None, seed: int = 0) -> DataFrame:
    """df with Income -> Credit_Score -> Loan_Amount -> Default of a structural model; a recession lowers income and
    raises the chance of a default.

    A row's draws follow from its keys, whatever the partitions, so reruns agree; equal keys have equal draws. shock is
    what a row's income has of its own, in standard deviations: a draw without it, 0 where it is null. Made where rows
    lie: no data moves.
    """
    if scenario not in ("normal", "recession"):
        raise ValueError(f"scenario is normal or recession, not {scenario!r}")
    bad = scenario == "recession"

    def normal(k: int) -> Column:
        return F.sqrt(-2 * F.log(1 - chance(keys, seed + k))) * F.cos(2 * math.pi * chance(keys, seed + k + 1))

    own = normal(0) if shock is None else F.coalesce(shock.cast("double"), F.lit(0.0))
    d = df.withColumn("Income", F.greatest(F.lit(10_000.0), (35_000 if bad else 50_000) + 15_000 * own))
    d = d.withColumn("Credit_Score", F.least(F.lit(850.0), F.greatest(F.lit(300.0), 550 + F.col("Income") / 500 + 40 * normal(2))))
    d = d.withColumn("Loan_Amount", F.greatest(F.lit(1_000.0), 0.3 * F.col("Income") + 20 * F.col("Credit_Score") + 3_000 * normal(4)))
    risk = (1.0 if bad else 0.0) + F.col("Loan_Amount") / F.col("Income") * 4 - F.col("Credit_Score") / 200
    return d.withColumn("Default", (chance(keys, seed + 6) < 1 / (1 + F.exp(-risk))).cast("int"))


def causal_data(spark: SparkSession, n: int, scenario: str = "normal", seed: int = 0) -> DataFrame:
    """n rows of that model, without other columns."""
    return causal_rows(spark.range(n), ["id"], scenario, seed=seed).drop("id")

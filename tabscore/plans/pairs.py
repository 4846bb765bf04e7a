"""Real and synthetic tables made of the driver's tables. Which rows are real is part of a pair's definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.operators.schema import DataSchema

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"]
LI_CONT, LI_CAT = LI[:2], LI[2:]
GEO = ["c_mktsegment", "n_nationkey", "n_name", "n_regionkey"]
FAIR_GROUPS = ["c_mktsegment", "o_orderpriority"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked(lineitem: DataFrame) -> DataFrame:
    return lineitem.withColumn("m", (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 97)


def li(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "lineitem")
    return t.filter("l_orderkey % 2 = 0").select(*LI), t.filter("l_orderkey % 2 = 1").select(*LI)


def li_schema(spark: SparkSession, sf_dir: str) -> DataSchema:
    return DataSchema(li(spark, sf_dir)[0])


def li_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic lines as texts, with defects of each kind."""
    t = marked(table(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 1"))
    text = lambda c: F.col(c).cast("string")
    return t.select(
        F.when(F.col("m").isin(1, 4), "abc").when(F.col("m") != 6, text("l_quantity")).alias("l_quantity"),
        F.when(F.col("m") == 3, (F.col("l_extendedprice") * 1000).cast("string")).otherwise(text("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("m") != 5, text("l_discount")).alias("l_discount"),
        text("l_tax").alias("l_tax"),
        F.when(F.col("m").isin(2, 4), "Z").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
        text("l_linenumber").alias("l_linenumber"),
    )


def geo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    moved = F.when(F.col("c_custkey") % 20 == 1, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey")).cast("int")
    return t.filter("c_custkey % 2 = 0").select(*GEO), t.filter("c_custkey % 2 = 1").withColumn("n_regionkey", moved).select(*GEO)


def eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = marked(table(spark, sf_dir, "lineitem")).withColumn("keep", 1 - F.col("l_discount"))
    x = F.col("l_extendedprice")
    wrong = lambda c, below: F.when(F.col("m") < below, c * 1.01).otherwise(c)
    d = F.col("l_discount")
    return t.select("l_extendedprice", "l_discount", "l_tax", "keep", wrong(x * F.col("keep"), 10).alias("disc_price"), wrong(x + F.col("l_tax"), 7).alias("taxed"), wrong(x - d, 5).alias("less"), F.when(d > 0, wrong(x / F.when(d > 0, d), 3)).alias("per"))


EQUATIONS = [("l_extendedprice", "*", "keep", "disc_price"), ("l_extendedprice", "+", "l_tax", "taxed"), ("l_extendedprice", "-", "l_discount", "less"), ("l_extendedprice", "/", "l_discount", "per")]


def fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a binary label y and a rule's prediction p, a number and its estimate, three classes and a rule's guess."""
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    guess = F.col("o_totalprice") + 3000 * (F.col("c_nationkey") - 12)
    third = F.when(F.col("o_totalprice") + F.col("c_acctbal") * 10 > 300_000, "F").when(F.col("c_nationkey") % 2 == 0, "O").otherwise("P")
    return t.select("o_totalprice", "c_acctbal", "c_nationkey", *FAIR_GROUPS, F.when(F.col("o_totalprice") > 250_000, "1").otherwise("0").alias("y"), F.when(guess > 250_000, "1").otherwise("0").alias("p"), guess.cast("double").alias("estimate"), F.col("o_orderstatus").alias("y3"), third.alias("p3"))


def emb(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return t.filter("id % 2 = 0"), t.filter("id % 2 = 1")


def balances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All suppliers as the real, all customers as the synthetic table of (id, nation, balance)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("nation"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_acctbal").alias("balance"))
    return s, c


#: What stands for runs of models, and for what is said about them: groups of the driver's tables.
MODELS, METRICS = ("alpha", "beta", "delta", "gamma"), ("irr", "mean_ks", "dsi_gap", "utility", "dcr_5th", "delta_eo")
RUNS = """rw AS (SELECT CASE o_custkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'delta' ELSE 'gamma' END AS model, (o_orderkey % 6)::INT AS run,
    avg((o_totalprice > 400000)::INT) AS irr, avg(o_totalprice) / 1000000 AS mean_ks, (max(o_totalprice) - avg(o_totalprice)) / 100000 AS dsi_gap,
    avg((o_totalprice < 300000)::INT) AS utility, min(o_totalprice) / 10000 AS dcr_5th, avg((o_orderstatus = 'F')::INT) AS delta_eo FROM orders GROUP BY ALL),
  runs AS (SELECT model, run, unnest(['irr', 'mean_ks', 'dsi_gap', 'utility', 'dcr_5th', 'delta_eo']) AS metric, unnest([irr, mean_ks, dsi_gap, utility, dcr_5th, delta_eo]) AS value FROM rw)"""
POINTS = "p AS (SELECT c_nationkey::VARCHAR AS model, avg(c_acctbal) AS x, count(*)::DOUBLE AS y FROM customer GROUP BY ALL)"
LEARNERS = "l AS (SELECT o_orderpriority AS model, o_orderstatus AS learner, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority < '4' THEN avg(o_totalprice) / 10000 END AS value FROM orders GROUP BY o_orderpriority, o_orderstatus)"
LOG = "l AS (SELECT o_orderpriority AS model, o_orderstatus AS dataset, o_orderkey::INT AS run, (o_custkey % 50)::INT AS ts, o_orderstatus AS status FROM orders)"
TESTS = "t AS (SELECT n_name AS metric, CASE WHEN n_nationkey % 6 > 0 THEN (n_nationkey * 7 % 25) / 500 END AS p FROM nation)"
INTERVALS = """i AS (SELECT c_mktsegment AS metric, avg(c_acctbal) FILTER (c_custkey % 2 = 0) AS a, avg(c_acctbal) FILTER (c_custkey % 2 = 1) AS b FROM customer GROUP BY ALL)"""
GAPS = """g AS (SELECT o_orderkey % 2 AS side, o_orderpriority AS model, o_orderstatus AS metric, CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 2 = 0 THEN avg(o_totalprice) / 10000 END AS value FROM orders GROUP BY o_orderkey % 2, o_orderpriority, o_orderstatus)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, share = F.col("o_totalprice"), lambda c: F.avg(c.cast("int"))
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("o_custkey") % 4).cast("int"))
    each = (share(x > 400_000), F.avg(x) / 1_000_000, (F.max(x) - F.avg(x)) / 100_000, share(x < 300_000), F.min(x) / 10_000, share(F.col("o_orderstatus") == "F"))
    wide = orders(spark, sf_dir).groupBy(model.alias("model"), (F.col("o_orderkey") % 6).cast("int").alias("run")).agg(*[c.cast("double").alias(m) for c, m in zip(each, METRICS, strict=True)])
    return wide.select("model", "run", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("model")).agg(F.avg("c_acctbal").alias("x"), F.count("*").cast("double").alias("y"))


def learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = (F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") < "4")
    mean = F.avg("o_totalprice") / 10_000
    return orders(spark, sf_dir).groupBy("o_orderpriority", "o_orderstatus").agg(mean.alias("v")).select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("learner"), F.when(known, F.col("v")).alias("value"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").cast("int").alias("run"), (F.col("o_custkey") % 50).cast("int").alias("ts"), F.col("o_orderstatus").alias("status"))


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("metric"), F.when(k % 6 > 0, (k * 7 % 25) / 500).cast("double").alias("p"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda i: F.avg(F.when(F.col("c_custkey") % 2 == i, F.col("c_acctbal")))
    both = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("metric")).agg(side(0).alias("a"), side(1).alias("b"))
    return both.select("metric", (F.col("a") - 40).alias("lo_a"), (F.col("a") + 40).alias("hi_a"), (F.col("b") - 40).alias("lo_b"), (F.col("b") + 40).alias("hi_b"))


def gaps(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    t = orders(spark, sf_dir).filter(F.col("o_orderkey") % 2 == side).groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("metric")).agg((F.avg("o_totalprice") / 10_000).alias("value"))
    return t.withColumn("value", F.when((F.col("metric") != "P") | F.lit(side == 0), F.col("value")))

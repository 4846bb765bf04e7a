"""More registered queries: large vocabularies, sources, sets of columns and labels, strata, intervals by fixed weights."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.functions.stable import scratch
from tabscore.operators import bootstrap, encoders, fairness, logic, neighbors, ordering, sampling, structural, utility
from tabscore.operators.schema import DataSchema
from tabscore.plans import pairs as P
from tabscore.plans.catalog import _ORD as ORDER_COLUMNS
from tabscore.plans.catalog import ORDERS, SYNTH, TAGGED, query, values
from tabscore.sources import files

# A categorical column with thousands of values: order keys. Two thirds of the orders are real; of the synthetic ones,
# which are all orders as texts, every fifth key is spelt with '.0'.

KEYS = """real AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0),
  synth AS (SELECT o_orderkey::VARCHAR || CASE WHEN o_orderkey % 5 = 0 THEN '.0' ELSE '' END AS o_orderkey, o_orderkey AS k, o_orderstatus FROM orders)"""


def keys(s: SparkSession, d: str) -> tuple[DataSchema, DataFrame]:
    t = P.table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    text = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".0").otherwise(""))
    return DataSchema(t.filter("o_orderkey % 3 <> 0"), categorical_columns=["o_orderkey"]), t.withColumn("o_orderkey", text)


@query("large_vocabulary_defects", f"WITH {KEYS} SELECT 'oov_hallucination' AS defect, count(*) AS n FROM synth WHERE k NOT IN (SELECT o_orderkey FROM real)")
def _(s, d):
    schema, synth = keys(s, d)
    return structural.defect_counts(structural.StructuralInterceptor(schema).tagged(synth))


@query("large_vocabulary_values", f"""WITH {KEYS} SELECT 'o_orderkey' AS "column", o_orderkey AS value, count(*) AS n FROM synth WHERE k NOT IN (SELECT o_orderkey FROM real) GROUP BY ALL""")
def _(s, d):
    return structural.unknown_values(*keys(s, d))


@query("large_vocabulary_clean", f"WITH {KEYS} SELECT k AS o_orderkey, o_orderstatus FROM synth WHERE k IN (SELECT o_orderkey FROM real)")
def _(s, d):
    schema, synth = keys(s, d)
    gate = structural.StructuralInterceptor(schema)
    return gate.clean(gate.tagged(synth))


@query(
    "large_vocabulary_codes",
    """WITH v AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey::VARCHAR) - 1 AS code FROM orders WHERE o_orderkey % 3 <> 0)
  SELECT o.o_orderkey, coalesce(v.code, -1)::DOUBLE AS code FROM orders o LEFT JOIN v USING (o_orderkey)""",
)
def _(s, d):
    schema, _ = keys(s, d)
    t = P.table(s, d, "orders").select("o_orderkey")
    return encoders.coded_by(t, schema, "o_orderkey", F.col("o_orderkey").cast("string"), "code")


@query(
    "large_vocabulary_one_hot",
    "SELECT count(*) AS n, (SELECT count(*) + 3 FROM orders WHERE o_orderkey % 3 <> 0)::BIGINT AS width, (count(*) FILTER (o_orderkey % 3 <> 0) + count(*))::BIGINT AS ones FROM orders",
)
def _(s, d):
    schema, _ = keys(s, d)
    encoder = encoders.build_feature_encoder(schema, schema.real_df)
    t = P.table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    hot = encoder.compact(t).select(F.size(F.filter("codes", lambda c: c >= 0)).alias("ones"))
    return hot.agg(F.count("*").alias("n"), F.lit(encoder.width).cast("bigint").alias("width"), F.sum("ones").alias("ones"))


# Sources


@query("csv_round_trip", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def _(s, d):
    t = P.table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    at = f"{scratch(s)}/tabscore-csv-{uuid.uuid4().hex}"
    files.write_csv(t, at, 2)
    return files.read_csv(s, at, t.schema)


@query("csv_as_text", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def _(s, d):
    at = f"{scratch(s)}/tabscore-csv-{uuid.uuid4().hex}"
    files.write_csv(P.table(s, d, "nation").select("n_nationkey", "n_name"), at)
    return files.read_csv(s, files.find_source(s, f"{at}*"), as_text=True)


@query("jsonl_log", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def _(s, d):
    """Two appends, and a line that isn't JSON between them, which reading leaves out."""
    at, t = f"{scratch(s)}/tabscore-log-{uuid.uuid4().hex}", P.table(s, d, "nation")
    files.append_jsonl(t.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name"), at)
    s.createDataFrame([("{broken",)], "value string").write.mode("append").text(at)
    files.append_jsonl(t.filter("n_regionkey = 1").select((F.col("n_nationkey") + 100).cast("bigint").alias("n_nationkey"), "n_name"), at)
    return files.read_jsonl(s, at, "n_nationkey bigint, n_name string")


@query("jsonl_to_csv", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(s, d):
    at, kind = f"{scratch(s)}/tabscore-log-{uuid.uuid4().hex}", "r_regionkey bigint, r_name string"
    files.append_jsonl(P.table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name"), f"{at}/log")
    files.jsonl_to_csv(s, f"{at}/log", f"{at}/csv", kind)
    return files.read_csv(s, f"{at}/csv", kind)


@query("drop_empty", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0")
def _(s, d):
    """An empty column goes, then the rows that are empty, then the column that only one side has."""
    t = P.table(s, d, "orders").withColumn("nothing", F.lit(None).cast("int"))
    some = lambda c: F.when(F.col("o_orderkey") % 4 != 0, F.col(c)).alias(c)
    return files.drop_empty(t.select(some("o_orderkey"), some("o_orderstatus"), some("o_totalprice"), "nothing"), t.select("o_orderkey", "o_orderstatus", "nothing"))[0]


@query("shared_columns", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    t = P.table(s, d, "nation")
    return files.drop_empty(t.select("n_nationkey", "n_name", "n_regionkey"), t.select("n_name", "n_nationkey"))[0]


@query("rounded_coordinates", "SELECT c_custkey, round_even(c_acctbal / 7, 2) AS lat, round_even(c_acctbal / 11, 2) AS lon FROM customer")
def _(s, d):
    t = P.table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 7).alias("lat"), (F.col("c_acctbal") / 11).alias("lon"))
    return files.rounded_coordinates(t)


@query("scenario_means", "SELECT o_orderstatus AS scenario, count(*) AS n, round(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY ALL")
def _(s, d):
    return files.scenario_means(P.table(s, d, "orders"), "o_orderstatus", ["o_totalprice"])


# Sets of columns and labels


@query("column_differences", values([("missing", "l_tax"), ("extra", "other")]).replace("VALUES", "SELECT * FROM (VALUES") + ') AS t(kind, "column")')
def _(s, d):
    return structural.column_differences(P.li_schema(s, d), P.li_raw(s, d).withColumnRenamed("l_tax", "other"))


@query("label_union", "SELECT o_orderstatus AS label, count(*) AS n FROM (SELECT o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderpriority FROM orders) GROUP BY ALL")
def _(s, d):
    t = P.table(s, d, "orders")
    both = t.filter("o_orderkey % 2 = 0").select(F.col("o_orderstatus").alias("label")).union(t.select("o_orderpriority"))
    return both.groupBy("label").agg(F.count("*").alias("n"))


@query("unseen_labels", "SELECT o_orderkey, o_orderpriority AS label FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority < '3')")
def _(s, d):
    t = P.table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return utility.drop_unseen_labels(t.filter("o_orderkey % 2 = 1"), t.filter("o_orderkey % 2 = 0 and label < '3'"))


@query("utility_gap", f"WITH {P.GAPS} SELECT model, metric, round(r.value - s.value, 6)::DOUBLE AS gap FROM (SELECT * FROM g WHERE side = 0) r JOIN (SELECT * FROM g WHERE side = 1) s USING (model, metric)")
def _(s, d):
    return utility.gap_by_model(P.gaps(s, d, 0), P.gaps(s, d, 1))


@query(
    "remaining_orders",
    "SELECT o_orderpriority || '>' || o_orderstatus || '>' || (o_custkey % 7) AS ordering FROM orders EXCEPT SELECT o_orderpriority || '>' || o_orderstatus || '>' || (o_custkey % 7) FROM orders WHERE o_totalprice > 495000",
)
def _(s, d):
    """The sequences of all orders but those that dear ones have."""
    t = P.orders(s, d)
    every = t.select("o_totalprice", F.concat_ws(">", "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 7).cast("string")).alias("ordering"))
    return ordering.remaining_orders(every.select("ordering"), every.filter("o_totalprice > 495000").select("ordering"))


@query("evenly_spaced", f"WITH {ORDERS}, r AS (SELECT ordering, round(ce, 6) AS ce, row_number() OVER (ORDER BY round(ce, 6), ordering) - 1 AS place FROM o) SELECT ordering, ce FROM r WHERE place IN (0, 2, 3, 5)")
def _(s, d):
    """Four of the six orders of three columns, from the one whose conditional entropy is least to the one where it is greatest."""
    scored = sorted((round(float(ce), 6), ">".join(o)) for o, ce, _ in ordering.score_all_permutations(P.geo(s, d)[0], ORDER_COLUMNS))
    return s.createDataFrame(ordering.select_orderings(scored, 4), "ce double, ordering string")


@query(
    "ordering_effect",
    """SELECT count(*) AS n, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 6) AS intercept, round(corr(o_totalprice, o_custkey), 6) AS r FROM orders""",
)
def _(s, d):
    return ordering.ordering_effect(P.table(s, d, "orders"), "o_custkey", "o_totalprice")


# Strata


@query(
    "stratified_subsample",
    """WITH c AS (SELECT *, ('0x' || substr(md5('42|' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0 AS chance, count(*) OVER (PARTITION BY o_orderstatus) AS n, count(*) OVER () AS total FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY chance, o_orderkey) AS place FROM c)
  SELECT o_orderkey, o_orderstatus FROM k WHERE place <= greatest(1, floor(n * 500 / total))""",
)
def _(s, d):
    out = sampling.stratified_subsample(P.table(s, d, "orders"), 500, "o_orderstatus", 42, ["o_orderkey"])
    return out.select("o_orderkey", "o_orderstatus")


@query(
    "uniform_sample",
    "SELECT o_orderkey FROM orders ORDER BY ('0x' || substr(md5('7|' || o_orderkey), 1, 13))::BIGINT, o_orderkey LIMIT 300",
)
def _(s, d):
    return sampling.uniform_sample(P.table(s, d, "orders").select("o_orderkey"), 300, 7, ["o_orderkey"])


@query("fold_without_strata", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 3)::BIGINT AS fold FROM orders")
def _(s, d):
    return sampling.fold_of(P.table(s, d, "orders").select("o_orderkey"), 3, None, ["o_orderkey"]).select("o_orderkey", F.col("fold").cast("bigint").alias("fold"))


# Constraints of a caller's own kind


@query(
    "constraint_rates",
    f"""WITH {SYNTH}, f AS (SELECT l_discount > l_tax AS a, l_extendedprice > l_quantity * 1500 AS b FROM synth)
  SELECT 'at_most(l_discount, l_tax, 1)' AS key, count(*) FILTER (a) AS n_violations, round(count(*) FILTER (a) / count(*), 6) AS value FROM f
  UNION ALL SELECT 'at_most(l_extendedprice, l_quantity, 1500)', count(*) FILTER (b), round(count(*) FILTER (b) / count(*), 6) FROM f
  UNION ALL SELECT 'overall', count(*) FILTER (a OR b), round(count(*) FILTER (a OR b) / count(*), 6) FROM f""",
)
def _(s, d):
    logic.register_constraint("at_most", lambda real, a, b, times: F.col(a) > F.col(b) * times)
    return logic.constraint_rates(*P.li(s, d), [("at_most", "l_discount", "l_tax", 1), ("at_most", "l_extendedprice", "l_quantity", 1500)])


# Intervals by weights that SQL can repeat


@query(
    "disparity_intervals",
    """WITH f AS (SELECT o.o_orderpriority AS g, CASE WHEN o_totalprice > 250000 THEN '1' ELSE '0' END AS y, CASE WHEN o_totalprice + 3000 * (c_nationkey - 12) > 250000 THEN '1' ELSE '0' END AS p
    FROM orders o JOIN customer c ON o_custkey = c_custkey),
  w AS (SELECT b AS replicate, g, y, p, n * (1 + (b * 7 + ascii(g) + 3 * ascii(y) + 5 * ascii(p)) % 4) AS n FROM (SELECT g, y, p, count(*) AS n FROM f GROUP BY ALL), range(8) t(b)),
  r AS (SELECT replicate, g, sum(n) FILTER (p = '1') / sum(n) AS positive, sum(n) FILTER (p = '1' AND y = '1') / sum(n) FILTER (y = '1') AS tpr, coalesce(sum(n) FILTER (p = '1' AND y = '0'), 0) / sum(n) FILTER (y = '0') AS fpr
    FROM w GROUP BY ALL),
  v AS (SELECT replicate, max(positive) - min(positive) AS dp, max(tpr) - min(tpr) AS eop, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo FROM r GROUP BY replicate)
  SELECT metric, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi
  FROM (SELECT 'delta_dp' AS metric, dp::DOUBLE AS value FROM v UNION ALL SELECT 'delta_eop', eop FROM v UNION ALL SELECT 'delta_eo', eo FROM v) GROUP BY metric""",
)
def _(s, d):
    cell = fairness.cells(P.fair(s, d), "o_orderpriority", "y", "p")
    weight = 1 + (F.col("replicate") * 7 + F.ascii("g") + 3 * F.ascii("y") + 5 * F.ascii("p")) % 4
    replicates = cell.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("n", F.col("n") * weight)
    return fairness.disparity_intervals(replicates, ["1"])


@query(
    "nearest_mixed",
    """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS c, s_acctbal AS v FROM supplier), b AS (SELECT min(v) AS lo, max(v) - min(v) AS w FROM s),
  r AS (SELECT DISTINCT c, (v - lo) / w AS v FROM s, b), q AS (SELECT c_custkey AS id, c_nationkey AS c, (c_acctbal - lo) / w AS v FROM customer, b)
  SELECT q.id, round(min(abs(q.v - r.v) + CASE WHEN q.c = r.c THEN 0 ELSE 1 END), 6)::DOUBLE AS dcr FROM q CROSS JOIN r GROUP BY q.id""",
)
def _(s, d):
    """The pruned search, whatever the size of the tables."""
    real, synth = P.balances(s, d)
    schema = DataSchema(real.select("nation", "balance"), ["nation"], ["balance"])
    return neighbors.dcr_rows(real, synth, schema, "id", "arrow")


@query(
    "dcr_lines",
    """WITH r0 AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0),
  b AS (SELECT min(l_quantity) AS ql, max(l_quantity) - min(l_quantity) AS qw, min(l_extendedprice) AS el, max(l_extendedprice) - min(l_extendedprice) AS ew FROM r0),
  r AS (SELECT DISTINCT (l_quantity - ql) / qw AS q, (l_extendedprice - el) / ew AS e, l_discount AS a, l_tax AS t, l_returnflag AS f, l_linestatus AS s, l_linenumber AS n FROM r0, b),
  x AS (SELECT row_number() OVER () AS id, (l_quantity - ql) / qw AS q, (l_extendedprice - el) / ew AS e, l_discount AS a, l_tax AS t, l_returnflag AS f, l_linestatus AS s, l_linenumber AS n FROM lineitem, b WHERE l_orderkey % 2 = 1),
  d AS (SELECT min(abs(x.q - r.q) + abs(x.e - r.e) + (x.a <> r.a)::INT + (x.t <> r.t)::INT + (x.f <> r.f)::INT + (x.s <> r.s)::INT + (x.n <> r.n)::INT) AS dcr FROM x, r GROUP BY x.id)
  SELECT count(*) AS n, round(quantile_cont(dcr, 0.05), 6)::DOUBLE AS dcr_5th, round(quantile_cont(dcr, 0.95), 6)::DOUBLE AS dcr_95th FROM d""",
)
def _(s, d):
    """Two numbers and five categories, all rows of both sides: the library's main pair."""
    real, synth = P.li(s, d)
    return neighbors.dcr_percentiles(neighbors.dcr_counts(real, synth, DataSchema(real)))


# Dependencies of several columns, the best order of columns

_FD = ["o_custkey", "c_nationkey", "c_mktsegment", "market", "o_orderpriority"]
_FD_ROWS = "t AS (SELECT o_custkey, c_nationkey, c_mktsegment, c_nationkey || '/' || c_mktsegment AS market, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)"


def _fd_sql() -> str:
    sets = [c for k in (1, 2, 3, 4) for c in combinations(_FD, k)]
    counts = ", ".join(f"count(DISTINCT ({', '.join(c)})) AS n_{'_'.join(str(_FD.index(x)) for x in c)}" for c in sets)
    name = lambda c: "n_" + "_".join(str(_FD.index(x)) for x in sorted(c, key=_FD.index))
    holds = lambda s, d: f"{name(s)} = {name((*s, d))}"
    rows = []
    for k in (1, 2, 3):
        for s in combinations(_FD, k):
            for d in _FD:
                if d not in s:
                    smaller = " OR ".join(holds(x, d) for j in range(1, k) for x in combinations(s, j)) or "false"
                    rows.append(f"SELECT '{'+'.join(s)}' AS determinants, '{d}' AS dependent FROM n WHERE {holds(s, d)} AND NOT ({smaller})")
    return f"WITH {_FD_ROWS}, n AS (SELECT {counts} FROM t) " + " UNION ALL ".join(rows)


@query("composite_fds", _fd_sql())
def _(s, d):
    t = P.orders(s, d).join(P.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.withColumn("market", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    return s.createDataFrame([("+".join(x), y) for x, y in logic.composite_fds(t, _FD)], "determinants string, dependent string")


_BEST = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_discount"]
_BEST_CELLS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, -sum(n / t * log2(n / t)) AS h FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY {a}, {b})" for a, b in [*((c, c) for c in _BEST), *combinations(_BEST, 2)]
)


@query(
    "best_column_order",
    f"""WITH RECURSIVE e AS ({_BEST_CELLS}), h AS (SELECT a, b, h FROM e UNION ALL SELECT b, a, h FROM e WHERE a <> b),
  p AS (SELECT [a] AS path, a AS last, h AS ce FROM e WHERE a = b
    UNION ALL SELECT list_append(path, h.b), h.b, ce + h.h - e.h FROM p JOIN h ON h.a = p.last AND h.b <> h.a AND NOT list_contains(path, h.b) JOIN e ON e.a = p.last AND e.b = p.last)
  SELECT {len(_BEST)}::BIGINT AS n, round(min(ce), 6)::DOUBLE AS ce FROM p WHERE len(path) = {len(_BEST)}""",
)
def _(s, d):
    order, ce = ordering.best_order(P.li(s, d)[0], _BEST)
    return s.createDataFrame([(len(set(order)), float(ce))], "n bigint, ce double")


# Statistics of tables with their intervals; results in any file system

@query(
    "table_bootstrap",
    """SELECT 'mean' AS statistic, round(avg(o_totalprice), 6) AS value, true AS inside FROM orders UNION ALL SELECT 'median', round(quantile_cont(o_totalprice, 0.5), 6), true FROM orders
  UNION ALL SELECT 'correlation', round(corr(o_totalprice, o_custkey), 6), true FROM orders""",
)
def _(s, d):
    """The intervals are random; that they hold the value isn't, with 100 replicates."""
    x, rows = F.col("o_totalprice"), []
    for name, statistic in (("mean", bootstrap.mean_of(x)), ("median", bootstrap.median_of(x)), ("correlation", bootstrap.correlation_of(x, F.col("o_custkey")))):
        value, lo, hi = bootstrap.table_bootstrap(P.orders(s, d), statistic, [F.col("o_orderkey")], 100)
        rows.append((name, value, lo < value < hi))
    return s.createDataFrame(rows, "statistic string, value double, inside boolean")


@query("bundle_scores", f"WITH {TAGGED} SELECT 'raw' AS model, 'lineitem' AS dataset, 'irr' AS metric, round(count(defect) / count(*), 6) AS value FROM tagged")
def _(s, d):
    """A run's bundle, written to the shared folder and read back as a table."""
    from tabscore.plans.bundle import read_bundles
    from tabscore.plans.pipeline import BenchmarkPipeline, PipelineConfig

    at = f"{scratch(s)}/bundles-{uuid.uuid4().hex}"
    BenchmarkPipeline(PipelineConfig(P.li(s, d)[0], dimensions=(0,), model="raw", dataset="lineitem")).run(P.li_raw(s, d)).save(f"{at}/raw.json")
    return read_bundles(s, f"{at}/*.json").filter("value is not null").select("model", "dataset", "metric", "value")


@query("csv_inferred", "SELECT 'int' AS key_type, 'double' AS price_type, 'string' AS status_type, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS price FROM orders")
def _(s, d):
    at = f"{scratch(s)}/inferred-{uuid.uuid4().hex}"
    files.write_csv(P.orders(s, d).select("o_orderkey", "o_totalprice", "o_orderstatus"), at)
    t = files.read_csv(s, at)
    kinds = [F.lit(t.schema[c].dataType.simpleString()).alias(k) for c, k in (("o_orderkey", "key_type"), ("o_totalprice", "price_type"), ("o_orderstatus", "status_type"))]
    return t.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("price")).select(*kinds, "n", "keys", "price")

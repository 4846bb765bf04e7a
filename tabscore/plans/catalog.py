"""The registered queries of the scoring operators, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscore.operators import bootstrap, encoders, fairness, fidelity, leaderboard, logic, neighbors, ordering, profile, sampling, serialize, significance, structural, utility
from tabscore.operators.schema import DataSchema, schema_fingerprint
from tabscore.operators.specs import FairSpec, LogicSpec, TaskType
from tabscore.plans import pairs as P
from tabscore.sources import files
from tabscore.streaming import drift

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


M = "(l_orderkey * 31 + l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 97"
COLS = ", ".join(P.LI)
REAL = f"real AS (SELECT {COLS} FROM lineitem WHERE l_orderkey % 2 = 0)"
SYNTH = f"synth AS (SELECT {COLS} FROM lineitem WHERE l_orderkey % 2 = 1)"
RAW = f"""raw0 AS (SELECT *, {M} AS m FROM lineitem WHERE l_orderkey % 2 = 1),
  raw AS (SELECT CASE WHEN m IN (1, 4) THEN 'abc' WHEN m <> 6 THEN l_quantity::VARCHAR END AS l_quantity, CASE WHEN m = 3 THEN (l_extendedprice * 1000)::VARCHAR ELSE l_extendedprice::VARCHAR END AS l_extendedprice,
  CASE WHEN m <> 5 THEN l_discount::VARCHAR END AS l_discount, l_tax::VARCHAR AS l_tax, CASE WHEN m IN (2, 4) THEN 'Z' ELSE l_returnflag END AS l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber FROM raw0)"""
_number = lambda c: f"WHEN {c} IS NOT NULL AND try_cast({c} AS DOUBLE) IS NULL THEN 'type_coercion_nan' WHEN try_cast({c} AS DOUBLE) < (SELECT min({c}) FROM real) OR try_cast({c} AS DOUBLE) > (SELECT max({c}) FROM real) THEN 'out_of_bounds'"
_word = lambda c: f"WHEN {c} IS NULL OR {c} NOT IN (SELECT {c}::VARCHAR FROM real) THEN 'oov_hallucination'"
TAGGED = f"{REAL}, {RAW}, tagged AS (SELECT *, CASE {' '.join(map(_number, P.LI_CONT))} {' '.join(map(_word, P.LI_CAT))} END AS defect FROM raw)"
long_sql = lambda t, cols, side: " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::{'DOUBLE' if c in P.LI_CONT else 'VARCHAR'} AS v, {side} AS side FROM {t} WHERE {c} IS NOT NULL" for c in cols)


def tagged(s: SparkSession, d: str) -> DataFrame:
    return structural.StructuralInterceptor(P.li_schema(s, d)).tagged(P.li_raw(s, d))


# Schema and structure


@query("schema_infer", f"WITH {REAL} " + " UNION ALL ".join(f"SELECT {i}::INT AS position, '{c}' AS name, '{'continuous' if c in P.LI_CONT else 'categorical'}' AS col_type, " + (f"round(min({c}), 6)::DOUBLE AS min_val, round(max({c}), 6)::DOUBLE AS max_val, NULL::INT AS n_categories" if c in P.LI_CONT else f"NULL::DOUBLE AS min_val, NULL::DOUBLE AS max_val, count(DISTINCT {c})::INT AS n_categories") + " FROM real" for i, c in enumerate(P.LI)))
def _(s, d):
    return P.li_schema(s, d).table()


@query("schema_fingerprint", "SELECT md5('" + "|".join(sorted(f"{c}:{'continuous' if c in P.LI_CONT else 'categorical'}" for c in P.LI)) + "') AS fingerprint")
def _(s, d):
    return s.createDataFrame([(schema_fingerprint(P.li_schema(s, d)),)], "fingerprint string")


@query("dim0_defects", f"WITH {TAGGED} SELECT defect, count(*) AS n FROM tagged WHERE defect IS NOT NULL GROUP BY defect")
def _(s, d):
    return structural.defect_counts(tagged(s, d))


@query("dim0_irr", f"WITH {TAGGED} SELECT count(*) AS n_total, count(defect) AS n_invalid, round(count(defect) / count(*), 6) AS irr FROM tagged")
def _(s, d):
    return structural.invalid_row_rate(tagged(s, d))


@query("dim0_clean_rows", f"WITH {TAGGED} SELECT l_quantity::DOUBLE AS l_quantity, round(l_extendedprice::DOUBLE, 6) AS l_extendedprice, round(l_discount::DOUBLE, 6) AS l_discount, round(l_tax::DOUBLE, 6) AS l_tax, l_returnflag, l_linestatus, l_linenumber::INT AS l_linenumber FROM tagged WHERE defect IS NULL")
def _(s, d):
    gate = structural.StructuralInterceptor(P.li_schema(s, d))
    return gate.clean(gate.tagged(P.li_raw(s, d)))


@query("dim0_oov_values", f"WITH {REAL}, {RAW} SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS n FROM raw WHERE l_returnflag = 'Z' GROUP BY ALL UNION ALL SELECT 'l_discount', 'nan', count(*) FROM raw WHERE l_discount IS NULL")
def _(s, d):
    return structural.unknown_values(P.li_schema(s, d), P.li_raw(s, d))


@query("align_columns", f"WITH {SYNTH} SELECT NULL::DOUBLE AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax, l_returnflag, l_linestatus, l_linenumber FROM synth")
def _(s, d):
    real, synth = P.li(s, d)
    return files.align_columns(files.drop_time_index(synth.drop("l_quantity").withColumn("t", F.lit(1))), real)


@query("configured_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(s, d):
    return files.configured_columns(P.table(s, d, "orders"), ["o_orderkey"], ["o_totalprice", "o_orderdate", "o_orderpriority"])


@query("complete_cases", f"WITH {RAW} SELECT count(*) AS n FROM raw WHERE try_cast(l_quantity AS DOUBLE) IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL")
def _(s, d):
    raw = P.li_raw(s, d)
    return raw.withColumn("l_quantity", profile.as_number(raw, "l_quantity")).dropna(subset=["l_quantity", "l_extendedprice", "l_discount"]).agg(F.count("*").alias("n"))


# Fidelity

_ks = f"WITH {REAL}, {SYNTH}, x AS ({long_sql('real', P.LI_CONT, 1)} UNION ALL {long_sql('synth', P.LI_CONT, 0)}), c AS (SELECT \"column\", v, sum(side) AS r, sum(1 - side) AS s FROM x GROUP BY ALL), f AS (SELECT \"column\", sum(r) OVER w AS fr, sum(s) OVER w AS fs, sum(r) OVER p AS nr, sum(s) OVER p AS ns FROM c WINDOW w AS (PARTITION BY \"column\" ORDER BY v), p AS (PARTITION BY \"column\")), k AS (SELECT \"column\", max(abs(fr / nr - fs / ns)) AS ks, max(nr)::BIGINT AS n_real, max(ns)::BIGINT AS n_synth FROM f GROUP BY ALL)"
_tvd = f"x2 AS ({long_sql('real', P.LI_CAT, 1)} UNION ALL {long_sql('synth', P.LI_CAT, 0)}), c2 AS (SELECT \"column\", v, sum(side) AS r, sum(1 - side) AS s FROM x2 GROUP BY ALL), t2 AS (SELECT *, sum(r) OVER (PARTITION BY \"column\") AS nr, sum(s) OVER (PARTITION BY \"column\") AS ns FROM c2), k2 AS (SELECT \"column\", sum(abs(r / nr - s / ns)) / 2 AS tvd FROM t2 GROUP BY ALL)"


@query("ks_per_column", f"{_ks} SELECT \"column\", round(ks, 6) AS ks, n_real, n_synth FROM k")
def _(s, d):
    return fidelity.ks_per_column(*P.li(s, d), P.LI_CONT)


@query("tvd_per_column", f"WITH {REAL}, {SYNTH}, {_tvd} SELECT \"column\", round(tvd, 6) AS tvd FROM k2")
def _(s, d):
    return fidelity.tvd_per_column(*P.li(s, d), P.LI_CAT)


@query("marginal_means", f"{_ks}, {_tvd} SELECT 'ks' AS metric, round(avg(ks), 6) AS value FROM k UNION ALL SELECT 'tvd', round(avg(tvd), 6) FROM k2")
def _(s, d):
    real, synth = P.li(s, d)
    return fidelity.FidelityEvaluator(real, DataSchema(real)).marginals(synth).groupBy("metric").agg(F.avg("value").alias("value"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_pairs = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]
_corr = lambda t: " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {t}" for a, b in _pairs)


@query("pearson_pairs", f"WITH {REAL} SELECT a, b, round(r, 6) AS r FROM ({_corr('real')})")
def _(s, d):
    return fidelity.pearson_pairs(P.li(s, d)[0], _NUM)


@query("pearson_matrix_error", f"WITH {REAL}, {SYNTH} SELECT round(avg(abs(x.r - y.r)), 6) AS error FROM ({_corr('real')}) x JOIN ({_corr('synth')}) y USING (a, b)")
def _(s, d):
    real, synth = P.li(s, d)
    return fidelity.matrix_error(fidelity.pearson_pairs(real, _NUM), fidelity.pearson_pairs(synth, _NUM), "r")


#: A 2 x 2 table among them, for Yates' correction.
_CAT = ["l_returnflag", "l_linestatus", "l_linenumber", "two"]
_cat_pairs = [(a, b) for i, a in enumerate(_CAT) for b in _CAT[i + 1 :]]


def _two(df: DataFrame) -> DataFrame:
    return df.withColumn("two", F.when(F.col("l_quantity") > 25, "hi").otherwise("lo"))


def _cramer(t: str, name: str) -> str:
    cells = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::VARCHAR AS x, {b}::VARCHAR AS y FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS two FROM {t})" for a, b in _cat_pairs)
    return f"""{name}c AS (SELECT a, b, x, y, count(*) AS o FROM ({cells}) GROUP BY ALL), {name}x AS (SELECT a, b, x, sum(o) AS nx FROM {name}c GROUP BY ALL), {name}y AS (SELECT a, b, y, sum(o) AS ny FROM {name}c GROUP BY ALL),
    {name}g AS (SELECT {name}x.a, {name}x.b, nx * ny / sum(nx * ny) OVER (PARTITION BY {name}x.a, {name}x.b) * sqrt(sum(nx * ny) OVER (PARTITION BY {name}x.a, {name}x.b)) AS e, coalesce(o, 0) AS o FROM {name}x JOIN {name}y USING (a, b) LEFT JOIN {name}c USING (a, b, x, y)),
    {name}s AS (SELECT a, b, sum(o) AS n, (SELECT count(*) FROM {name}x q WHERE q.a = g.a AND q.b = g.b) AS r, (SELECT count(*) FROM {name}y q WHERE q.a = g.a AND q.b = g.b) AS k, sum((o - e) ** 2 / e) AS plain, sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) AS yates FROM {name}g g GROUP BY a, b),
    {name} AS (SELECT a, b, CASE WHEN r < 2 OR k < 2 THEN 0 ELSE sqrt(greatest(0, CASE WHEN r = 2 AND k = 2 THEN yates ELSE plain END / n - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1)) END AS v FROM {name}s)"""


@query("cramers_v_pairs", f"WITH {REAL}, {_cramer('real', 'cr')} SELECT a, b, round(v, 6)::DOUBLE AS v FROM cr")
def _(s, d):
    return fidelity.cramers_v_pairs(_two(P.li(s, d)[0]), _CAT)


@query("cramerv_matrix_error", f"WITH {REAL}, {SYNTH}, {_cramer('real', 'cr')}, {_cramer('synth', 'cs')} SELECT round(avg(abs(cr.v - cs.v)), 6)::DOUBLE AS error FROM cr JOIN cs USING (a, b)")
def _(s, d):
    real, synth = P.li(s, d)
    return fidelity.matrix_error(fidelity.cramers_v_pairs(_two(real), _CAT), fidelity.cramers_v_pairs(_two(synth), _CAT), "v")


# Neighbours and privacy

_EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), er AS (SELECT * FROM e WHERE id % 2 = 0), es AS (SELECT * FROM e WHERE id % 2 = 1)"
_RADII = "rr AS (SELECT id, d AS radius FROM (SELECT a.id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS k FROM er a JOIN er b ON a.id <> b.id) WHERE k = 5)"


@query("knn_radius", f"WITH {_EMB}, {_RADII} SELECT id, round(radius, 6) AS radius FROM rr")
def _(s, d):
    return neighbors.knn_radius(P.emb(s, d)[0])


@query("alpha_precision", f"WITH {_EMB}, {_RADII}, n AS (SELECT a.id, arg_min(b.id, (list_distance(a.x, b.x), b.id)) AS near, min(list_distance(a.x, b.x)) AS d FROM es a, er b GROUP BY a.id) SELECT count(*) AS n, round(avg((d <= radius)::INT), 6) AS value FROM n JOIN rr ON rr.id = near")
def _(s, d):
    real, synth = P.emb(s, d)
    return neighbors.alpha_precision(real, synth, neighbors.knn_radius(real))


@query("beta_recall", f"WITH {_EMB}, {_RADII}, n AS (SELECT a.id, min(list_distance(a.x, b.x)) AS d FROM er a, es b GROUP BY a.id) SELECT count(*) AS n, round(avg((d <= radius)::INT), 6) AS value FROM n JOIN rr USING (id)")
def _(s, d):
    real, synth = P.emb(s, d)
    return neighbors.beta_recall(real, synth, neighbors.knn_radius(real))


_DCR = "b AS (SELECT least(0, min(s_acctbal)) * 0 + min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), q AS (SELECT c_custkey AS id, min(abs((c_acctbal - lo) / (hi - lo) - (s_acctbal - lo) / (hi - lo)) + (c_nationkey <> s_nationkey)::INT) AS dcr FROM customer, supplier, b GROUP BY c_custkey)"


def _dcr(s, d):
    real, synth = P.balances(s, d)
    return neighbors.dcr_rows(real, synth, DataSchema(real.select("nation", "balance"), categorical_columns=["nation"], continuous_columns=["balance"]))


@query("dcr_rows", f"WITH {_DCR} SELECT id, round(dcr, 6) AS dcr FROM q")
def _(s, d):
    return _dcr(s, d)


@query("dcr_percentiles", f"WITH {_DCR} SELECT count(*) AS n, round(quantile_cont(dcr, 0.05), 6) AS dcr_5th, round(quantile_cont(dcr, 0.95), 6) AS dcr_95th FROM q")
def _(s, d):
    return neighbors.dcr_percentiles(_dcr(s, d))


@query("exact_match_rate", f"WITH {_DCR} SELECT count(*) AS n, round(avg((dcr < 1e-5)::INT), 6) AS value FROM q")
def _(s, d):
    return neighbors.exact_match_rate(_dcr(s, d))


_COPY = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"]


@query("copy_ratio", f"WITH {REAL}, {SYNTH}, r AS (SELECT DISTINCT {', '.join(_COPY)}, 1 AS hit FROM real) SELECT count(*) AS n, count(hit) AS n_copies, round(count(hit) / count(*), 6) AS value FROM synth LEFT JOIN r USING ({', '.join(_COPY)})")
def _(s, d):
    return neighbors.copy_ratio(*P.li(s, d), _COPY)


# Encoders

_MOM = "avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp, min(l_quantity) AS q0, max(l_quantity) AS q1"


@query("encode_standardize", f"WITH {REAL}, {SYNTH}, k AS (SELECT {_MOM} FROM real) SELECT round((l_quantity - mq) / sq, 6) AS q, round((l_extendedprice - mp) / sp, 6) AS p FROM synth, k")
def _(s, d):
    real, synth = P.li(s, d)
    m = encoders.moments(real, P.LI_CONT)
    return synth.select(encoders.standardised(F.col("l_quantity"), m["l_quantity"]).alias("q"), encoders.standardised(F.col("l_extendedprice"), m["l_extendedprice"]).alias("p"))


@query("encode_minmax", f"WITH {REAL}, {SYNTH}, k AS (SELECT {_MOM} FROM real) SELECT round((l_quantity - q0) / (q1 - q0), 6) AS q FROM synth, k")
def _(s, d):
    real, synth = P.li(s, d)
    return synth.select(encoders.min_max(F.col("l_quantity"), encoders.zero_filled_bounds(real, ["l_quantity"])["l_quantity"]).alias("q"))


@query("encode_onehot", f"WITH {RAW} SELECT (l_returnflag = 'A')::INT::DOUBLE AS a, (l_returnflag = 'N')::INT::DOUBLE AS n, (l_returnflag = 'R')::INT::DOUBLE AS r FROM raw")
def _(s, d):
    words = sorted(P.li_schema(s, d)["l_returnflag"].categories)
    return P.li_raw(s, d).select(*[c.alias(w.lower()) for c, w in zip(encoders.one_hot(F.col("l_returnflag"), words), words, strict=True)])


@query("encode_ordinal", f"WITH {RAW} SELECT CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 WHEN 'R' THEN 2.0 ELSE -1.0 END::DOUBLE AS code, count(*) AS n FROM raw GROUP BY ALL")
def _(s, d):
    words = sorted(P.li_schema(s, d)["l_returnflag"].categories)
    return P.li_raw(s, d).groupBy(encoders.ordinal(F.col("l_returnflag"), words).alias("code")).agg(F.count("*").alias("n"))


@query("impute_median_mode", f"WITH {REAL}, {RAW}, k AS (SELECT quantile_cont(l_quantity, 0.5) AS med FROM real), f AS (SELECT l_discount::VARCHAR AS dm FROM real GROUP BY l_discount ORDER BY count(*) DESC, l_discount::VARCHAR LIMIT 1) SELECT round(coalesce(try_cast(l_quantity AS DOUBLE), med), 6) AS q, CASE WHEN coalesce(l_discount, dm) = '0.0' THEN '0' ELSE coalesce(l_discount, dm) END AS d FROM raw, k, f")
def _(s, d):
    real, raw = P.li(s, d)[0], P.li_raw(s, d)
    median = encoders.moments(real, ["l_quantity"])["l_quantity"]["median"]
    mode = encoders.most_frequent(real, ["l_discount"])["l_discount"]
    x = F.coalesce("l_discount", F.lit(mode))
    return raw.select(F.coalesce(profile.as_number(raw, "l_quantity"), F.lit(median)).alias("q"), F.when(x == "0.0", "0").otherwise(x).alias("d"))


# Logic

_GEO0 = "g0 AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)"
GEO = f"{_GEO0}, real AS (SELECT c_mktsegment, n_nationkey, n_name, n_regionkey FROM g0 WHERE c_custkey % 2 = 0), synth AS (SELECT c_mktsegment, n_nationkey, n_name, CASE WHEN c_custkey % 20 = 1 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS n_regionkey FROM g0 WHERE c_custkey % 2 = 1)"
FDS = [("n_nationkey", "n_regionkey"), ("n_name", "n_nationkey"), ("n_regionkey", "c_mktsegment")]
_map = lambda det, dep: f"(SELECT det, dep FROM (SELECT {det}::VARCHAR AS det, {dep}::VARCHAR AS dep, row_number() OVER (PARTITION BY {det} ORDER BY count(*) DESC, {dep}::VARCHAR) AS k FROM real GROUP BY {det}, {dep}) WHERE k = 1)"
_flag = ", ".join(f"coalesce(m{i}.dep <> synth.{dep}::VARCHAR, false) AS f{i}" for i, (_det, dep) in enumerate(FDS))
_join = " ".join(f"LEFT JOIN {_map(*fd)} m{i} ON m{i}.det = synth.{fd[0]}::VARCHAR" for i, fd in enumerate(FDS))
_ICVR = f"WITH {GEO}, v AS (SELECT {_flag} FROM synth {_join}) "
_rate = lambda key, c: f"SELECT '{key}' AS key, count(*) FILTER ({c}) AS n_violations, round(count(*) FILTER ({c}) / count(*), 6) AS value FROM v"
_per_fd = " UNION ALL ".join(_rate(f"{a}->{b}", f"f{i}") for i, (a, b) in enumerate(FDS))


def _icvr(s, d):
    return logic.flag_rates(logic.fd_flags(*P.geo(s, d), FDS), "fd", [f"{a}->{b}" for a, b in FDS])


@query("icvr_per_fd", _ICVR + _per_fd)
def _(s, d):
    return _icvr(s, d).filter("key != 'overall'")


@query("icvr_overall", _ICVR + _rate("overall", " OR ".join(f"f{i}" for i in range(len(FDS)))))
def _(s, d):
    return _icvr(s, d).filter("key = 'overall'")


@query("fd_mode_mapping", f"WITH {GEO} SELECT det, dep FROM {_map('n_regionkey', 'c_mktsegment')}")
def _(s, d):
    return logic.fd_mapping(P.geo(s, d)[0], "n_regionkey", "c_mktsegment")


@query("fd_real_softness", f"WITH {GEO}, k AS (SELECT n_regionkey, count(DISTINCT c_mktsegment) AS k FROM real GROUP BY ALL) SELECT count(*) AS n_det, count(*) FILTER (k > 1) AS n_soft, round(count(*) FILTER (k > 1) / count(*), 6) AS softness FROM k")
def _(s, d):
    return logic.fd_softness(P.geo(s, d)[0], "n_regionkey", "c_mktsegment")


_HCS = f"WITH {GEO}, e AS (SELECT DISTINCT n_regionkey AS u, n_name AS w, 1 AS hit FROM real), e2 AS (SELECT DISTINCT n_name AS u, n_nationkey AS w, 1 AS hit FROM real), v AS (SELECT e.hit IS NULL OR e2.hit IS NULL AS f0 FROM synth LEFT JOIN e ON e.u = n_regionkey AND e.w = n_name LEFT JOIN e2 ON e2.u = n_name AND e2.w = n_nationkey) "
CHAINS = [["n_regionkey", "n_name", "n_nationkey"]]


@query("hcs_per_chain", _HCS + _rate("n_regionkey->n_name->n_nationkey", "f0"))
def _(s, d):
    return logic.flag_rates(logic.hierarchy_flags(*P.geo(s, d), CHAINS), "chain", ["->".join(c) for c in CHAINS]).filter("key != 'overall'")


@query("hcs_overall", _HCS + _rate("overall", "f0"))
def _(s, d):
    return logic.flag_rates(logic.hierarchy_flags(*P.geo(s, d), CHAINS), "chain", ["->".join(c) for c in CHAINS]).filter("key = 'overall'")


_EQ = f"""t AS (SELECT *, {M} AS m, 1 - l_discount AS keep FROM lineitem), z AS (SELECT l_extendedprice AS x, l_discount AS d, l_tax AS t, keep, CASE WHEN m < 10 THEN x0 * 1.01 ELSE x0 END AS disc_price, CASE WHEN m < 7 THEN x1 * 1.01 ELSE x1 END AS taxed, CASE WHEN m < 5 THEN x2 * 1.01 ELSE x2 END AS less, CASE WHEN m < 3 THEN x3 * 1.01 ELSE x3 END AS per
  FROM (SELECT *, l_extendedprice * keep AS x0, l_extendedprice + l_tax AS x1, l_extendedprice - l_discount AS x2, CASE WHEN l_discount > 0 THEN l_extendedprice / l_discount END AS x3 FROM t)),
  e AS (SELECT abs(x * keep - disc_price) / (abs(disc_price) + 1e-9) AS e0, abs(x + t - taxed) / (abs(taxed) + 1e-9) AS e1, abs(x - d - less) / (abs(less) + 1e-9) AS e2, CASE WHEN abs(d) >= 1e-9 THEN abs(x / d - per) / (abs(per) + 1e-9) END AS e3 FROM z),
  q AS ({" UNION ALL ".join(f"SELECT '{a} {o} {b} = {c}' AS key, count(e{i}) AS n_valid, count(*) FILTER (e{i} > 1e-3) / count(e{i}) AS value FROM e" for i, (a, o, b, c) in enumerate(P.EQUATIONS))})"""


@query("mdi_per_equation", f"WITH {_EQ} SELECT key, n_valid, round(value, 6) AS value FROM q")
def _(s, d):
    return logic.mdi_per_equation(P.eq(s, d), P.EQUATIONS)


@query("mdi_mean", f"WITH {_EQ} SELECT round(avg(value), 6) AS value FROM q")
def _(s, d):
    return logic.mdi_per_equation(P.eq(s, d), P.EQUATIONS).agg(F.avg("value").alias("value"))


_fd_pairs = [(a, b) for a in P.GEO for b in P.GEO if a != b]


@query("fd_scan", f"WITH {GEO}, h AS (" + " UNION ALL ".join(f"SELECT '{a}' AS det, '{b}' AS dep, max(k) AS k, count(*) AS n FROM (SELECT {a}, count(DISTINCT {b}) AS k FROM real GROUP BY {a})" for a, b in _fd_pairs) + ") SELECT det, dep FROM h WHERE k = 1 AND n BETWEEN 2 AND 1000")
def _(s, d):
    return logic.fd_scan(P.geo(s, d)[0], P.GEO)


@query("fd_violation_rate", f"WITH {GEO}, k AS (SELECT n_nationkey, count(*) AS n, count(DISTINCT n_regionkey) AS k FROM synth GROUP BY ALL HAVING count(*) >= 10) SELECT count(*) AS n_groups, count(*) FILTER (k > 1) AS n_violating, round(count(*) FILTER (k > 1) / nullif(count(*), 0), 6) AS value FROM k")
def _(s, d):
    return logic.fd_violation_rate(P.geo(s, d)[1], "n_nationkey", "n_regionkey")


# Fairness and scores

FAIR = """fair AS (SELECT o_totalprice, c_acctbal, c_nationkey, c_mktsegment, o_orderpriority, CASE WHEN o_totalprice > 250000 THEN '1' ELSE '0' END AS y, CASE WHEN o_totalprice + 3000 * (c_nationkey - 12) > 250000 THEN '1' ELSE '0' END AS p, (o_totalprice + 3000 * (c_nationkey - 12))::DOUBLE AS estimate,
  o_orderstatus AS y3, CASE WHEN o_totalprice + c_acctbal * 10 > 300000 THEN 'F' WHEN c_nationkey % 2 = 0 THEN 'O' ELSE 'P' END AS p3 FROM orders JOIN customer ON o_custkey = c_custkey)"""
_EDGE = "ed AS (SELECT quantile_cont(c_acctbal, 0.2) AS e1, quantile_cont(c_acctbal, 0.4) AS e2, quantile_cont(c_acctbal, 0.6) AS e3, quantile_cont(c_acctbal, 0.8) AS e4 FROM fair)"
_BIN = "(c_acctbal >= e1)::INT + (c_acctbal >= e2)::INT + (c_acctbal >= e3)::INT + (c_acctbal >= e4)::INT"


@query("quantile_bins", f"WITH {FAIR}, {_EDGE} SELECT ({_BIN})::INT AS bin, count(*) AS n FROM fair, ed GROUP BY ALL")
def _(s, d):
    f = P.fair(s, d)
    return f.groupBy(fairness.binned(F.col("c_acctbal"), fairness.quantile_edges(f, "c_acctbal")).alias("bin")).agg(F.count("*").alias("n"))


def _nmi_sql(a: str) -> str:
    return f"""SELECT '{a}' AS key, (SELECT count(*) FROM fair) AS n, round(greatest(0, hx + hy - hxy) / ((hx + hy) / 2), 6)::DOUBLE AS value FROM (SELECT
      (SELECT entropy({a}) FROM fair) AS hx, (SELECT entropy(y) FROM fair) AS hy, (SELECT entropy({a} || '|' || y) FROM fair) AS hxy)"""


@query("nmi_protected", f"WITH {FAIR} " + " UNION ALL ".join(map(_nmi_sql, P.FAIR_GROUPS)))
def _(s, d):
    f = P.fair(s, d)
    a, b = (fairness.nmi(f, g, "y").select(F.lit(g).alias("key"), "n", "value") for g in P.FAIR_GROUPS)
    return a.unionByName(b)


def _disparity_sql(group: str, y: str, p: str, classes: list[str]) -> str:
    rates = " UNION ALL ".join(f"SELECT {group} AS g, '{c}' AS c, avg(({p} = '{c}')::INT) AS dp, avg(({p} = '{c}')::INT) FILTER ({y} = '{c}') AS tpr, avg(({p} = '{c}')::INT) FILTER ({y} <> '{c}') AS fpr FROM fair GROUP BY {group} HAVING count(*) >= 30" for c in classes)
    return f"WITH {FAIR}, r AS ({rates}), g AS (SELECT c, max(dp) - min(dp) AS dp, max(tpr) - min(tpr) AS eop, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo FROM r GROUP BY c) SELECT round(avg(dp), 6) AS delta_dp, round(avg(eop), 6) AS delta_eop, round(avg(eo), 6) AS delta_eo FROM g"


def _disparity(s, d, group, y, p, classes, metric):
    f = P.fair(s, d)
    out = fairness.disparities(fairness.cells(f, group, y, p), classes)
    return out.filter(F.col("metric") == metric).select("value") if metric else out


for _metric in ("delta_dp", "delta_eop", "delta_eo"):
    query(_metric, f"SELECT {_metric} AS value FROM ({_disparity_sql('c_mktsegment', 'y', 'p', ['1'])})")(lambda s, d, m=_metric: _disparity(s, d, "c_mktsegment", "y", "p", ["1"], m))


@query("delta_multiclass", f"WITH q AS ({_disparity_sql('o_orderpriority', 'y3', 'p3', ['F', 'O', 'P'])}) SELECT 'delta_dp' AS metric, delta_dp AS value FROM q UNION ALL SELECT 'delta_eop', delta_eop FROM q UNION ALL SELECT 'delta_eo', delta_eo FROM q")
def _(s, d):
    return _disparity(s, d, "o_orderpriority", "y3", "p3", ["F", "O", "P"], None)


@query("stat_parity_gap", f"WITH {FAIR} SELECT round(max(m) - min(m), 6) AS value FROM (SELECT avg(estimate) AS m FROM fair GROUP BY c_mktsegment HAVING count(*) >= 30)")
def _(s, d):
    return fairness.stat_parity_gap(P.fair(s, d), "c_mktsegment", "estimate")


@query("intersectional_dp", f"WITH {FAIR} SELECT round(max(m) - min(m), 6) AS value FROM (SELECT avg((p = '1')::INT) AS m FROM fair GROUP BY c_mktsegment || '×' || o_orderpriority HAVING count(*) >= 30)")
def _(s, d):
    f = P.fair(s, d).withColumn("g", fairness.crossed(P.FAIR_GROUPS))
    return fairness.disparities(fairness.cells(f, "g", "y", "p"), ["1"]).filter("metric = 'delta_dp'").select("value")


@query("group_collapse", f"WITH {FAIR} SELECT c_nationkey::VARCHAR || '×' || c_mktsegment || '×' || o_orderpriority AS g, count(*) AS n FROM fair GROUP BY ALL HAVING count(*) < 30")
def _(s, d):
    f = P.fair(s, d).withColumn("g", fairness.crossed(["c_nationkey", *P.FAIR_GROUPS]))
    return fairness.valid_groups(fairness.cells(f, "g", "y", "p"), 30)[1]


@query("confusion_matrix", f"WITH {FAIR} SELECT y3 AS y, p3 AS p, count(*) AS n FROM fair GROUP BY ALL")
def _(s, d):
    return utility.confusion(P.fair(s, d), "y3", "p3")


@query("macro_f1", f"WITH {FAIR} SELECT round(avg(f), 6) AS value FROM (" + " UNION ALL ".join(f"SELECT 2 * count(*) FILTER (y3 = '{c}' AND p3 = '{c}') / (count(*) FILTER (y3 = '{c}') + count(*) FILTER (p3 = '{c}')) AS f FROM fair" for c in "FOP") + ")")
def _(s, d):
    return utility.macro_f1(P.fair(s, d), "y3", "p3")


@query("roc_auc_rank", f"WITH {FAIR}, r AS (SELECT y, rank() OVER (ORDER BY estimate) + (count(*) OVER (PARTITION BY estimate) - 1) / 2 AS rk FROM fair) SELECT round((sum(rk) FILTER (y = '1') - count(*) FILTER (y = '1') * (count(*) FILTER (y = '1') + 1) / 2) / (count(*) FILTER (y = '1') * count(*) FILTER (y = '0')), 6) AS value FROM r")
def _(s, d):
    return utility.rank_auc(P.fair(s, d), F.col("y") == "1", "estimate")


@query("r2_wmape", f"WITH {FAIR} SELECT round(1 - sum((o_totalprice - estimate) ** 2) / (var_pop(o_totalprice) * count(*)), 6) AS r2, round(sum(abs(o_totalprice - estimate)) / sum(abs(o_totalprice)), 6) AS wmape FROM fair")
def _(s, d):
    return utility.r2_wmape(P.fair(s, d), "o_totalprice", "estimate")


# Profiles

_skew = lambda c: f"(avg({c} ** 3) - 3 * avg({c}) * avg({c} ** 2) + 2 * avg({c}) ** 3) / (stddev_pop({c}) ** 3)"
#: No l_discount: its mean may lie on the edge of rounding.
_PNUM = ["l_quantity", "l_extendedprice", "l_tax", "l_partkey"]
_prof = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, 1 - count({c}) / count(*) AS missing_rate, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg((({c} - a) / s) ** 3) AS skew, avg((({c} - a) / s) ** 4) - 3 AS kurtosis FROM (SELECT {c}, avg({c}) OVER () AS a, stddev_pop({c}) OVER () AS s FROM lineitem)" for c in _PNUM)


@query("profile_numeric", f"WITH p AS ({_prof}), b AS (SELECT *, (skew ** 2 + 1) / (kurtosis + 3 * (n - 1)::DOUBLE ** 2 / ((n - 2)::DOUBLE * (n - 3))) AS bimodality FROM p) SELECT \"column\", n, round(missing_rate, 6) AS missing_rate, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(bimodality, 6) AS bimodality, bimodality > 5 / 9 AS is_multimodal FROM b")
def _(s, d):
    return profile.profile_numeric(P.table(s, d, "lineitem"), _PNUM)


@query("bimodality", f"WITH p AS ({_prof}) SELECT \"column\", round((skew ** 2 + 1) / (kurtosis + 3 * (n - 1)::DOUBLE ** 2 / ((n - 2)::DOUBLE * (n - 3))), 6) AS bimodality FROM p")
def _(s, d):
    return profile.profile_numeric(P.table(s, d, "lineitem"), _PNUM).select("column", "bimodality")


_PCAT = ["o_orderstatus", "o_orderpriority"]


@query("profile_categorical", " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", (SELECT count({c}) FROM orders) AS n, (SELECT round(1 - count({c}) / count(*), 6) FROM orders) AS missing_rate, (SELECT count(DISTINCT {c}) FROM orders) AS n_unique, {c} AS top, round(count(*) / (SELECT count({c}) FROM orders), 6) AS top_share FROM orders GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in _PCAT))
def _(s, d):
    return profile.profile_categorical(P.table(s, d, "orders"), _PCAT)


@query("missing_rate", f"WITH {RAW} SELECT count(*) AS n_rows, (count(*) - count(l_quantity) + count(*) - count(l_discount))::BIGINT AS n_missing, round((2 * count(*) - count(l_quantity) - count(l_discount)) / (7 * count(*)), 6) AS value FROM raw")
def _(s, d):
    return profile.missing_rate(P.li_raw(s, d))


@query("top_pearson_pairs", f"WITH {REAL} SELECT a, b, round(r, 6) AS r FROM ({_corr('real')}) ORDER BY abs(r) DESC LIMIT 3")
def _(s, d):
    return profile.top_pairs(fidelity.pearson_pairs(P.li(s, d)[0], _NUM), "r", _NUM, 3)


_geo_pairs = [(a, b) for i, a in enumerate(P.GEO) for b in P.GEO[i + 1 :]]


@query("top_cramer_pairs", f"WITH {REAL}, {_cramer('real', 'cr')} SELECT a, b, round(v, 6)::DOUBLE AS v FROM cr WHERE v > 0 ORDER BY v DESC LIMIT 2")
def _(s, d):
    return profile.top_pairs(fidelity.cramers_v_pairs(_two(P.li(s, d)[0]), _CAT).filter("v > 0"), "v", _CAT, 2)


@query("class_imbalance", "SELECT 'o_orderstatus' AS target, round(max(n) / min(n), 6) AS value FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)")
def _(s, d):
    return profile.class_imbalance(P.table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("coverage_rate", f"WITH {REAL}, {RAW} SELECT 'l_returnflag' AS \"column\", count(*) AS n, round(avg((l_returnflag IN (SELECT l_returnflag FROM real))::INT), 6) AS value FROM raw UNION ALL SELECT 'l_linestatus', count(*), round(avg((l_linestatus IN (SELECT l_linestatus FROM real))::INT), 6) FROM raw")
def _(s, d):
    return profile.coverage_rate(P.li(s, d)[0], P.li_raw(s, d), ["l_returnflag", "l_linestatus"])


_err = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", abs((SELECT avg({c}) FROM synth) - avg({c})) / (abs(avg({c})) + 1e-8) AS mean_error, abs((SELECT stddev_samp({c}) FROM synth) - stddev_samp({c})) / (abs(stddev_samp({c})) + 1e-8) AS std_error FROM real" for c in P.LI_CONT)


@query("mean_std_error", f"WITH {REAL}, {SYNTH} SELECT \"column\", round(mean_error, 6) AS mean_error, round(std_error, 6) AS std_error FROM ({_err})")
def _(s, d):
    return profile.mean_std_error(*P.li(s, d), P.LI_CONT)


_top5 = lambda t, c: f"(SELECT {c}::VARCHAR AS v FROM {t} GROUP BY {c} ORDER BY count(*) DESC, CASE WHEN {c}::VARCHAR LIKE '%.0' THEN replace({c}::VARCHAR, '.0', '') ELSE {c}::VARCHAR END LIMIT 5)"


@query("top5_overlap", f"WITH {REAL}, {SYNTH} SELECT 'l_quantity' AS \"column\", count(*) AS n_common FROM {_top5('real', 'l_quantity')} JOIN {_top5('synth', 'l_quantity')} USING (v) UNION ALL SELECT 'l_linenumber', count(*) FROM {_top5('real', 'l_linenumber')} JOIN {_top5('synth', 'l_linenumber')} USING (v)")
def _(s, d):
    return profile.top_overlap(*P.li(s, d), ["l_quantity", "l_linenumber"])


@query("value_distribution", "SELECT o_orderpriority AS v, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY ALL")
def _(s, d):
    return profile.value_distribution(P.table(s, d, "orders"), "o_orderpriority")


@query("quality_score", f"WITH {REAL}, {SYNTH}, {RAW}, c AS (SELECT avg((l_returnflag IN (SELECT l_returnflag FROM real))::INT) AS c FROM raw), e AS (SELECT avg(e) AS e FROM (SELECT unnest([mean_error, std_error]) AS e FROM ({_err}))) SELECT round(0.6 * c + 0.4 * (1 - least(e, 1)), 6) AS value FROM c, e")
def _(s, d):
    real, synth = P.li(s, d)
    return profile.quality_score(profile.coverage_rate(real, P.li_raw(s, d), ["l_returnflag"]), profile.mean_std_error(real, synth, P.LI_CONT))


_ORD = ["n_regionkey", "n_name", "c_mktsegment"]
_ent = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, entropy({a}::VARCHAR || '|' || {b}::VARCHAR) AS h FROM real" for a, b in [*[(c, c) for c in _ORD], *[(a, b) for i, a in enumerate(_ORD) for b in _ORD[i + 1 :]]])


@query("pair_entropy", f"WITH {GEO} SELECT a, b, round(h, 6) AS h FROM ({_ent})")
def _(s, d):
    return ordering.pair_entropies(P.geo(s, d)[0], _ORD)


@query("chain_ce_mi", f"WITH {GEO}, e AS ({_ent}), h AS (SELECT (SELECT h FROM e WHERE a = 'n_regionkey' AND b = a) AS r, (SELECT h FROM e WHERE a = 'n_name' AND b = a) AS n, (SELECT h FROM e WHERE a = 'c_mktsegment' AND b = a) AS c, (SELECT h FROM e WHERE a = 'n_regionkey' AND b = 'n_name') AS rn, (SELECT h FROM e WHERE a = 'n_name' AND b = 'c_mktsegment') AS nc) SELECT round(r + (rn - r) + (nc - n), 6) AS ce, round((r + n - rn) + (n + c - nc), 6) AS mi FROM h")
def _(s, d):
    h = {(r["a"], r["b"]): r["h"] for r in ordering.pair_entropies(P.geo(s, d)[0], _ORD).collect()}
    return s.createDataFrame([tuple(map(float, ordering.chain_scores(h, _ORD)))], "ce double, mi double")


_orders = " UNION ALL ".join(
    f"SELECT '{'>'.join(o)}' AS ordering, " + " + ".join([f"h('{o[0]}', '{o[0]}')", *[f"h('{a}', '{b}') - h('{a}', '{a}')" for a, b in zip(o, o[1:], strict=False)]]) + " AS ce, " + " + ".join(f"h('{a}', '{a}') + h('{b}', '{b}') - h('{a}', '{b}')" for a, b in zip(o, o[1:], strict=False)) + " AS mi"
    for o in permutations(_ORD)
)


ORDERS = f"{GEO}, e AS ({_ent}), o AS (" + re.sub(r"h\('(\w+)', '(\w+)'\)", r"(SELECT max(h) FROM e WHERE a = '\1' AND b = '\2' OR a = '\2' AND b = '\1')", _orders) + ")"


@query("ordering_scores", f"WITH {ORDERS} SELECT ordering, round(ce, 6) AS ce, round(mi, 6) AS mi FROM o")
def _(s, d):
    return s.createDataFrame([(">".join(o), float(ce), float(mi)) for o, ce, mi in ordering.score_all_permutations(P.geo(s, d)[0], _ORD)], "ordering string, ce double, mi double")


@query("stacked_sides", f"WITH {REAL}, {SYNTH} SELECT side, l_returnflag, count(*) AS n FROM (SELECT 1 AS side, l_returnflag FROM real UNION ALL SELECT 0, l_returnflag FROM synth) GROUP BY ALL")
def _(s, d):
    return fidelity.stacked(*P.li(s, d), ["l_returnflag"]).groupBy("side", "l_returnflag").agg(F.count("*").alias("n"))


# Leaderboards and significance

RUNS = P.RUNS
_METRICS = ["irr", "mean_ks", "dsi_gap", "utility", "dcr_5th", "delta_eo"]
_WIDE = f"{RUNS}, w AS (SELECT model, {', '.join(f'''avg(value::DOUBLE) FILTER (metric = '{m}') AS {m}''' for m in _METRICS)} FROM runs GROUP BY model)"
_AXES = f"{_WIDE}, ax AS (" + " UNION ALL ".join(f"SELECT model, '{a}' AS axis, ({e})::DOUBLE AS value FROM w" for a, e in (("structural", "1 - irr"), ("fidelity", "1 - mean_ks"), ("logic", "1 / (1 + dsi_gap)"), ("utility", "utility"), ("privacy", "dcr_5th"), ("fairness", "1 - delta_eo"))) + ")"
_MM = "(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)"
_RADAR = f"{_AXES}, rd AS (SELECT model, axis, CASE WHEN axis = 'privacy' THEN value / max(value) OVER w ELSE {_MM} END AS value FROM ax WINDOW w AS (PARTITION BY axis))"
_SCORE = f"sc AS (SELECT model, sum(value * CASE axis {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {w}' for a, w in leaderboard.WEIGHTS.items())} END)::DOUBLE AS score FROM rd GROUP BY model)"


@query("leaderboard", f"WITH {_RADAR}, {_SCORE} SELECT model, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)}, round(score, 6) AS score FROM w JOIN sc USING (model)")
def _(s, d):
    return leaderboard.leaderboard(P.runs(s, d))


def _axis_table(s, d):
    return leaderboard.axis_values(leaderboard.wide(leaderboard.mean_metrics(P.runs(s, d)), _METRICS))


@query("radar_minmax", f"WITH {_RADAR} SELECT model, axis, round(value, 6) AS value FROM rd")
def _(s, d):
    return leaderboard.radar_minmax(_axis_table(s, d))


@query("radar_baseline", f"WITH {_AXES}, b AS (SELECT axis, value AS ref FROM ax WHERE model = 'alpha') SELECT model, axis, round(CASE WHEN axis = 'privacy' THEN value / max(value) OVER (PARTITION BY axis) ELSE least(1.5, greatest(0, value / ref)) / 1.5 END, 6) AS value FROM ax JOIN b USING (axis)")
def _(s, d):
    return leaderboard.radar_baseline(_axis_table(s, d), "alpha")


@query("pareto_front", f"WITH {P.POINTS} SELECT model, round(x, 6) AS x, y, NOT EXISTS (SELECT 1 FROM p q WHERE q.x >= p.x AND q.y >= p.y AND (q.x > p.x OR q.y > p.y)) AS is_optimal FROM p")
def _(s, d):
    return leaderboard.pareto_front(P.points(s, d))


@query("best_model_metric", f"WITH {P.LEARNERS} SELECT model, round(max(value), 6)::DOUBLE AS best FROM l GROUP BY model")
def _(s, d):
    return leaderboard.best_model_metric(P.learners(s, d))


@query("latest_run", f"WITH {P.LOG} SELECT model, dataset, run::INT AS run, ts::INT AS ts, status FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY ts DESC, run DESC) AS k FROM l) WHERE k = 1")
def _(s, d):
    return leaderboard.latest_run(P.log(s, d), ["model", "dataset"], "ts")


@query("metric_heat_map", f"WITH {RUNS} SELECT model, run::INT AS run, metric, round(value::DOUBLE, 6) AS value, round(CASE WHEN metric IN ('irr', 'mean_ks', 'dsi_gap', 'delta_eo') THEN 1 - {_MM} ELSE {_MM} END, 6)::DOUBLE AS shade FROM (SELECT * REPLACE (value::DOUBLE AS value) FROM runs) WINDOW w AS (PARTITION BY metric)")
def _(s, d):
    return leaderboard.heat_map(P.runs(s, d), ["irr", "mean_ks", "dsi_gap", "delta_eo"])


@query("holm_adjust", f"WITH {P.TESTS}, k AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(p) OVER () AS m FROM t WHERE p IS NOT NULL) SELECT metric, p::DOUBLE AS p, round(max(least(1, p * (m - r + 1))) OVER (ORDER BY r), 6)::DOUBLE AS p_adjusted FROM k UNION ALL SELECT metric, NULL, NULL FROM t WHERE p IS NULL")
def _(s, d):
    return significance.holm_adjust(P.tests(s, d))


_PAIRED = f"{RUNS}, pr AS (SELECT a.metric, a.run, b.value::DOUBLE - a.value::DOUBLE AS d FROM runs a JOIN runs b USING (metric, run) WHERE a.model = 'alpha' AND b.model = 'beta')"


@query("signed_ranks", f"WITH {_PAIRED}, z AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY round(abs(d), 9)) + (count(*) OVER (PARTITION BY metric, round(abs(d), 9)) - 1) / 2 AS rk FROM pr WHERE d <> 0), s AS (SELECT metric, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus, count(*) AS n_nonzero FROM z GROUP BY metric), n AS (SELECT metric, count(*) AS n FROM pr GROUP BY metric) SELECT metric, n, n_nonzero, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, round(1 - 2 * least(w_plus, w_minus) / (n * (n + 1) / 2), 6)::DOUBLE AS effect FROM n JOIN s USING (metric)")
def _(s, d):
    return significance.signed_ranks(significance.paired(P.runs(s, d), "alpha", "beta").withColumn("d", F.round("d", 9)))


@query("paired_t_stat", f"WITH {_PAIRED} SELECT metric, count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg(d) / stddev_samp(d), 6) AS effect FROM pr GROUP BY metric")
def _(s, d):
    return significance.paired_t(significance.paired(P.runs(s, d), "alpha", "beta"))


@query("ci_overlap", f"WITH {P.INTERVALS} SELECT metric, greatest(a, b) - 40 < least(a, b) + 40 AS overlap, NOT greatest(a, b) - 40 < least(a, b) + 40 AS significant FROM i")
def _(s, d):
    return significance.ci_overlap(P.intervals(s, d))


@query("run_alignment", f"WITH {_PAIRED} SELECT metric, run::INT AS run, round(d, 6) AS d FROM pr")
def _(s, d):
    return significance.paired(P.runs(s, d), "alpha", "beta")


@query("probe_minimum", f"WITH {P.LEARNERS} SELECT model, round(coalesce(min(value), 0.5), 6)::DOUBLE AS value FROM l GROUP BY model")
def _(s, d):
    return leaderboard.best_model_metric(P.learners(s, d), higher=False).select("model", F.coalesce("best", F.lit(0.5)).alias("value"))


# Samples, folds, texts


@query("stratified_sample", "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders) WHERE k <= ceil(c / 10) GROUP BY ALL")
def _(s, d):
    out = sampling.stratified_sample(P.table(s, d, "orders"), 1, 10, "o_orderstatus", ["o_custkey", "o_orderkey"])
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("kfold_assign", "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def _(s, d):
    return sampling.fold_of(P.table(s, d, "orders"), 5, "o_orderstatus", ["o_orderkey"]).select("o_orderkey", F.col("fold").cast("int").alias("fold"))


@query("serialize_instruction", "SELECT doc_id, 'Input: [doc_id: ' || doc_id || ', quality: ' || quality || ', toxic: ' || toxic || '] Output:' AS prompt FROM labels")
def _(s, d):
    return serialize.as_instruction(P.table(s, d, "labels"), ["doc_id", "quality", "toxic"]).select("doc_id", "prompt")


@query("serialize_spans", "SELECT doc_id, 'doc_id is ' || doc_id || ', quality is ' || quality AS sentence, 10 AS start_0, 10 + length(doc_id::VARCHAR)::INT AS stop_0, 10 + length(doc_id::VARCHAR)::INT + 13 AS start_1 FROM labels")
def _(s, d):
    out = serialize.with_spans(P.table(s, d, "labels").select("doc_id", "quality"), ["doc_id", "quality"])
    span = lambda i, k: F.get("spans", F.lit(i))[k].alias(f"{k}_{i}")
    return out.select("doc_id", "sentence", span(0, "start"), span(0, "stop"), span(1, "start"))


@query("parse_label", "SELECT doc_id, CASE WHEN contains(lower(text), 'der') THEN 'Der' WHEN contains(lower(text), 'and') THEN 'and' WHEN contains(lower(text), 'que') THEN 'que' ELSE 'Der' END AS label FROM documents")
def _(s, d):
    return P.table(s, d, "documents").select("doc_id", serialize.parse_label(F.col("text"), ["que", "and", "Der"]).alias("label")).select("doc_id", F.col("label"))


@query("masked_ppl", "SELECT event_type AS kind, count(*) FILTER (user_id % 3 <> 0) AS n_tokens, round(exp(avg(value / 100) FILTER (user_id % 3 <> 0)), 6) AS perplexity FROM events GROUP BY event_type")
def _(s, d):
    t = P.table(s, d, "events").select(F.col("event_type").alias("kind"), (F.col("value") / 100).alias("loss"), (F.col("user_id") % 3 == 0).alias("masked"))
    return serialize.masked_perplexity(t, ["kind"])


@query("drift_by_window", "WITH c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS v, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT event_type AS v, count(*) / sum(count(*)) OVER () AS q FROM events GROUP BY ALL), w AS (SELECT start, sum(n) AS n FROM c GROUP BY start) SELECT w.start, w.n::BIGINT AS n, round(sum(abs(coalesce(c.n, 0) / w.n - q.q)) / 2, 6)::DOUBLE AS tvd FROM w CROSS JOIN q LEFT JOIN c ON c.start = w.start AND c.v = q.v GROUP BY w.start, w.n")
def _(s, d):
    e = P.table(s, d, "events")
    return drift.drift_by_window(drift.window_counts(e, "ts", "event_type"), e.groupBy(F.col("event_type").alias("v")).agg(F.count("*").alias("n")))


_draw = lambda k: f"(('0x' || substr(md5('{k}|' || c_custkey), 1, 13))::BIGINT / 4503599627370496.0)"
_normal = lambda k: f"sqrt(-2 * ln(1 - {_draw(k)})) * cos(2 * pi() * {_draw(k + 1)})"


@query(
    "scm_generate",
    f"""WITH i AS (SELECT c_custkey, scenario, bad, greatest(10000.0, CASE WHEN bad THEN 35000 ELSE 50000 END + 15000 * (c_acctbal - 4500)::DOUBLE / 3000) AS income
    FROM customer, (VALUES ('normal', false), ('recession', true)) t(scenario, bad)),
  c AS (SELECT *, least(850.0, greatest(300.0, 550 + income / 500 + 40 * {_normal(2)})) AS credit FROM i),
  l AS (SELECT *, greatest(1000.0, 0.3 * income + 20 * credit + 3000 * {_normal(4)}) AS loan FROM c)
  SELECT scenario, count(*) AS n, round(avg(income), 4) AS income, round(avg(credit), 6) AS credit_score, round(avg(loan), 4) AS loan_amount,
    round(avg(({_draw(6)} < 1 / (1 + exp(-(CASE WHEN bad THEN 1.0 ELSE 0.0 END + loan / income * 4 - credit / 200))))::INT), 6) AS default_rate FROM l GROUP BY scenario""",
)
def _(s, d):
    """The customers' structural model in two scenarios; the income's shock is their balance."""
    shock = (F.col("c_acctbal") - 4500).cast("double") / 3000
    made = [files.causal_rows(P.table(s, d, "customer"), ["c_custkey"], k, shock).withColumn("scenario", F.lit(k)) for k in ("normal", "recession")]
    means = [F.round(F.avg(c), k).alias(n) for c, n, k in (("Income", "income", 4), ("Credit_Score", "credit_score", 6), ("Loan_Amount", "loan_amount", 4), ("Default", "default_rate", 6))]
    return made[0].unionByName(made[1]).groupBy("scenario").agg(F.count("*").alias("n"), *means)


# What SQL can't express


def finished(errors: dict[str, str | None]) -> None:
    """An error if a part has failed: scores of the other parts alone are not the query's result."""
    failed = [f"{part}: {why}" for part, why in errors.items() if why]
    if failed:
        raise RuntimeError("; ".join(failed))


@query("bootstrap_ci")
def _(s, d):
    return bootstrap.table_mean_ci(P.table(s, d, "orders"), F.col("o_totalprice"), [F.col("o_orderkey")])


@query("dsi_gmm")
def _(s, d):
    from tabscore.operators.density import density_gap

    return s.createDataFrame([density_gap(*P.li(s, d), P.LI_CONT)], "real_ll double, synth_ll double, gap double")


@query("c2st_auc")
def _(s, d):
    real, synth = P.li(s, d)
    return s.createDataFrame(list(utility.c2st_auc(real, synth, DataSchema(real)).items()), "model string, auc double")


def _fair_schema(f: DataFrame) -> DataSchema:
    return DataSchema(f.select("o_totalprice", "c_acctbal", *P.FAIR_GROUPS, "y"))


def _halves(s, d) -> tuple[DataFrame, DataFrame]:
    f = sampling.hash_fold(P.fair(s, d).select("o_totalprice", "c_acctbal", *P.FAIR_GROUPS, "y"), 2)
    return f.filter("fold = 0").drop("fold"), f.filter("fold = 1").drop("fold")


@query("tstr_utility")
def _(s, d):
    synth, test = _halves(s, d)
    r = utility.MLUtilityEvaluator(_fair_schema(test), "y", TaskType.BINARY).evaluate(synth, test)
    finished(r.errors)
    return s.createDataFrame([(m, k, v) for m, x in r.tstr.items() for k, v in x.items()], "model string, metric string, value double")


@query("fairness_probe")
def _(s, d):
    synth, test = _halves(s, d)
    r = fairness.FairnessEvaluator(test, _fair_schema(test), FairSpec(["c_mktsegment", "c_acctbal"], "y", TaskType.BINARY, True)).evaluate(synth, test)
    finished({"probe": r.error})
    rows = [("nmi", k, v) for k, v in r.nmi.items()] + [("delta_dp", k, v) for k, v in r.delta_dp.items()] + [("delta_eo", k, v) for k, v in (r.delta_eo or {}).items()]
    return s.createDataFrame(rows, "metric string, key string, value double")


def bundle_of(s: SparkSession, d: str):
    """All six dimensions at the pipeline's defaults. A fifth of the real rows is the test table, the others train; the schema is of all."""
    from tabscore.plans.pipeline import BenchmarkPipeline, PipelineConfig

    real, _ = P.li(s, d)
    folds = sampling.hash_fold(real, 5)
    train, test = folds.filter("fold <> 0").drop("fold"), folds.filter("fold = 0").drop("fold")
    logic = LogicSpec(math_equations=[("l_quantity", "*", "l_extendedprice", "l_tax")])
    fair = FairSpec(["l_returnflag", "l_quantity"], "l_linestatus", TaskType.BINARY, True)
    config = PipelineConfig(train, test, DataSchema(real), logic, fair, "l_linestatus", TaskType.BINARY, model="raw", dataset="lineitem")
    return BenchmarkPipeline(config).run(P.li_raw(s, d))


@query("pipeline_bundle")
def _(s, d):
    from tabscore.plans.bundle import tidy

    bundle = bundle_of(s, d)
    finished(bundle.errors)
    return tidy(s, bundle)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dimension, metric, key, value): the structural gate over the raw rows, then the marginals of what passes."""
    real, raw = P.li(spark, sf_dir)[0], P.li_raw(spark, sf_dir)
    schema = DataSchema(real)
    gate = structural.StructuralInterceptor(schema)
    seen = gate.tagged(raw)
    irr = structural.invalid_row_rate(seen).select(F.lit(0).alias("dimension"), F.lit("irr").alias("metric"), F.lit("").alias("key"), F.col("irr").alias("value"))
    marginal = fidelity.FidelityEvaluator(real, schema).marginals(gate.clean(seen)).select(F.lit(1).alias("dimension"), "metric", "key", "value")
    means = marginal.groupBy("metric").agg(F.avg("value").alias("value")).select(F.lit(1).alias("dimension"), F.concat(F.lit("mean_"), "metric").alias("metric"), F.lit("").alias("key"), "value")
    return rounded(irr.unionByName(marginal).unionByName(means))

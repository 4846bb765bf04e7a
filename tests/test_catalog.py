"""Every registered query against its SQL, on the smallest tables; the operators' rules on hand-made tables."""

from __future__ import annotations

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tabscore import registry
from tabscore.functions.canon import canon, ingest, parse_boolean, parse_number
from tabscore.operators import bootstrap, density, encoders, fairness, fidelity, leaderboard, logic, neighbors, ordering, profile, sampling, serialize, significance, structural, utility
from tabscore.operators.schema import DataSchema, schema_fingerprint
from tabscore.operators.specs import FairSpec, GenerationCollapseError, LogicSpec, SchemaMismatchError, TaskType
from tabscore.plans import pairs as P
from tabscore.plans.bundle import ResultBundle, extract, raw_scores, tidy
from tabscore.plans.catalog import bundle_of
from tabscore.plans.pipeline import DIM0_FAILED, NO_SPEC, NO_TARGET, BenchmarkPipeline, PipelineConfig
from tabscore.sources import files
from tabscore.streaming import drift
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Trained models: they run in the driver's check and have tests of their own here.
SLOW = {"dsi_gmm", "c2st_auc", "tstr_utility", "fairness_probe", "pipeline_bundle", "bootstrap_ci"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in registry.oracle_sql():
        assert mine
        return
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_flagship(spark):
    rows = {(r["metric"], r["key"]): r["value"] for r in registry.flagship(spark, DATA).collect()}
    assert 0 < rows["irr", ""] < 0.2 and rows["mean_ks", ""] < 0.1


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    age = rng.integers(18, 70, 200)
    income = (age * 1000 + rng.normal(0, 5000, 200)).astype(int)
    rows = [(int(a), int(i), ["Male", "Female"][int(g)], int(i > 45_000)) for a, i, g in zip(age, income, rng.integers(0, 2, 200), strict=True)]
    return spark.createDataFrame(rows, "age int, income int, gender string, label int").persist()


# Canonical text and schema


def test_numbers_and_texts(spark):
    texts = ["nan", "1d", "1f", "0x10", "1_000", "1,000", "True", "", " 12 ", "+5", "1e5", "inf", None, "-.5", "3."]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_number(F.col("t")).alias("v"))
    assert [r["v"] for r in d.collect()] == [None] * 8 + [12.0, 5.0, 1e5, math.inf, None, -0.5, 3.0]
    n = spark.createDataFrame([(4.0, True), (0.25, False), (float("nan"), None)], "x double, b boolean")
    kinds = {f.name: f.dataType for f in n.schema.fields}
    assert [tuple(r) for r in ingest(n).select(canon(F.col("x"), kinds["x"]), canon(F.col("b"), kinds["b"])).collect()] == [("4", "True"), ("0.25", "False"), ("nan", "nan")]
    b = spark.createDataFrame([("False",), ("true",), ("maybe",)], "t string").select(parse_boolean(F.col("t")).alias("v"))
    assert [r["v"] for r in b.collect()] == [False, True, None]


def test_schema(spark, small):
    s = DataSchema(small)
    assert (s.continuous_columns, s.categorical_columns) == (["age", "income"], ["gender", "label"])
    assert s["gender"].categories == {"Male", "Female"} and repr(s) == "DataSchema(4 columns: 2 continuous, 2 categorical)"
    assert schema_fingerprint(s) == schema_fingerprint(DataSchema(small.select("label", "gender", "income", "age"))) != schema_fingerprint(DataSchema(small.drop("age")))
    with pytest.raises(KeyError):
        s["none"]
    with pytest.raises(ValueError):
        DataSchema(small, ["age"], ["age"])
    with pytest.raises(ValueError):
        DataSchema(small, ["other"])
    with pytest.raises(ValueError):
        DataSchema(spark.sql("select current_timestamp() as t"))


# Dimension 0


def test_first_defects(spark, small):
    s = DataSchema(small)
    rows = [("30", "50000", "Male", "1"), ("abc", "x", "Zed", "1"), ("500", "50000", "Zed", "1"), (None, "50000", "Male", "1.0"), ("30", "50000", None, "1"), ("nan", "50000", "Male", "1")]
    gate = structural.StructuralInterceptor(s, min_clean_rows=1)
    r = gate.evaluate(spark.createDataFrame(rows, "age string, income string, gender string, label string"))
    assert r.defect_counts == {"type_coercion_nan": 2, "out_of_bounds": 1, "oov_hallucination": 1} and r.n_invalid == 4
    assert [tuple(x) for x in r.clean_df.collect()] == [(30, 50000, "Male", 1), (None, 50000, "Male", 1)]
    with pytest.raises(SchemaMismatchError) as e:
        gate.evaluate(small.drop("age").withColumn("new", F.lit(1)))
    assert (e.value.missing, e.value.extra) == ({"age"}, {"new"})
    with pytest.raises(GenerationCollapseError):
        structural.StructuralInterceptor(s, 1000).evaluate(small)


def test_large_vocabularies_are_joined(spark):
    real = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("c"), F.col("id").alias("n"))
    s = DataSchema(real)
    assert s["c"].categories is None
    r = structural.StructuralInterceptor(s, 1).evaluate(real.union(spark.createDataFrame([("new", 5), (None, 5)], "c string, n long")))
    assert (r.n_total, r.defect_counts["oov_hallucination"]) == (3002, 2)


# Dimension 1


def test_identity_and_shift(spark, small):
    s = DataSchema(small)
    same = fidelity.FidelityEvaluator(small, s).evaluate(small, manifold=False, c2st=False)
    assert same.mean_ks == 0 and same.mean_tvd == 0 and same.pearson_matrix_error == pytest.approx(0)
    moved = small.withColumn("age", F.col("age") + 40).withColumn("income", F.col("income") * 5)
    assert fidelity.FidelityEvaluator(small, s, n_boot=50).evaluate(moved, manifold=False, c2st=False).mean_ks > 0.5
    nulls = small.withColumn("age", F.lit(None).cast("int"))
    assert fidelity.FidelityEvaluator(small, s).evaluate(nulls, manifold=False, c2st=False).skipped == {"age": "all-NaN in synthetic data"}


def test_cramers_v(spark):
    cells = [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 5)]
    d = spark.createDataFrame([(p, q) for p, q, n in cells for _ in range(n)], "p string, q string")
    o = np.array([[10, 20], [30, 5]], float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    gap = np.abs(o - e)
    n, chi = o.sum(), ((gap - np.minimum(0.5, gap)) ** 2 / e).sum()
    want = math.sqrt(max(0, chi / n - 1 / (n - 1)) / (1 - 1 / (n - 1)))
    assert fidelity.cramers_v_pairs(d, ["p", "q"]).first()["v"] == pytest.approx(want)
    assert fidelity.cramers_v_pairs(d.withColumn("q", F.lit("k")), ["p", "q"]).first()["v"] == 0


def test_constant_column_has_no_correlation(spark, small):
    assert fidelity.pearson_pairs(small.withColumn("c", F.lit(1)), ["age", "c"]).first()["r"] is None


def test_strategies_agree(spark):
    rng = np.random.default_rng(1)
    frame = lambda n: spark.createDataFrame([(i, rng.normal(size=4).round(1).tolist()) for i in range(n)], "id long, x array<double>")
    a, b = frame(60).persist(), frame(50).persist()
    key = lambda d: sorted((r["id"], r["rank"], r["nearest"], round(r["distance"], 9)) for r in d.collect())
    for k, other, itself in ((1, b, False), (3, a, True)):
        assert key(neighbors.nearest(a, other, k, itself, "sql")) == key(neighbors.nearest(a, other, k, itself, "arrow"))
    with pytest.raises(ValueError):
        neighbors.route("index", 1)


# Dimension 2


def test_dependencies(spark):
    real = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b"), ("2", "c"), ("2", "d"), ("3", None), (None, "z")], "det string, dep string")
    assert {tuple(r) for r in logic.fd_mapping(real, "det", "dep").collect()} == {("1", "b"), ("2", "c")}
    synth = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", None), ("9", "x"), (None, "x"), ("3", "q")], "det string, dep string")
    r = {x["key"]: x["n_violations"] for x in logic.flag_rates(logic.fd_flags(real, synth, [("det", "dep")]), "fd", ["f"]).collect()}
    assert r == {"f": 2, "overall": 2}
    h = {x["key"]: x["n_violations"] for x in logic.flag_rates(logic.hierarchy_flags(real, synth, [["det", "dep"]]), "chain", ["c"]).collect()}
    assert h["c"] == 4


def test_equations(spark):
    d = spark.createDataFrame([(1.0, 0.0, 5.0), (4.0, 2.0, 2.0), (4.0, 2.0, 2.1), (None, 1.0, 1.0), (1.001, 1.0, 1.0)], "a double, b double, c double")
    r = logic.mdi_per_equation(d, [("a", "/", "b", "c")]).first()
    assert (r["n_valid"], r["value"]) == (3, pytest.approx(1 / 3))
    assert not LogicSpec().is_applicable("icvr") and LogicSpec(known_fds=[("a", "b")]).is_applicable("icvr")


def test_fd_discovery(spark):
    d = spark.range(60).select((F.col("id") % 3).alias("zip"), (F.col("id") % 3 * 7).alias("city"), "id", F.lit(None).cast("string").alias("none"), F.lit(1).alias("one"))
    fds = logic.discover_fds(d)
    assert ("zip", "city") in fds and ("city", "zip") in fds and ("id", "zip") in fds and ("one", "zip") not in fds and all(b != "none" for _, b in fds)
    assert logic.discover_fds(d.limit(20)) == []


def test_row_numbers(spark):
    d = spark.range(500).select(F.xxhash64("id").alias("x"))
    assert [r["n"] for r in logic.row_numbers(d, [F.col("x")]).orderBy("x").collect()] == list(range(1, 501))


def test_density(spark):
    blobs = spark.range(600).select((F.randn(1) + F.when(F.col("id") % 2 == 0, 0.0).otherwise(20.0)).alias("x"), F.randn(2).alias("y"))
    real, same, far = density.density_gap(blobs, blobs, ["x", "y"])
    assert abs(far) < 0.5 and math.isfinite(real)
    assert density.density_gap(blobs, blobs.withColumn("y", F.col("y") + 30), ["x", "y"])[2] > 50
    m = density.Mixture(np.ones(1), np.zeros((1, 1)), np.ones((1, 1, 1)))
    assert m.log_density(np.zeros((1, 1)))[0] == pytest.approx(-0.5 * math.log(2 * math.pi), abs=1e-5)


# Dimensions 3 to 5


def test_scores(spark):
    d = spark.createDataFrame([("a", "a", 0.9), ("a", "b", 0.4), ("b", "b", 0.4), ("b", "b", 0.1), ("c", "a", 0.2)], "y string, p string, s double")
    assert utility.macro_f1(d, "y", "p").first()["value"] == pytest.approx((0.5 + 0.8 + 0) / 3)
    assert utility.rank_auc(d, F.col("y") == "a", "s").first()["value"] == pytest.approx((3 + 2.5) / 6)
    assert utility.rank_auc(d, F.lit(True), "s").first()["value"] is None


def test_utility_and_probe(spark, small):
    s = DataSchema(small)
    r = utility.MLUtilityEvaluator(s, "label", TaskType.BINARY, n_tuning_trials=0, trees=5).evaluate(small, small, small)
    assert r.tstr["random_forest"]["macro_f1"] > 0.8 and r.utility_gap["gbt"]["macro_f1"] == pytest.approx(0)
    one = utility.MLUtilityEvaluator(s, "label", TaskType.BINARY, n_tuning_trials=0, trees=5).evaluate(small.filter("label = 1"), small)
    assert one.tstr == {}
    f = fairness.FairnessEvaluator(small, s, FairSpec(["gender", "age"], "label", TaskType.BINARY, True), trees=5).evaluate(small, small)
    assert f.error is None and 0 <= f.delta_dp["gender"] <= 1 and f.nmi["age"] > f.nmi["gender"]
    auc = utility.c2st_auc(small, small.withColumn("age", F.col("age") + 100), s, 2, trees=5)
    assert auc["random_forest"] > 0.95


def test_tuning_draws():
    a, b = (utility.random_draws(utility.SPACES["gbt"], 3, 1) for _ in range(2))
    assert a == b and all(3 <= x["depth"] <= 9 and 100 <= x["rounds"] <= 500 and 0.01 <= x["rate"] <= 0.3 for x in a)


def test_privacy(spark, small):
    with pytest.warns(UserWarning):
        r = neighbors.PrivacyEvaluator(small, DataSchema(small)).evaluate(small)
    assert r.exact_match_rate == 1 and r.dcr_5th == 0
    far = neighbors.PrivacyEvaluator(small, DataSchema(small)).evaluate(small.withColumn("age", F.col("age") + 500))
    assert far.dcr_95th >= far.dcr_5th > 1 and far.exact_match_rate == 0


def test_groups(spark):
    d = spark.createDataFrame([("a", "1", "1")] * 30 + [("a", "0", "1")] * 10 + [("b", "0", "0")] * 40 + [("c", "1", "1")] * 5, "g string, y string, p string")
    cell = fairness.cells(d, "g", "y", "p")
    r = {x["metric"]: x["value"] for x in fairness.disparities(cell, ["1"]).collect()}
    assert r["delta_dp"] == 1 and r["delta_eop"] is None and r["delta_eo"] == 1  # b has no positives
    assert [tuple(x) for x in fairness.valid_groups(cell, 30)[1].collect()] == [("c", 5)]
    assert fairness.collapse_message("g", "c", 5, 30) == "'g'='c': 5 samples < min_group_size=30; excluded (NaN)."
    assert fairness.nmi(d, "g", "y").first()["value"] > 0 and fairness.nmi(d.limit(9), "g", "y").first()["value"] is None
    assert fairness.nmi(d.withColumn("g", F.lit("k")).withColumn("y", F.lit("k")), "g", "y").first()["value"] == 1


# Analysis


def test_profile(spark, small):
    p = profile.DatasetProfiler().profile(small.withColumn("code", (F.col("label") * 2).cast("string")), "small")
    assert (p.n_rows, p.n_columns, p.missing_rate) == (200, 5, 0)
    assert p.columns["gender"].kind == "categorical" and p.columns["code"].kind == "continuous" and ("label", "code", 0.0) in p.fds and "small: 200 rows" in p.summary


def test_bootstrap(spark):
    lo, hi = bootstrap.bootstrap_ci(np.arange(100), np.mean, 300, 0.95, 1)
    assert lo < 49.5 < hi and hi - lo < 20
    assert all(math.isnan(x) for x in bootstrap.bootstrap_mean([]))
    r = bootstrap.table_mean_ci(spark.range(2000), F.col("id"), [F.col("id")], 40).first()
    assert r["lo"] < r["mean"] < r["hi"] and r["hi"] - r["lo"] < 150


def test_significance():
    t = significance.SignificanceTester()
    assert t.test("m", [1, 2, 3, 4, 5], [2, 3, 4, 5, 6]).p_value == pytest.approx(0.0625)
    assert t.test("m", [1, 2, 3, 4, 5], [1, 2, 3, 4, 5]).p_value == 1
    r = t.test("m", [1.0, 2.0, 3.0], [2.0, 4.0, 3.5])
    assert r.method == "paired_t" and r.p_value == pytest.approx(0.11808, abs=1e-4)
    assert t.test("m", [1], [2]).method == "na" and significance.t_p(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    with pytest.raises(ValueError):
        significance.SignificanceTester(1.5)
    with pytest.raises(ValueError):
        t.compare([], [])


def test_holm(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "metric string, p double")
    assert {r["metric"]: r["p_adjusted"] for r in significance.holm_adjust(d).collect()} == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06), "d": None}


def test_leaderboard(spark):
    one = leaderboard.radar_minmax(spark.createDataFrame([("m", "fidelity", 0.7), ("m", "privacy", 0.2)], "model string, axis string, value double"))
    assert {r["axis"]: r["value"] for r in one.collect()} == {"fidelity": 0.0, "privacy": 1.0}
    with pytest.raises(ValueError):
        leaderboard.check_weights({"structural": 1.0})
    with pytest.raises(ValueError):
        leaderboard.ResultAggregator(spark).pareto_data("nothing", "irr")


def test_pipeline_and_bundle(spark, small, tmp_path):
    with pytest.raises(ValueError):
        PipelineConfig(small, dimensions=(1,))
    c = PipelineConfig(small, logic_spec=LogicSpec(known_fds=[("age", "label")]), dimensions=(0, 1, 2, 3, 4, 5), model="m", max_samples=100, trees=3)
    with pytest.warns(UserWarning):
        b = BenchmarkPipeline(c).run(small)
    assert b.dimensions_computed == [0, 1, 2, 4] and b.errors == {"dim3": NO_TARGET, "dim5": NO_SPEC}
    assert b.result0.irr == 0 and b.result1.mean_ks == 0 and b.validate_schema(DataSchema(small))
    b.save(str(tmp_path / "deep" / "b.json"))
    back = ResultBundle.load(str(tmp_path / "deep" / "b.json"))
    assert back.as_dict() == b.as_dict() and "clean_df" not in json.dumps(b.as_dict())
    assert extract(back, "result1.mean_ks") == 0 and raw_scores(back)["irr"] == 0 and tidy(spark, back).count() > 10
    report = significance.SignificanceTester().compare([b], [back], "x", "y")
    assert report.results and "x against y" in report.summary
    agg = leaderboard.ResultAggregator(spark)
    agg.add_model("m", [b, back])
    with pytest.warns(UserWarning):
        assert agg.to_leaderboard(50).count() == 1
    broken = BenchmarkPipeline(c).run(small.drop("age"))
    assert broken.errors["dim1"] == DIM0_FAILED and "SchemaMismatchError" in broken.errors["dim0"]


def test_registered_bundle_is_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(BenchmarkPipeline, "run", lambda self, synth: seen.append(self.config))
    bundle_of(spark, DATA)
    (c,), plain_ = seen, PipelineConfig(None)
    for name in ("dimensions", "max_samples", "max_privacy_rows", "trees", "c2st_trees", "n_tuning_trials", "min_clean_rows"):
        assert getattr(c, name) == getattr(plain_, name), name
    assert c.dimensions == (0, 1, 2, 3, 4, 5) and c.target_col and c.task_type and c.fair_spec
    real = P.li(spark, DATA)[0]
    assert c.test_real_df.count() and c.train_real_df.unionByName(c.test_real_df).exceptAll(real).count() == 0
    assert c.train_real_df.count() + c.test_real_df.count() == real.count()


def test_registered_models_take_the_defaults(spark, monkeypatch):
    from tabscore.plans import catalog

    class Called(Exception):
        pass

    def seen(*args, **kwargs):
        raise Called(args, kwargs)

    for name, module, attribute, most in (("bootstrap_ci", catalog.bootstrap, "table_mean_ci", 3), ("c2st_auc", catalog.utility, "c2st_auc", 3), ("tstr_utility", catalog.utility, "MLUtilityEvaluator", 3), ("fairness_probe", catalog.fairness, "FairnessEvaluator", 3)):
        monkeypatch.setattr(module, attribute, seen)
        with pytest.raises(Called) as e:
            registry.queries()[name](spark, DATA)
        args, kwargs = e.value.args
        assert len(args) <= most and not kwargs, name


# Texts, orders, samples, files, streams


def test_texts(spark):
    d = serialize.with_spans(spark.createDataFrame([(1.0, "x"), (None, None)], "a double, b string"), ["a", "b"]).collect()
    for r, want in zip(d, (["1", "x"], ["nan", "nan"]), strict=True):
        assert [r["sentence"][s["start"] : s["stop"]] for s in r["spans"]] == want
    labels = spark.createDataFrame([("I say NO",), ("maybe yes or no",), ("?",), (None,)], "t string").select(serialize.parse_label(F.col("t"), ["yes", "no", "abc"]).alias("l"))
    assert [r["l"] for r in labels.collect()] == ["no", "no", "abc", "abc"]
    losses = lambda d: d.select(F.lit(1.0).alias("loss"), F.lit(False).alias("masked"))
    assert serialize.MemorizationProbe(["a"], losses).gap(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "a int")) == 0


def test_orders(spark):
    d = spark.range(64).select((F.col("id") % 2).alias("a"), (F.col("id") % 4).alias("b"), (F.col("id") % 8).alias("c"))
    scored = ordering.score_all_permutations(d, ["a", "b", "c"])
    assert len(scored) == 6 and scored[0][1] == pytest.approx(3) and scored[0][2] == pytest.approx(3)
    assert ordering.select_orderings(scored, 2) == [scored[0], scored[-1]]
    assert ordering.dependency_order(["x", "y", "z"], [("z", "x"), ("x", "y")]) == ["z", "x", "y"]


def test_samples(spark, small):
    assert sampling.uniform_sample(small, 50).count() == 50 and sampling.uniform_sample(small, 500).count() == 200
    part = sampling.stratified_subsample(small, 100, "gender")
    assert 60 < part.count() < 140 and sampling.stratified_subsample(small, 100, "no").count() == 100
    assert {r["fold"] for r in sampling.hash_fold(small, 4).select("fold").collect()} == {0, 1, 2, 3}


def test_encoders(spark, small):
    s = DataSchema(small)
    e = encoders.build_feature_encoder(s, small)
    rows = e.features(small.withColumn("gender", F.lit("other"))).select("features").collect()
    assert e.width == 6 and all(len(r[0]) == 6 and r[0][2:4] == [0, 0] for r in rows)


def test_files(spark, small, tmp_path):
    files.write_csv(small.withColumn("x", F.lit(1 / 3)), str(tmp_path / "a.csv"), 4)
    back = files.read_csv(spark, files.find_source(spark, str(tmp_path / "*.csv")))
    assert back.count() == 200 and back.first()["x"] == 0.3333 and dict(files.read_csv(spark, str(tmp_path / "a.csv"), as_text=True).dtypes)["age"] == "string"
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "log.jsonl"), "a int").count() == 2
    files.append_jsonl(spark.range(3), str(tmp_path / "out"))
    files.append_jsonl(spark.range(2), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id long").count() == 5
    with pytest.raises(FileNotFoundError):
        files.find_source(spark, str(tmp_path / "none*"))
    made = []
    for _ in range(2):
        files.cached_table(spark, str(tmp_path / "kept"), lambda: made.append(1) or spark.range(4))
    assert len(made) == 1
    a, b = files.drop_empty(small.withColumn("z", F.lit(None).cast("int")), small.drop("age"))
    assert a.columns == b.columns == ["income", "gender", "label"]
    rates = {k: files.causal_data(spark, 4000, k).agg(F.avg("Default")).first()[0] for k in ("normal", "recession")}
    assert rates["recession"] > rates["normal"]


def test_stream_drift(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "b"), ("2024-01-02 10:00:00", "a"), ("2024-01-05 10:00:00", "a")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    reference = spark.createDataFrame([("a", 1), ("b", 1)], "v string, n long")
    seen = []
    q = drift.stream_drift(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), reference, "ts", "kind", lambda d: seen.extend(d.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r["start"]), r["n"], r["tvd"]) for r in seen) == [("2024-01-01 00:00:00", 2, 0.0), ("2024-01-02 00:00:00", 1, 0.5)]

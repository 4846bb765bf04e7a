"""What has to hold whatever the size of a table: pruned searches, large vocabularies, samples, folds and intervals."""

from __future__ import annotations

import dataclasses
import math
import random
import re
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tabscore.operators import bootstrap, density, encoders, fairness, fidelity, leaderboard, learners, logic, neighbors, ordering, sampling, search, structural, trees, utility
from tabscore.operators import schema as schema_module
from tabscore.operators.schema import DataSchema
from tabscore.operators.specs import FairSpec, LogicSpec, TaskType
from tabscore.plans.bundle import BundleMetadata, ResultBundle
from tabscore.sources import files

# Nearest records


def points(spark, n: int, seed: int, clusters: int = 12):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).uniform(-50, 50, (clusters, 2))
    rows = [(i, [float(x) for x in (centres[i % clusters] + rng.normal(size=2)).round(2)], [int(c) for c in rng.integers(-1, 3, 2)]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, v array<double>, c array<bigint>"), rows


def plain_nearest(left: list, right: list, k: int, skip_self: bool, mixed: bool) -> list[tuple]:
    out = []
    for i, v, c in left:
        found = []
        for j, w, d in right:
            if skip_self and i == j:
                continue
            if mixed:
                distance = sum(abs(x - y) for x, y in zip(v, w, strict=True)) + sum(x != y for x, y in zip(c, d, strict=True))
            else:
                distance = math.sqrt(sum((x - y) ** 2 for x, y in zip(v, w, strict=True)) + sum(0 if x == y else 1 if min(x, y) < 0 else 2 for x, y in zip(c, d, strict=True)))
            found.append((round(distance, 9), j))
        out += [(i, rank + 1, j, d) for rank, (d, j) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("superblocks", [False, True])
@pytest.mark.parametrize(("k", "skip_self", "mixed"), [(1, False, True), (3, False, False), (4, True, False)])
def test_pruned_search_finds_what_all_pairs_have(spark, monkeypatch, k, skip_self, mixed, superblocks):
    monkeypatch.setattr(search, "BLOCK", 16)
    if superblocks:
        monkeypatch.setattr(search, "RESIDENT_BYTES", 0)
        monkeypatch.setattr(search, "SUPERBLOCK_ROWS", 20)
    a, left = points(spark, 150, 1)
    b, right = points(spark, 260, 2)
    if skip_self:
        a, left = b, right
    found = neighbors.nearest(a, b, k, skip_self, "arrow", neighbors.MIXED if mixed else neighbors.EUCLIDEAN)
    assert sorted((r["id"], r["rank"], r["nearest"], round(r["distance"], 9)) for r in found.collect()) == sorted(plain_nearest(left, right, k, skip_self, mixed))


def test_index_finds_what_all_pairs_have_for_ties_copies_and_many_dimensions(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(40):
        n, m, width, codes, k = (int(rng.choice(x)) for x in ([1, 90, 300], [1, 40, 400], [0, 1, 2, 12], [0, 1, 3], [1, 3, 7]))
        metric, skip = (neighbors.EUCLIDEAN, neighbors.MIXED)[trial % 2], bool(trial % 3)
        for name, values in (("BLOCK", [8, 128]), ("CHUNK", [4, 128]), ("FIRST_ROWS", [4, 1024]), ("MATRIX", [50, 2_000_000])):
            monkeypatch.setattr(search, name, int(rng.choice(values)))
        make = lambda rows: (rng.normal(size=(rows, width)).round(int(rng.choice([0, 1, 9]))), rng.integers(-1, 3, (rows, codes)), rng.permutation(rows))
        w, d, ids = make(m)
        v, c, own = (w, d, ids) if skip else make(n)
        index = search.Index(ids, w, d, metric)
        rows, places, far = index.search(own, v, c, k, skip)
        want = []
        for i in range(len(own)):
            s = metric.root(metric.sums(v[i][None], c[i][None], w, d))
            want += [(i, ids[j], s[j]) for j in np.lexsort((ids, s)) if not (skip and ids[j] == own[i])][:k]
        assert list(zip(rows, index.ids[places], far, strict=True)) == want


def test_category_tuples_leave_a_small_share_of_the_pairs(spark):
    """Lines of orders: two numbers and five categories, the kind of table whose rows no pivot tells apart."""
    rng = np.random.default_rng(5)
    line = lambda n: (rng.random((n, 2)), np.stack([rng.integers(0, k, n) for k in (11, 9, 3, 2, 7)], axis=1))
    shares = []
    for n in (5_000, 20_000):
        (v, c), (w, d) = line(n), line(n)
        index = search.Index(np.arange(n), w, d, neighbors.MIXED)
        rows, places, sums = index.search(np.arange(n), v, c, 1, False)
        shares.append(index.compared / n**2)
        for i in rng.choice(n, 200):
            assert np.isclose(sums[i], (np.abs(w - v[i]).sum(axis=1) + (d != c[i]).sum(axis=1)).min())
    assert shares[1] < shares[0] and shares[1] < 0.1


def test_clusters_of_vectors_leave_less_than_a_square_of_work():
    centres = np.random.default_rng(3).normal(size=(60, 64)) * 10
    work = []
    for n in (2_000, 20_000):
        rng = np.random.default_rng(n)
        v, no = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 64)), np.empty((n, 0), np.int64)
        index = search.Index(np.arange(n), v, no, neighbors.EUCLIDEAN)
        index.search(np.arange(n), v, no, 5, True)
        work.append(index.compared)
    assert work[1] < 40 * work[0] and work[1] < 0.2 * 20_000**2


def test_search_without_numbers_or_without_categories_or_rows(spark):
    only = spark.createDataFrame([(i, [i % 3, i % 2]) for i in range(20)], "id int, c array<bigint>").withColumn("v", F.array().cast("array<double>"))
    found = neighbors.nearest(only.filter("id < 3"), only.filter("id >= 3"), 1, False, "arrow", neighbors.MIXED)
    assert {(r["id"], r["nearest"], r["distance"]) for r in found.collect()} == {(0, 6, 0.0), (1, 7, 0.0), (2, 8, 0.0)}
    plain = spark.createDataFrame([(i, [float(i * i)]) for i in range(30)], "id int, x array<double>")
    assert {r["nearest"] for r in neighbors.nearest(plain, plain, 1, True, "arrow").filter("id = 29").collect()} == {28}
    assert neighbors.nearest(plain, plain.limit(0)).count() == 0 and neighbors.nearest(plain.limit(0), plain, strategy="arrow").count() == 0


def test_searches_are_chosen_by_the_size_of_the_right_side_and_can_be_added(spark):
    assert neighbors.route("sql", 100) == "sql" and neighbors.route("sql", neighbors.SQL_ROWS + 1) == "arrow"
    assert neighbors.route("auto") == "arrow" and neighbors.route("auto", 5) == "arrow"
    with pytest.raises(ValueError):
        neighbors.route("no", 5)
    neighbors.register_search("first", lambda left, right, k, skip_self, metric: left.select("id", F.lit(0).alias("nearest"), F.lit(0.5).alias("distance")))
    try:
        d = spark.createDataFrame([(1, [0.0])], "id int, x array<double>")
        assert neighbors.nearest(d, d, strategy="first").first()["distance"] == 0.5
    finally:
        del neighbors.SEARCHES["first"]


# Vocabularies


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(3)
    real = spark.createDataFrame([(f"w{rng.randint(0, 60):03}" if i % 9 else None, i % 50, float(i), "ab"[i % 2]) for i in range(600)], "word string, number int, x double, label string")
    synth = real.withColumn("word", F.when(F.col("x") % 7 == 0, F.concat("word", F.lit("?"))).otherwise(F.col("word")))
    return real, synth.withColumn("number", F.concat(F.col("number") + (F.col("x") % 40 == 1).cast("int") * 100, F.when(F.col("x") % 3 == 0, ".0").otherwise("")))


def test_results_do_not_hang_on_where_a_vocabulary_is_kept(spark, wide, monkeypatch):
    real, synth = wide
    found = []
    for room in (1000, 3):
        monkeypatch.setattr(schema_module, "DRIVER_VOCABULARY", room)
        s = DataSchema(real, categorical_columns=["word", "number"])
        assert (s["word"].categories is None) == (room == 3)
        gate = structural.StructuralInterceptor(s)
        tagged = gate.tagged(synth)
        encoder = encoders.build_feature_encoder(s, real)
        clean = gate.clean(tagged)
        vectors = encoder.vectors(clean).select("x", "features").collect()
        dense = {r["x"]: r["features"] for r in encoder.features(clean).select("x", "features").collect()}
        assert all(r["features"].toArray().tolist() == pytest.approx(dense[r["x"]]) for r in vectors)
        codes = utility.ordinal_features(real, real, s, ["word", "number"]).select("x", "features").collect()
        found.append((
            Counter(r["defect"] for r in tagged.collect()),
            sorted(map(tuple, structural.unknown_values(s, synth).collect())),
            sorted(map(str, clean.collect())),
            {x: [round(v, 9) for v in f] for x, f in dense.items()},
            sorted((r["x"], tuple(r["features"].toArray())) for r in codes),
            [r["n_categories"] for r in s.table().orderBy("position").collect()],
        ))
    assert found[0] == found[1] and found[0][0]["oov_hallucination"] > 50 and found[0][5][0] == 61


def test_c2st_and_manifold_take_any_vocabulary(spark, wide, monkeypatch):
    monkeypatch.setattr(schema_module, "DRIVER_VOCABULARY", 3)
    real = wide[0]
    s = DataSchema(real, categorical_columns=["word"])
    far = real.withColumn("x", F.col("x") + 5000)
    auc = utility.c2st_auc(real, far, s, folds=2, trees=3)
    assert min(auc.values()) > 0.99
    m = neighbors.manifold(real, real, s)
    assert m.alpha_precision == 1.0 and m.beta_recall == 1.0 and m.n_real == 600


def test_each_number_is_parsed_once(spark, wide):
    real, synth = wide
    gate = structural.StructuralInterceptor(DataSchema(real.select("x"), continuous_columns=["x"]))
    plan = gate.clean(gate.tagged(synth.select(F.col("x").cast("string").alias("x"))))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RLIKE", plan)) == 1


# Samples and folds


def test_samples_of_equal_rows_are_neither_all_nor_none(spark):
    d = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("x"))
    out = sampling.uniform_sample(d, 1000)
    assert out.count() == 1000 and 250 < out.filter("x = 0").count() < 420
    assert sampling.uniform_sample(d, 20_000).count() == 20_000


def test_strata_keep_their_shares(spark):
    d = spark.range(10_000).select("id", F.when(F.col("id") < 7000, "a").when(F.col("id") < 9990, "b").when(F.col("id") < 9998, F.lit(None)).otherwise("rare").alias("s"))
    for keys in (None, ["id"]):
        n = Counter(r["s"] for r in sampling.stratified_subsample(d, 1000, "s", keys=keys).collect())
        assert n == {"a": 700, "b": 299, None: 1, "rare": 1}
    assert sampling.stratified_subsample(d, 10_000, "s").count() == 10_000
    again = [sorted(r["id"] for r in sampling.stratified_subsample(x, 500, "s", keys=["id"]).collect()) for x in (d, d.repartition(7))]
    assert again[0] == again[1]


def test_folds_are_balanced_in_every_stratum(spark):
    d = spark.range(1003).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 1000, "b").alias("s"))
    n = Counter((r["s"], r["fold"]) for r in sampling.fold_of(d, 5, "s", [F.xxhash64("id")]).collect())
    assert all(n["a", k] == 140 and n["b", k] == 60 and n[None, k] == (k < 3) for k in range(5))
    assert Counter(r["fold"] for r in sampling.fold_of(d, 4, None, ["id"]).collect()) == {0: 251, 1: 251, 2: 251, 3: 250}


# Intervals


def test_intervals_from_counts_are_those_of_resampled_rows():
    rng = np.random.default_rng(5)
    flags = (rng.random(400) < 0.3).astype(float)
    rows = bootstrap.bootstrap_ci(flags, np.mean, 3000, 0.9, 1)
    counts = bootstrap.proportion_interval(int(flags.sum()), 400, 3000, 0.9, 2)
    assert np.allclose(rows, counts, atol=0.01)
    values = np.sort(rng.exponential(size=400))
    rows = bootstrap.bootstrap_percentile(values, 95, 3000, 0.9, 1)
    lo, hi = bootstrap.percentile_positions(400, 0.95, 3000, 0.9, 2)
    assert np.allclose(rows, np.quantile(values, [lo, hi]), atol=0.2)


def test_resampled_counts_are_poisson_and_repeatable(spark):
    cells = spark.createDataFrame([("a", 1000), ("b", 4)], "g string, n long")
    out = bootstrap.resampled_counts(cells, 300, 3).collect()
    by = {g: [r["n"] for r in out if r["g"] == g] for g in "ab"}
    assert abs(np.mean(by["a"]) - 1000) < 8 and 700 < np.var(by["a"]) < 1350 and abs(np.mean(by["b"]) - 4) < 0.5
    assert sorted(map(str, out)) == sorted(map(str, bootstrap.resampled_counts(cells.repartition(2), 300, 3).collect()))


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(7)
    rows = [(str(g), float(x), "1" if x + 0.8 * (g == 0) > 0.4 else "0") for g, x in zip(rng.integers(0, 3, 500), rng.normal(size=500), strict=True)]
    return spark.createDataFrame(rows, "grp string, x double, y string")


def test_evaluators_give_intervals_around_their_values(spark, people):
    s = DataSchema(people)
    spec = FairSpec(["grp"], "y", TaskType.BINARY)
    r5 = fairness.FairnessEvaluator(people, s, spec, trees=5, n_boot=60).evaluate(people, people)
    assert r5.error is None
    for name in fairness.METRICS:
        lo, hi = getattr(r5, f"{name}_ci")["grp"]
        assert lo < hi and lo - 0.1 <= getattr(r5, name)["grp"] <= hi + 0.1
    number = FairSpec(["grp"], "x", TaskType.REGRESSION)
    gap = fairness.FairnessEvaluator(people, s, number, trees=5, n_boot=40).evaluate(people, people)
    lo, hi = gap.stat_parity_gap_ci["grp"]
    assert gap.error is None and lo < hi and lo - 0.1 <= gap.stat_parity_gap["grp"] <= hi + 0.1
    half = people.filter("x > 0")
    r4 = neighbors.PrivacyEvaluator(people, s, n_boot=80).evaluate(half.withColumn("x", F.when(F.col("x") > 1, F.col("x") + 0.01).otherwise(F.col("x"))))
    assert r4.exact_match_rate_ci[0] < r4.exact_match_rate < r4.exact_match_rate_ci[1] and r4.dcr_95th_ci[0] <= r4.dcr_95th <= r4.dcr_95th_ci[1] + 1e-9
    r1 = fidelity.FidelityEvaluator(people, s, n_boot=50).evaluate(half, c2st=False)
    assert r1.beta_recall_ci[0] <= r1.beta_recall <= r1.beta_recall_ci[1] and r1.alpha_precision_ci is not None
    bundle = ResultBundle(BundleMetadata("m", "d"), result1=r1, result4=r4, result5=r5)
    back = ResultBundle.from_dict(bundle.as_dict())
    assert back.result5.delta_dp_ci == r5.delta_dp_ci and back.result4.dcr_5th_ci == r4.dcr_5th_ci and back.result1.beta_recall_ci == r1.beta_recall_ci


# Models


def test_mixtures_find_clusters_and_never_fail_on_equal_rows(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-4, 1, (300, 2)), rng.normal(5, 0.5, (100, 2))])
    d = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3).persist()
    m = density.fit_mixture(d, 2, 1)
    assert sorted(m.weights.round(2)) == [0.25, 0.75] and sorted(m.means[:, 0].round()) == [-4.0, 5.0]
    true = np.log(0.75 * np.exp(-((x + 4) ** 2).sum(1) / 2) / (2 * np.pi) + 0.25 * np.exp(-((x - 5) ** 2).sum(1) / 0.5) / (0.5 * np.pi))
    assert abs(m.log_density(x).mean() - true.mean()) < 0.05
    assert len(density.select_mixture(d, 1).weights) == 2
    same = spark.createDataFrame([([1.0, 2.0],)] * 40 + [([3.0, 2.0],)] * 40, "x array<double>")
    assert np.isfinite(density.fit_mixture(same, 5, 1).log_density(np.array([[1.0, 2.0]]))).all()


def test_mixtures_are_fitted_together_and_summed_by_spark(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(-4, 1, (200, 2)), rng.normal(5, 0.5, (100, 2))])
    d = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    few, many = (density.fit_mixtures(d.repartition(n), (1, 2, 3), 1, 30) for n in (2, 9))
    for k in (1, 2, 3):
        assert np.allclose(few[k][0].means, many[k][0].means) and few[k][1] == pytest.approx(many[k][1]) and few[k][2] == 300
    assert few[1][0].means[0] == pytest.approx(x.mean(axis=0)) and few[1][0].covariances[0] == pytest.approx(np.cov(x.T, bias=True))
    assert few[2][1] == pytest.approx(few[2][0].log_density(x).mean()) and few[2][1] > few[1][1] + 0.5


# Dependencies, orders, resamples, files


def test_composite_dependencies_are_those_of_all_tries(spark):
    rng = random.Random(3)
    for trial in range(3):
        rows = [(rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 2), i if trial else rng.randint(0, 5)) for i in range(60)]
        rows = [(a, b, c, a * 10 + b if rng.random() < 2 or trial else 0, str((a + c) % 3), k) for a, b, c, k in rows]
        columns = list("abcdef")
        df = spark.createDataFrame([tuple(None if v == 3 else v for v in r) for r in rows], "a int, b int, c int, d int, e string, f int")
        table = [tuple(None if v == 3 else v for v in r) for r in rows]
        holds = lambda s, d: len({tuple(r[i] for i in s) for r in table}) == len({tuple(r[i] for i in (*s, d)) for r in table})  # noqa: E731, B023
        want = set()
        for size in (1, 2, 3):
            for dets in combinations(range(6), size):
                for dep in set(range(6)) - set(dets):
                    if holds(dets, dep) and not any(holds(s, dep) for k in range(1, size) for s in combinations(dets, k)):
                        want.add((tuple(columns[i] for i in dets), columns[dep]))
        assert set(logic.composite_fds(df, columns, sample_rows=(60, 10, 0)[trial])) == want and len(want) > 2
    assert logic.composite_fds(df.limit(0), columns) == []
    order = ordering.composite_order(columns, [(("e", "f"), "a"), (("a",), "b")])
    assert order.index("e") < order.index("a") < order.index("b") and order.index("f") < order.index("a")


def test_best_order_by_subsets_is_that_of_all_orders(spark):
    rng = np.random.default_rng(7)
    for n in (1, 2, 4, 6):
        for _ in range(5):
            first, step = rng.random(n) * 3, rng.random((n, n))
            order, total = ordering.cheapest_path(first, step)
            every = [first[p[0]] + sum(step[a, b] for a, b in zip(p, p[1:], strict=False)) for p in permutations(range(n))]
            assert total == pytest.approx(min(every)) and sorted(order) == list(range(n))
            assert first[order[0]] + sum(step[a, b] for a, b in zip(order, order[1:], strict=False)) == pytest.approx(total)
    d = spark.createDataFrame([(i % 2, i % 4, i % 3, i % 5) for i in range(60)], "a int, b int, c int, d int")
    best, ce = ordering.best_order(d, ["a", "b", "c", "d"])
    assert ce == pytest.approx(min(c for _, c, _ in ordering.score_all_permutations(d, ["a", "b", "c", "d"])))
    with pytest.raises(ValueError, match="too many orders"):
        ordering.score_all_permutations(d, [f"c{i}" for i in range(9)])
    with pytest.raises(ValueError, match="at most"):
        ordering.best_order(d, [f"c{i}" for i in range(17)])


def test_resampled_statistics_of_tables(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(10, 2, 400).round(3)
    y = (x + rng.normal(0, 1, 400)).round(3)
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, x double, y double")
    d = d.unionByName(spark.createDataFrame([(1000, None, 1.0)], d.schema))
    for statistic, value, spread in ((bootstrap.mean_of(F.col("x")), x.mean(), 2 / 20), (bootstrap.median_of(F.col("x")), np.median(x), 2 * 1.25 / 20), (bootstrap.correlation_of(F.col("x"), F.col("y")), np.corrcoef(x, y)[0, 1], (1 - 0.8) / 20)):
        got, lo, hi = bootstrap.table_bootstrap(d, statistic, [F.col("id")], 60)
        assert got == pytest.approx(value) and lo < got < hi and spread < hi - lo < 8 * spread
    one = bootstrap.replicates_of(d.repartition(5), bootstrap.mean_of(F.col("x")), [F.col("id")], 7, at_once=3)
    two = bootstrap.replicates_of(d, bootstrap.mean_of(F.col("x")), [F.col("id")], 7)
    assert len(one) == 8 and np.allclose(one, two)


def test_cached_tables_are_published_whole_and_by_their_inputs(spark, tmp_path):
    source, at, made = str(tmp_path / "in"), str(tmp_path / "kept"), []
    spark.range(3).write.parquet(source)

    def fail():
        bad = F.udf(lambda i: 1 // (i - 2), "int")
        return spark.read.parquet(source).select(bad("id").alias("v"))

    with pytest.raises(Exception, match="ZeroDivision|Python"):
        files.cached_table(spark, at, fail, [source])
    make = lambda: made.append(1) or spark.read.parquet(source)
    for _ in range(2):
        assert files.cached_table(spark, at, make, [source]).count() == 3
    assert files.cached_table(spark, at, make, [source], key="other").count() == 3
    spark.range(4).write.mode("append").parquet(source)
    assert files.cached_table(spark, at, make, [source]).count() == 7 and len(made) == 3


def test_bundles_are_a_table_in_any_file_system(spark, tmp_path):
    from tabscore.operators.structural import Dim0Result
    from tabscore.plans.bundle import read_bundles

    for i in range(3):
        result = Dim0Result(**{f.name: (0.1 * i if f.name == "irr" else None) for f in dataclasses.fields(Dim0Result)})
        ResultBundle(BundleMetadata(f"m{i}", "d"), result0=result).save(f"file://{tmp_path}/deep/m{i}.json")
    t = read_bundles(spark, f"file://{tmp_path}/deep/*.json")
    assert {(r["model"], round(r["value"], 3)) for r in t.filter("metric = 'irr'").collect()} == {("m0", 0.0), ("m1", 0.1), ("m2", 0.2)}
    assert t.filter("metric = 'mean_ks' and value is null").count() == 3
    assert ResultBundle.load(f"file://{tmp_path}/deep/m1.json").metadata.model == "m1"
    with pytest.raises(Exception, match="m9"):
        ResultBundle.load(f"file://{tmp_path}/deep/m9.json")


def test_numeric_utility_has_an_upper_bound(spark, people):
    s = DataSchema(people)
    noise = people.withColumn("x", F.rand(3))
    out = utility.numeric_utility(noise, people, people, s, "y", trees=10)
    assert out["real"] > 0.75 > out["tstr"]
    assert utility.numeric_utility(people.filter("y = '1'"), people, people, s, "y", trees=2)["tstr"] is None


def test_parzen_search_draws_where_trials_were_good():
    rng, space = np.random.default_rng(4), {"a": ("uniform", 0.0, 10.0), "b": ("log", 1e-4, 1.0), "c": ("choice", "x", "y", "z"), "d": ("int", 1, 9)}
    value = lambda p: -abs(p["a"] - 7) - abs(np.log10(p["b"]) + 2) + (p["c"] == "y") - abs(p["d"] - 3)
    tried = []
    for _ in range(60):
        p = utility.parzen_draw(space, tried, rng)
        assert 0 <= p["a"] <= 10 and 1e-4 * 0.999 <= p["b"] <= 1.001 and p["c"] in "xyz" and p["d"] in range(1, 10)
        tried.append((p, value(p)))
    late, early = ([v for _, v in part] for part in (tried[-20:], tried[:10]))
    assert np.mean(late) > np.mean(early) + 2 and max(late) > max(early)


@pytest.mark.parametrize("large", [False, True])
def test_models_that_cannot_be_fitted_say_why(spark, people, monkeypatch, large):
    monkeypatch.setattr(utility, "models", lambda task: ("bad", "logistic"))
    if large:
        monkeypatch.setattr(learners, "TASK_ROWS", 0)
    r = utility.MLUtilityEvaluator(DataSchema(people), "y", TaskType.BINARY, n_tuning_trials=0, trees=3).evaluate(people, people)
    assert r.tstr["bad"] == {"macro_f1": None, "roc_auc": None} and "KeyError" in r.errors["synth/bad"]
    assert r.tstr["logistic"]["roc_auc"] > 0.5 and list(r.errors) == ["synth/bad"]


# Trees and trials


def best_split(bins: np.ndarray, stats: np.ndarray, ridge: float) -> float:
    """The gain of the best split, by trying all."""
    score = lambda s: (s[:-1] ** 2).sum() / (s[-1] + ridge + 1e-12)
    whole = stats.sum(axis=0)
    out = 0.0
    for j in range(bins.shape[1]):
        for limit in np.unique(bins[:, j]):
            left = stats[bins[:, j] <= limit].sum(axis=0)
            if min(left[-1], whole[-1] - left[-1]) >= 1:
                out = max(out, score(left) + score(whole - left) - score(whole))
    return out


def test_trees_split_where_all_tries_say(spark):
    rng = np.random.default_rng(2)
    for trial in range(20):
        n = int(rng.integers(4, 200))
        bins = rng.integers(0, trees.BINS, (n, 3)).astype(np.uint8)
        labels = rng.integers(0, 3, n)
        stats = np.concatenate([np.eye(3)[labels], np.ones((n, 1))], axis=1)
        g = trees.Growth(depth=4, ridge=0.0)
        locals_ = trees.Local(bins, stats), trees.Local(bins, None, labels, 3)
        one, two = (trees.grow(x.sums, x.split, g, np.random.default_rng(1), 3) for x in locals_)
        assert one.feature == two.feature and one.bin == two.bin and np.allclose(np.array(one.value), np.array(two.value))
        assert (locals_[0].node == one.leaves(bins)).all()
        # Of every inner node, the split is the best of all; a leaf's value is its mean.
        rows = {0: np.arange(n)}
        for node, (f, limit, left) in enumerate(zip(one.feature, one.bin, one.left, strict=True)):
            own = rows[node]
            assert np.allclose(one.value[node], np.eye(3)[labels[own]].mean(axis=0))
            if f >= 0:
                went = bins[own, f] > limit
                rows[left], rows[left + 1] = own[~went], own[went]
                score = lambda s: (s[:-1] ** 2).sum() / s[-1]
                gain = sum(score(stats[r].sum(axis=0)) for r in (own[~went], own[went])) - score(stats[own].sum(axis=0))
                assert gain == pytest.approx(best_split(bins[own], stats[own], 0.0))


@pytest.mark.parametrize("n_classes", [0, 2, 3])
def test_histograms_of_spark_grow_the_trees_of_a_task(spark, n_classes, monkeypatch):
    monkeypatch.setattr(trees, "REFRESH", 2)
    rng = np.random.default_rng(n_classes)
    x = rng.normal(size=(400, 3))
    z = x[:, 0] * x[:, 1] + x[:, 2]
    y = (np.digitize(z, [0.0, 1.0][: max(0, n_classes - 1)]) if n_classes else z).astype(float)
    df = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    binner = trees.Binner.of_rows(x)
    growth = trees.Growth(depth=2)
    here = trees.boost(binner.bins(x), y, n_classes, 3, 0.5, growth=growth)
    there = trees.spread_boost(trees.quantised(df, binner), 3, n_classes, 3, 0.5, growth=growth)
    a, b = here.predict(binner.bins(x)), there.predict(binner.bins(x))
    assert a.shape == (400, max(1, n_classes)) and np.allclose(a, b)
    assert not n_classes or (a.argmax(axis=1) == y).mean() > 0.6
    close = trees.Binner.of(df, 3)
    assert all(abs(len(e) - len(f)) <= 1 for e, f in zip(close.edges, binner.edges, strict=True))


@pytest.mark.parametrize("task", [TaskType.BINARY, TaskType.REGRESSION])
def test_models_of_tasks_and_of_spark_score_alike(spark, monkeypatch, task):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), "uvw"[c], str(int(a + b > 0) + (int(b > 1) if task is TaskType.MULTI else 0)), float(a - b + c)) for a, b, c in zip(rng.normal(size=400), rng.normal(size=400), rng.integers(0, 3, 400), strict=True)]
    target = "t" if task is TaskType.REGRESSION else "y"
    df = spark.createDataFrame(rows, "a double, b double, c string, y string, t double").drop("y" if target == "t" else "t")
    s = DataSchema(df)
    found = []
    for limit in (100_000, 0):
        monkeypatch.setattr(learners, "TASK_ROWS", limit)
        r = utility.MLUtilityEvaluator(s, target, task, n_tuning_trials=0, trees=3).evaluate(df, df)
        assert not r.errors
        found.append(r.tstr)
    assert set(found[0]) == set(utility.models(task))
    for name in found[0]:
        for score in found[0][name]:
            assert found[0][name][score] == pytest.approx(found[1][name][score], abs=0.2), (name, score)


@pytest.mark.parametrize("search", ["random", "tpe"])
def test_trials_of_all_models_and_folds_are_tasks_of_few_jobs(spark, monkeypatch, search):
    monkeypatch.setattr(utility, "SPACES", {"gbt": {"rounds": ("int", 1, 4), "depth": ("int", 1, 3)}, "logistic": {"c": ("log", 1e-3, 10.0)}})
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([([float(a), float(b)], float(a + b > 0)) for a, b in x], "features array<double>, y double")
    calls = []
    at_once = learners.at_once
    monkeypatch.setattr(learners, "at_once", lambda spark, jobs, *rest: calls.append(len(jobs)) or at_once(spark, jobs, *rest))
    best = utility.tuned(("gbt", "logistic"), df, TaskType.BINARY, 2, 12, 3, 1, search)
    assert set(best) == {"gbt", "logistic"} and sum(calls) == 2 * 12 * 3 and len(calls) == (1 if search == "random" else 2)
    again = utility.tuned(("gbt", "logistic"), df.repartition(5), TaskType.BINARY, 2, 12, 3, 1, search)
    assert best == again


def test_scores_of_arrays_are_those_of_tables(spark):
    rng = np.random.default_rng(9)
    y, p, s = rng.integers(0, 3, 200), rng.integers(0, 3, 200), rng.normal(size=200).round(1)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(y, p, s, strict=True)], "y int, p int, s double")
    assert learners.f1_of(y, p) == pytest.approx(utility.macro_f1(df, "y", "p").first()["value"])
    assert learners.auc_of(y == 1, s) == pytest.approx(utility.rank_auc(df, F.col("y") == 1, "s").first()["value"])
    x = rng.normal(size=(300, 2))
    m = learners.logistic(x, (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float), 2, 1.0)
    assert (m.predict(x).argmax(axis=1) == (x[:, 0] > 0)).mean() > 0.9


def test_targets_of_too_many_labels_are_named(spark, monkeypatch):
    monkeypatch.setattr(utility, "MOST_CLASSES", 3)
    with pytest.raises(ValueError, match="more than 3 labels"):
        utility.classes_of(spark.createDataFrame([(str(i),) for i in range(5)], "label string"))


def test_pareto_front_over_many_ranges_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(f"m{i}", float(rng.randint(0, 60)), float(rng.randint(0, 60))) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        found = {r["model"]: r["is_optimal"] for r in leaderboard.pareto_front(spark.createDataFrame(rows, "model string, x double, y double")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == {m: not any(u >= x and v >= y and (u > x or v > y) for _, u, v in rows) for m, x, y in rows}


def test_constraints_of_a_callers_own_kind(spark, people):
    logic.register_constraint("below", lambda real, column, most: F.col(column) > most)
    spec = LogicSpec(constraints=[("below", "x", 0.0), ("below", "x", 99.0)])
    r = logic.LogicEvaluator(people, DataSchema(people), spec).evaluate(people, density=False)
    share = people.filter("x > 0").count() / 500
    assert r.constraints == {"below(x, 0.0)": pytest.approx(share), "below(x, 99.0)": 0.0} and r.constraints_overall == pytest.approx(share)
    with pytest.raises(ValueError):
        logic.constraint_rates(people, people, [("no", "x")])


def test_orders_by_dependencies(spark):
    d = spark.range(200).select((F.col("id") % 3).alias("city"), (F.col("id") % 9).alias("zip"), F.col("id").alias("age"))
    order = ordering.discover_fd_order(d.select("city", "zip"))
    assert order == ["zip", "city"] and sorted(ordering.discover_fd_order(d, max_rows=150)) == ["age", "city", "zip"]
    e = ordering.ordering_effect(spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(9)], "ce double, value double")).first()
    assert (e["n"], round(e["slope"], 9), round(e["intercept"], 9), round(e["r"], 9)) == (9, 3.0, 1.0, 1.0)


def test_public_names_and_the_interface_of_models(spark):
    import tabscore

    assert all(getattr(tabscore, name).__name__ == name for name in tabscore.__all__)
    with pytest.raises(AttributeError):
        tabscore.nothing
    with pytest.raises(TypeError):
        tabscore.BaseTabularModel()
    calls = []

    class Half(tabscore.BaseTabularModel):
        def fit(self, train_df):
            calls.append("fit")
            self.rows = train_df
            return self

        def sample(self, n_samples):
            calls.append("sample")
            return self.rows.limit(n_samples)

    assert Half().fit_sample(spark.range(9), 2).count() == 2 and calls == ["fit", "sample"]
    with pytest.raises(NotImplementedError):
        Half().save("x")


def test_config_sink_and_order_of_bundles(spark, tmp_path):
    settings = {"a": {"epochs": 3, "name": "x'y"}, "b": {}}
    files.write_config(spark, str(tmp_path / "c" / "config.py"), "CONFIGS", settings)
    scope: dict = {}
    exec((tmp_path / "c" / "config.py").read_text(), scope)
    assert scope["CONFIGS"] == settings
    bundles = [ResultBundle(BundleMetadata(m, d)) for m, d in (("b", "x"), ("a", "z"), ("a", "y"))]
    assert [(b.metadata.model, b.metadata.dataset) for b in leaderboard.in_order(bundles)] == [("a", "y"), ("a", "z"), ("b", "x")]


def test_rows_of_the_structural_model_follow_from_their_keys(spark):
    df = spark.range(3000).withColumn("balance", (F.col("id") % 7).cast("double") - 3)
    one = {tuple(r) for r in files.causal_rows(df, ["id"]).collect()}
    assert one == {tuple(r) for r in files.causal_rows(df.repartition(7, "balance"), ["id"]).collect()}
    assert one != {tuple(r) for r in files.causal_rows(df, ["id"], seed=100).collect()}
    given = files.causal_rows(df.withColumn("balance", F.when(F.col("id") > 0, F.col("balance"))), ["id"], "recession", F.col("balance")).collect()
    assert all(r["Income"] == max(10_000, 35_000 + 15_000 * (r["balance"] or 0)) and 300 <= r["Credit_Score"] <= 850 and r["Loan_Amount"] >= 1_000 for r in given)
    income = files.causal_data(spark, 20_000).agg(F.avg("Income").alias("m"), F.stddev("Income").alias("s")).first()
    assert abs(income["m"] - 50_000) < 600 and abs(income["s"] - 15_000) < 400
    with pytest.raises(ValueError, match="scenario"):
        files.causal_rows(df, ["id"], "boom")

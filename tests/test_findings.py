"""Small cases of findings: what a table's partitions, sizes and copies must not change."""

from __future__ import annotations

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabscore.llm import ngram_join
from tabscore import registry
from tabscore.operators import bootstrap, leaderboard, learners, neighbors, profile, search, trees, utility
from tabscore.operators.schema import DataSchema
from tabscore.operators.specs import FairSpec, TaskType
from tabscore.plans.pipeline import BenchmarkPipeline, PipelineConfig


def test_means_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    x = [rng.choice((0.07, 0.01, 0.03, 1e6 + 0.1, -0.02)) for _ in range(3000)]
    want = math.fsum(x) / len(x)
    d = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    for n in (1, 3, 16):
        got = profile.profile_numeric(d.repartition(n), ["x"]).first()
        assert got["mean"] == want and got["n"] == len(x)
    none = profile.profile_numeric(d.filter("x is null"), ["x"]).first()
    assert none["mean"] is None and none["n"] == 0
    assert profile.profile_numeric(spark.createDataFrame([(0.0,), (float("inf"),)], "x double"), ["x"]).first()["mean"] == float("inf")


def test_means_of_runs_do_not_depend_on_their_order(spark):
    rng = random.Random(2)
    rows = [(m, i, k, rng.choice((0.1, 0.7, -0.3, 1e9 + 0.1, 3e-7, 0.0))) for m in "ab" for k in ("irr", "utility") for i in range(200)] + [("a", 0, "none", None)]
    want = {(m, k): (math.fsum(v) / len(v), len(v)) for m in "ab" for k in ("irr", "utility") for v in ([r[3] for r in rows if r[0] == m and r[2] == k],)} | {("a", "none"): (None, 0)}
    found = []
    for seed in (1, 2, 3):
        rng.shuffle(rows)
        got = leaderboard.mean_metrics(spark.createDataFrame(rows, "model string, run int, metric string, value double").repartition(2 + seed))
        found.append({(r["model"], r["metric"]): (r["value"], r["n"]) for r in got.collect()})
    assert found[0] == found[1] == found[2] and found[0].keys() == want.keys()
    for k, (value, n) in want.items():
        assert found[0][k][1] == n and (found[0][k][0] is value or math.isclose(found[0][k][0], value, rel_tol=1e-15))
    assert leaderboard.mean_metrics(spark.createDataFrame([("a", i, "x", float("inf")) for i in range(2)], "model string, run int, metric string, value double")).first()["value"] == float("inf")


def test_quantiles_of_resamples_are_those_of_their_rows(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BINS", 8)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 5, 300).round(1), np.full(90, 2.5), [1e6, -1e6]])
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "id int, x double").repartition(3)
    statistic = bootstrap.Statistic((F.col("x"),), lambda s: s[0] + 1000 * s[2] + 1e6 * s[3], ((F.col("x"), (0.25, 0.9)),))
    got = bootstrap.replicates_of(d, statistic, [F.col("id")], 9, at_once=4)
    keys = np.array([r["k"] for r in d.filter("x is not null").select("id", F.xxhash64(F.lit(42), "id").alias("k")).orderBy("id").collect()])
    weights = bootstrap.weights_of(keys, np.arange(-1, 9))
    assert set(np.unique(weights[:, 1:])) >= {0, 1, 2, 3} and 0.9 < weights[:, 1:].mean() < 1.1
    for b in range(-1, 9):
        rows = np.repeat(x, weights[:, b + 1].astype(int))
        assert got[b] == pytest.approx(rows.sum() + 1000 * np.quantile(rows, 0.25) + 1e6 * np.quantile(rows, 0.9))
    assert np.isnan(bootstrap.replicates_of(d.filter("x is null"), bootstrap.median_of(F.col("x")), [F.col("id")], 2)).all()


def test_resamples_of_many_different_values_are_few_rows(spark):
    """Each value used to be a row of a sum for each replicate, and a map of all values on one task."""
    d = spark.range(200_000).select("id", F.rand(1).alias("x"))
    value, lo, hi = bootstrap.table_bootstrap(d, bootstrap.median_of(F.col("x")), [F.col("id")], 40)
    assert lo < value < hi < lo + 0.01


@pytest.mark.parametrize("n_classes", [2, 3])
def test_trees_of_counted_rows_are_those_of_all_rows(spark, monkeypatch, n_classes):
    rng = np.random.default_rng(n_classes)
    x = rng.integers(0, 6, (900, 3)).astype(float)
    y = np.digitize(x[:, 0] * 2 + x[:, 1] + rng.normal(0, 1, 900), [6.0, 11.0][: n_classes - 1]).astype(float)
    df = spark.createDataFrame([(list(map(float, r)), float(t)) for r, t in zip(x, y, strict=True)], "features array<double>, y double").repartition(3)
    want = learners.fit_rows("gbt", {"rounds": 4}, x, y, n_classes, 1).predict(x)
    monkeypatch.setattr(learners, "TASK_ROWS", 800)
    monkeypatch.setattr(learners, "fit_spread", lambda *a: pytest.fail("fitted by one job a level"))
    assert not learners.fits_a_task(df)
    models = learners.fit_all(spark, {"a": df}, [("a", "gbt", {"rounds": 4}), ("a", "random_forest", {"trees": 20, "depth": 5}), ("a", "gbt", {"rounds": 4, "subsample": 0.6})], n_classes, 1)
    assert all(error is None for _, error in models)
    boosted, forest, some = (m.model.predict(x) for m, _ in models)
    assert np.allclose(boosted, want)
    plain = learners.fit_rows("random_forest", {"trees": 20, "depth": 5}, x, y, n_classes, 1).predict(x)
    assert np.abs(forest - plain).mean() < 0.05 and np.abs(some - want).mean() < 0.1
    monkeypatch.setattr(learners, "CELLS", 0)
    assert learners.counted(df) is None


def test_distances_of_copies_are_looked_for_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(0, 40)), "uvw"[rng.integers(0, 3)]) for _ in range(60)]
    real, synth = spark.createDataFrame(rows[:30], "x double, c string"), spark.createDataFrame(rows[20:] * 50 + [(None, None)] * 3, "x double, c string")
    s, looked = DataSchema(real), []
    nearest = neighbors.nearest
    monkeypatch.setattr(neighbors, "nearest", lambda left, *rest: looked.append(left.count()) or nearest(left, *rest))
    counts = neighbors.dcr_counts(real, synth, s)
    assert looked[0] == len(set(rows[20:])) + 1
    each = neighbors.dcr_rows(real, synth.withColumn("id", F.monotonically_increasing_id()), s, "id")
    for statistic in (neighbors.dcr_percentiles, neighbors.exact_match_rate):
        assert tuple(statistic(counts).first()) == pytest.approx(tuple(statistic(each).first()))
    assert neighbors.dcr_intervals(counts, 50)["dcr_5th"] == pytest.approx(neighbors.dcr_intervals(each, 50)["dcr_5th"])
    assert neighbors.dcr_percentiles(counts.filter("dcr < 0")).first()["n"] == 0


def test_sets_of_a_batch_are_counted_in_little_memory():
    """Sets are made of a few rows at a time, and what is held to count their shingles doesn't grow with a batch's rows."""
    rng = random.Random(4)
    common = " ".join(f"c{i}" for i in range(60))
    texts = [" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(400)) + (f" {common}" if i % 500 == 0 else "") for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    rows = [r for b in ngram_join.member_rows(iter([batch])) for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 4)), strict=True)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[:2] for r in rows] == [(i, 396 + (60 if i % 500 == 0 else 0)) for i in range(len(texts))]
    marks = [set(r[2]) for r in rows if r[2] is not None]
    shared = {int(h >> np.uint64(64 - ngram_join.MOST_BITS)) for h in ngram_join.shingles(common.encode(), ngram_join.WordHashes())}
    assert marks and set().union(*marks) == shared
    assert most < 50 << 20


@pytest.mark.parametrize("metric", [neighbors.EUCLIDEAN, neighbors.MIXED])
def test_searching_an_index_takes_little_memory_besides_it(metric):
    """Rows that meet all others compare them in parts; the same nearest rows, ties by id."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(30_000, 64))
    v[20_000:] = v[:10_000]
    ids, c = np.arange(len(v)), np.empty((len(v), 0), np.int64)
    index = search.Index(ids, v, c, metric)
    tracemalloc.start()
    rows, places, far = index.search(ids[:40], v[:40], c[:40], 3, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in range(40):
        gaps = v[i] - v
        d = np.sqrt((gaps * gaps).sum(axis=1)) if metric.power == 2 else np.abs(gaps).sum(axis=1)
        d[i] = np.inf
        assert index.ids[places[rows == i]].tolist() == np.lexsort((ids, d))[:3].tolist()
    assert most < 24 << 20
    assert sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray)) < 1.3 * v.nbytes


def test_a_failure_is_no_result(spark, monkeypatch):
    """Models that fail in the tasks used to leave rows of what was known without them, with nothing to tell."""
    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(utility, "fit_all", lambda spark, sides, jobs, *rest: [(None, "MemoryError: gbt")] * len(jobs))
    for name in ("fairness_probe", "tstr_utility"):
        monkeypatch.setattr(utility, "tuned", lambda names, *rest: {n: {} for n in names})
        with pytest.raises(RuntimeError, match="MemoryError: gbt"):
            registry.queries()[name](spark, data)
    rows = spark.createDataFrame([(float(i % 7), "ab"[i % 2], "uv"[i % 3 % 2]) for i in range(200)], "x double, g string, y string")
    config = PipelineConfig(rows, rows, target_col="y", task_type=TaskType.BINARY, dimensions=(0, 3, 5), fair_spec=FairSpec(["g"], "y", TaskType.BINARY))
    out = BenchmarkPipeline(config).run(rows)
    assert "MemoryError" in out.errors["dim3"] and "MemoryError" in out.errors["dim5"]
    assert out.result5.nmi and "failed" in out.result5.summary
    monkeypatch.setattr(utility, "at_once", lambda spark, jobs, *rest: [(0.5, None)] * (len(jobs) - 1) + [(None, "MemoryError: a fold")])
    with pytest.raises(RuntimeError, match="fold 4: MemoryError"):
        utility.c2st_auc(rows, rows, DataSchema(rows))
    monkeypatch.setattr(BenchmarkPipeline, "run", lambda self, synth: out)
    with pytest.raises(RuntimeError, match="dim5"):
        registry.queries()["pipeline_bundle"](spark, data)


@pytest.mark.parametrize("sent", [4, 0])
def test_rows_are_sent_to_superblocks_that_they_need(spark, monkeypatch, sent):
    """Pairs of superblocks, with all rows of both, used to be shuffled; now a left row is, to where it may find more."""
    for name, value in (("RESIDENT_BYTES", 0), ("SUPERBLOCK_ROWS", 64), ("BLOCK", 16), ("SENT", sent)):
        monkeypatch.setattr(search, name, value, raising=False)
    rng = np.random.default_rng(6)
    n = 2000 if sent else 300
    v, c = rng.random((2 * n, 2)).round(2), np.stack([rng.integers(0, 3, 2 * n), rng.integers(0, 9, 2 * n)], axis=1)
    v[:9], c[n - 9 : n] = 0.5, 99
    df = spark.createDataFrame([(i, *map(float, x), *map(int, y)) for i, (x, y) in enumerate(zip(v, c, strict=True))], "id bigint, a double, b double, p bigint, q bigint")
    rows = df.select("id", F.array("a", "b").alias("v"), F.array("p", "q").alias("c")).repartition(4).persist()
    left, right = rows.filter(f"id < {n}"), rows.filter(f"id >= {n}")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    rows.count()
    before = written()
    found = {r["id"]: (r["nearest"], r["distance"]) for r in neighbors.nearest(left, right, 1, False, "arrow", neighbors.MIXED).collect()}
    shuffled = written() - before
    d = np.abs(v[:n, None] - v[None, n:]).sum(axis=2) + (c[:n, None] != c[None, n:]).sum(axis=2)
    assert len(found) == n and all(found[i][1] == pytest.approx(d[i].min()) and d[i, found[i][0] - n] == pytest.approx(d[i].min()) for i in range(n))
    assert shuffled < 280 * n


def test_trees_sum_up_no_more_than_they_need(monkeypatch):
    """The last level takes its rows' sums from one feature, and a forest's drawn rows are counted; the same trees."""
    rng = np.random.default_rng(7)
    bins = rng.integers(0, [32, 9, 3, 2], (4000, 4)).astype(np.uint8)
    y = (bins[:, 0] + 4 * bins[:, 2] + rng.normal(0, 4, 4000) > 20).astype(float)
    looked, cells_of = [], trees.Local.cells_of
    monkeypatch.setattr(trees.Local, "cells_of", lambda self, at, rows, *rest: looked.append(len(rows) * (rest[1] if len(rest) > 1 else bins.shape[1])) or cells_of(self, at, rows, *rest))
    boosted = trees.boost(bins, y, 2, 2, 0.3, 1.0, trees.Growth(3), 1)
    assert sum(looked) <= 2 * bins.size * (1 + 2 / 2) + 2 * len(bins)
    looked.clear()
    grown = trees.forest(bins, y, 2, 2, trees.Growth(0, ridge=0.0), 1)
    assert sum(looked) < 2 * 0.7 * len(bins)
    assert [t.value[0].tolist() for t in grown.trees] == [pytest.approx([1 - y[r].mean(), y[r].mean()]) for r in (lambda g: (g.integers(0, 4000, 4000), g.permutation(4), g.integers(0, 4000, 4000)))(np.random.default_rng(1))[::2]]
    # A plain version of the first tree's first split.
    left = np.array([[(bins[:, j] <= b) for b in range(31)] for j in range(4)])
    r, h = y - 0.5, np.full(4000, 0.25)
    score = lambda m: (m @ r) ** 2 / (m @ h + 1)
    gain = np.where((left @ h >= 1) & (~left @ h >= 1), score(left) + score(~left), -np.inf)
    first = boosted.rounds[0][0]
    assert gain[first.feature[0], first.bin[0]] == pytest.approx(gain.max())

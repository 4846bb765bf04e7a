"""Machine-learning utility: train on synthetic, test on real; two-sample classifier tests; the scores themselves."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.functions.canon import canon, ingest, ratio
from tabscore.functions.stable import stable, written
from tabscore.operators.encoders import build_feature_encoder, coded_by, most_frequent, moments, ordinal
from tabscore.operators.learners import SPACES, TUNING_ROWS, at_once, auc_of, fit_all, fit_rows, fit_spread, fits_a_task, gathered, trial_values
from tabscore.operators.sampling import fold_of, uniform_sample
from tabscore.operators.schema import DataSchema
from tabscore.operators.specs import TaskType

#: The most labels that a target may have: their list goes to the driver and into expressions.
MOST_CLASSES = 1_000
#: Of a Parzen search: trials drawn at random first, the share of trials that count as good, candidates a draw, draws at once.
FIRST_TRIALS, GOOD_SHARE, CANDIDATES, AT_ONCE = 10, 0.25, 24, 8
#: The settings of the classifiers that tell real rows from synthetic ones.
C2ST = {"gbt": {"rounds": 300, "depth": 6, "rate": 0.05}, "random_forest": {"trees": 300, "depth": 10}}

# Scores


def confusion(df: DataFrame, y: str = "label", pred: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def macro_f1(df: DataFrame, y: str = "label", pred: str = "prediction") -> DataFrame:
    """(value): the mean of F1 over the labels that are true or predicted somewhere; 0 where a label has no hits."""
    cm = confusion(df, y, pred)
    parts = cm.select(F.inline(F.array(*[F.struct(c.alias("c"), F.lit(i).alias("k"), F.col("n").alias("n"), (F.col("y") == F.col("p")).alias("hit")) for i, c in enumerate((F.col("y"), F.col("p")))])))
    per = parts.groupBy("c").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits2"), F.sum("n").alias("both"))
    # Hits are counted on both sides: 2 TP over (true + predicted).
    return per.agg(F.avg(F.coalesce(ratio(F.col("hits2"), F.col("both")), F.lit(0.0))).alias("value"))


def rank_auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(value): P(score of a positive > of a negative) + half the ties, from counts by score; null for one class only.

    Scores are counted first; the running count of negatives is taken over ranges of scores, whose totals are added up.
    """
    counts = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("pos"), F.sum(F.when(positive, 0).otherwise(1)).alias("neg"))
    ranged = stable(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("neg").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = ranged.withColumn("below", below).join(sums, "part")
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("below") + F.col("neg") / 2))
    return run.agg(ratio(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("value"))


def r2_wmape(df: DataFrame, y: str = "label", pred: str = "prediction") -> DataFrame:
    """(r2, wmape); null where the truth is constant, or its absolute sum 0."""
    e = F.col(y) - F.col(pred)
    row = df.agg(F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"), F.sum(F.abs(e)).alias("ae"), F.sum(F.abs(F.col(y))).alias("ay"))
    return row.select((1 - ratio(F.col("sse"), F.col("sst"))).alias("r2"), ratio(F.col("ae"), F.col("ay")).alias("wmape"))


# Features and models


def ordinal_features(df: DataFrame, fit: DataFrame, schema: DataSchema, columns: list[str]) -> DataFrame:
    """df with `features`: medians for missing numbers, most frequent categories, sorted ordinal codes; fitted on fit."""
    cont = [c for c in columns if c in schema.continuous_columns]
    cat = [c for c in columns if c not in cont]
    stats, modes = moments(fit, cont) if cont else {}, most_frequent(fit, cat)
    cols = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(stats[c]["median"]), F.lit(0.0)) for c in cont]
    kinds, own = {f.name: f.dataType for f in df.schema.fields}, df.columns
    for i, c in enumerate(cat):
        df = coded_by(df, schema, c, F.coalesce(canon(F.col(f"`{c}`"), kinds[c], None), F.lit(modes[c])), f"_o{i}")
        cols.append(F.col(f"_o{i}"))
    return df.select(*[F.col(f"`{c}`") for c in own], array_to_vector(F.array(*cols)).alias("features"))


def labelled(df: DataFrame, target: str, task: TaskType) -> DataFrame:
    c = F.col(f"`{target}`")
    label = c.cast("double") if task is TaskType.REGRESSION else canon(c, df.schema[target].dataType, None)
    return df.withColumn("label", label).filter("label is not null")


def coded(df: DataFrame, classes: list[str]) -> DataFrame:
    return df.withColumn("y", ordinal(F.col("label"), classes))


def classes_of(*frames: DataFrame) -> list[str]:
    """The labels of all frames, in order; an error if they are more than MOST_CLASSES."""
    labels = reduce(DataFrame.union, [v.select("label") for v in frames]).distinct().limit(MOST_CLASSES + 1).collect()
    if len(labels) > MOST_CLASSES:
        raise ValueError(f"the target has more than {MOST_CLASSES} labels; bin it, or take it as a number")
    return sorted(r["label"] for r in labels)


def models(task: TaskType) -> tuple[str, ...]:
    """The three models of a task, by name."""
    return ("gbt", "random_forest", "ridge") if task is TaskType.REGRESSION else ("gbt", "random_forest", "logistic")


def _draw(rng: np.random.Generator, kind: str, *args):
    if kind == "int":
        return int(rng.integers(args[0], args[1] + 1))
    if kind == "uniform":
        return float(rng.uniform(*args))
    if kind == "log":
        return float(np.exp(rng.uniform(*np.log(args))))
    return args[int(rng.integers(len(args)))]


def random_draws(space: dict[str, tuple], n: int, seed: int) -> list[dict]:
    """n settings: ('int', lo, hi), ('uniform', lo, hi), ('log', lo, hi) or ('choice', ...) for each name."""
    rng = np.random.default_rng(seed)
    return [{k: _draw(rng, *v) for k, v in space.items()} for _ in range(n)]


def parzen_draw(space: dict[str, tuple], tried: list[tuple[dict, float]], rng: np.random.Generator) -> dict:
    """The next setting: of candidates drawn around good settings, name by name, that which is likeliest among the good
    ones against all others, as densities of normal kernels tell (shares, for choices). Random for the first trials."""
    if len(tried) < FIRST_TRIALS:
        return {k: _draw(rng, *v) for k, v in space.items()}
    ranked = sorted(tried, key=lambda t: -t[1])
    n_good = max(2, round(GOOD_SHARE * len(ranked)))
    out = {}
    for name, (kind, *args) in space.items():
        good, bad = ([t[0][name] for t in part] for part in (ranked[:n_good], ranked[n_good:]))
        if kind == "choice":
            odds = [(good.count(c) + 1) / (bad.count(c) + 1) for c in args]
            out[name] = args[int(np.argmax(odds))]
            continue
        bend = np.log if kind == "log" else np.asarray
        lo, hi = (float(bend(x)) for x in args)
        unit = lambda v, bend=bend, lo=lo, hi=hi: (np.asarray(bend(v), float) - lo) / ((hi - lo) or 1.0)
        g, b = unit(good), unit(bad)
        width = max(0.05, 1 / len(tried) ** 0.5)
        drawn = np.clip(rng.choice(g, CANDIDATES) + rng.normal(0, width, CANDIDATES), 0, 1)
        density = lambda at, of, width=width: np.exp(-(((at[:, None] - of[None, :]) / width) ** 2) / 2).mean(axis=1) + 1e-6
        best = lo + float(drawn[np.argmax(density(drawn, g) / density(drawn, b))]) * (hi - lo)
        out[name] = round(best) if kind == "int" else float(np.exp(best)) if kind == "log" else best
    return out


def folds_of(x: np.ndarray, y: np.ndarray, folds: int, seed: int, strata: bool) -> np.ndarray:
    """A fold for each row: dealt in turn, in every stratum, in an order drawn from the rows' values, not from where they lay."""
    rng, out = np.random.default_rng(seed), np.empty(len(y), np.int64)
    at = np.lexsort((*x.T, y))
    at = at[rng.permutation(len(at))]
    if strata:
        at = at[np.argsort(y[at], kind="stable")]
    _, first, n = np.unique(y[at], return_index=True, return_counts=True) if strata else (None, [0], [len(at)])
    for start, size in zip(first, n, strict=True):
        out[at[start : start + size]] = np.arange(size) % folds
    return out


def tuned(names: tuple[str, ...], train: DataFrame, task: TaskType, n_classes: int, n_trials: int, folds: int = 3, seed: int = 42, search: str = "random") -> dict[str, dict]:
    """The best of n_trials settings of each model by the mean of the folds' macro-F1 or R², drawn at random or by a
    Parzen search (search='tpe'); nothing set for no trials.

    Trials are fitted on up to TUNING_ROWS rows, a uniform sample. Random trials of all models and folds are tasks of
    one job; a Parzen search draws AT_ONCE settings at a time.
    """
    if not n_trials:
        return {name: {} for name in names}
    x, y = gathered(uniform_sample(train.select("features", "y"), TUNING_ROWS, seed))
    held = (x, y, folds_of(x, y, folds, seed, task is not TaskType.REGRESSION))
    spark = train.sparkSession
    if search == "random":
        trials = [(name, p) for name in names for p in random_draws(SPACES[name], n_trials, seed)]
        tried = list(zip(trials, trial_values(spark, held, trials, n_classes, folds, seed), strict=True))
    else:
        tried, rng = [], np.random.default_rng(seed)
        while len(tried) < n_trials * len(names):
            n = min(AT_ONCE, n_trials - len(tried) // len(names))
            own = {name: [(p, v) for (m, p), v in tried if m == name] for name in names}
            trials = [(name, parzen_draw(SPACES[name], own[name], rng)) for name in names for _ in range(n)]
            tried += zip(trials, trial_values(spark, held, trials, n_classes, folds, seed), strict=True)
    return {name: max(((p, v) for (m, p), v in tried if m == name), key=lambda t: t[1])[0] for name in names}


def scores_of(fitted, test: DataFrame, task: TaskType, classes: list[str]) -> dict[str, float | None]:
    """The scores of a fitted model on a table (features, y)."""
    scored = fitted.transform(test.select("features", "y")).select("y", "scores", "prediction").persist()
    try:
        if task is TaskType.REGRESSION:
            return r2_wmape(scored, "y").first().asDict()
        out = {"macro_f1": macro_f1(scored, "y").first()["value"]}
        which = [len(classes) - 1] if task is TaskType.BINARY else range(len(classes))
        aucs = [rank_auc(scored.withColumn("s", F.get("scores", F.lit(c))), F.col("y") == c, "s").first()["value"] for c in which]
        known = [a for a in aucs if a is not None]
        out["roc_auc"] = sum(known) / len(known) if known else None
        return out
    finally:
        scored.unpersist()


@dataclass
class Dim3Result:
    tstr: dict[str, dict[str, float | None]] = field(default_factory=dict)
    trtr: dict[str, dict[str, float | None]] = field(default_factory=dict)
    #: Why a model has no scores, by side and model.
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def utility_gap(self) -> dict[str, dict[str, float | None]]:
        """TRTR - TSTR of each model and score."""
        gap = lambda a, b: a - b if a is not None and b is not None else None
        return {m: {k: gap(v, self.tstr.get(m, {}).get(k)) for k, v in s.items()} for m, s in self.trtr.items()}

    @property
    def summary(self) -> str:
        return f"utility: TSTR {self.tstr}, gap {self.utility_gap}"


class MLUtilityEvaluator:
    def __init__(self, schema: DataSchema, target_col: str, task_type: TaskType | str, tuning_mode: str = "shared", n_tuning_trials: int = 50, trees: int = 100, random_state: int = 42, search: str = "random", cv_folds: int = 3):
        if search not in ("random", "tpe"):
            raise ValueError(f"search is random or tpe, not {search!r}")
        if tuning_mode not in ("shared", "independent"):
            raise ValueError(f"tuning_mode is shared or independent, not {tuning_mode!r}")
        self.schema, self.target, self.task = schema, target_col, TaskType(task_type)
        self.mode, self.trials, self.trees, self.seed, self.search, self.folds = tuning_mode, n_tuning_trials, trees, random_state, search, cv_folds

    def evaluate(self, train_synth: DataFrame, test_real: DataFrame, train_real: DataFrame | None = None) -> Dim3Result:
        columns = [c for c in self.schema.column_names if c != self.target]
        sides = {"synth": train_synth, "test": test_real} | ({"real": train_real} if train_real is not None else {})
        rows = {k: labelled(ingest(v), self.target, self.task) for k, v in sides.items()}
        regression = self.task is TaskType.REGRESSION
        classes = [] if regression else classes_of(*rows.values())
        fit, data = rows["test"], {}
        for k, v in rows.items():
            f = ordinal_features(v, fit, self.schema, columns)
            f = f.withColumn("y", F.col("label")) if regression else coded(f, classes)
            data[k] = written(f.select(vector_to_array("features").alias("features"), "label", "y"), "utility")
        out = Dim3Result()
        into = {k: side for k, side in (("synth", out.tstr), ("real", out.trtr)) if k in data and data[k].select("label").distinct().limit(2).count() > 1}
        names, n_classes = models(self.task), len(classes)
        tune = lambda k: tuned(names, data[k], self.task, n_classes, self.trials, self.folds, self.seed, self.search)
        if self.mode == "shared" and into:
            shared = tune("real" if "real" in into else "synth")
            chosen = dict.fromkeys(into, shared)
        else:
            chosen = {k: tune(k) for k in into}
        size = {"gbt": "rounds", "random_forest": "trees"}
        jobs = [(k, name, ({size[name]: self.trees} if name in size else {}) | chosen[k][name]) for k in into for name in names]
        done = fit_all(train_synth.sparkSession, {k: data[k] for k in into}, jobs, n_classes, self.seed)
        # The jobs of a model's scores are small, and don't wait for those of another's.
        with ThreadPoolExecutor(max(1, len(jobs))) as pool:
            scores = list(pool.map(lambda d: None if d[1] is not None else scores_of(d[0], data["test"], self.task, classes), done))
        for (k, name, _), (_, error), values in zip(jobs, done, scores, strict=True):
            if error is None:
                into[k][name] = values
            else:  # a model that can't be fitted has no scores; the others have
                out.errors[f"{k}/{name}"] = error
                into[k][name] = dict.fromkeys(("r2", "wmape") if regression else ("macro_f1", "roc_auc"))
        return out


def fitted_on(train: DataFrame, name: str, params: dict, n_classes: int, seed: int):
    """A model of a table (features, y), in a task or by Spark; its error is raised."""
    (fitted, error), *_ = fit_all(train.sparkSession, {"train": train}, [("train", name, params)], n_classes, seed)
    if error is not None:
        raise ValueError(error)
    return fitted


def fit_predict(train: DataFrame, test: DataFrame, schema: DataSchema, target: str, task: TaskType, trees: int = 100, seed: int = 42) -> DataFrame:
    """test with label and prediction (labels again, or numbers) of boosted trees fitted on train, of all other columns."""
    columns = [c for c in schema.column_names if c != target]
    a, b = labelled(ingest(train), target, task), labelled(ingest(test), target, task)
    arrays = lambda df: df.withColumn("features", vector_to_array("features"))
    rows, params = arrays(ordinal_features(b, b, schema, columns)), {"rounds": trees, "depth": 6}
    if task is TaskType.REGRESSION:
        return fitted_on(arrays(ordinal_features(a, b, schema, columns)).withColumn("y", F.col("label")), "gbt", params, 0, seed).transform(rows).drop("scores")
    classes = classes_of(a, b)
    fitted = fitted_on(arrays(coded(ordinal_features(a, b, schema, columns), classes)), "gbt", params, len(classes), seed)
    names = F.array(*[F.lit(c) for c in classes])
    return fitted.transform(rows).drop("scores").withColumn("prediction", F.get(names, F.col("prediction").cast("int")))


def fold_auc(held: tuple, job: tuple[str, dict, int, int]) -> float:
    """The AUC of a classifier of two sides on a fold that it wasn't fitted on."""
    (x, y, fold), (name, params, k, seed) = held, job
    own = fold == k
    return auc_of(y[own] == 1, fit_rows(name, params, x[~own], y[~own], 2, seed).predict(x[own])[:, 1])


def c2st_auc(real: DataFrame, synth: DataFrame, schema: DataSchema, folds: int = 5, max_samples: int = 50_000, seed: int = 42, trees: int = 300) -> dict[str, float | None]:
    """Mean AUC over stratified folds of telling real (1) from synthetic (0) rows, of two models; folds and models are
    tasks of one job, where the rows fit a task."""
    encoder = build_feature_encoder(schema, real)
    parts = [encoder.compact(uniform_sample(ingest(d), max_samples, seed), "_nums", "_codes").select(F.lit(y).alias("y"), F.concat("_nums", "_codes").alias("features")) for d, y in ((real, 1.0), (synth, 0.0))]
    data = written(parts[0].unionByName(parts[1]), "c2st")
    settings = {"gbt": C2ST["gbt"] | {"rounds": trees}, "random_forest": C2ST["random_forest"] | {"trees": trees}}
    jobs = [(name, p, k, seed) for name, p in settings.items() for k in range(folds)]
    if fits_a_task(data):
        x, y = gathered(data)
        done = at_once(real.sparkSession, jobs, fold_auc, (x, y, folds_of(x, y, folds, seed, True)))
        # A mean without the folds that failed would look like one of all folds.
        if failed := [f"{job[0]}, fold {job[2]}: {error}" for job, (_, error) in zip(jobs, done, strict=True) if error]:
            raise RuntimeError("; ".join(failed))
        got = [v for v, _ in done]
    else:
        dealt, got = written(fold_of(data, folds, "y", [F.xxhash64(F.lit(seed), "features")]), "folds"), []
        for name, p, k, _ in jobs:
            scored = fit_spread(name, p, dealt.filter(F.col("fold") != k), 2, seed).transform(dealt.filter(F.col("fold") == k).select("features", "y"))
            got.append(rank_auc(scored.select("y", F.get("scores", F.lit(1)).alias("s")), F.col("y") == 1, "s").first()["value"])
    out = {}
    for i, name in enumerate(settings):
        known = [v for v in got[i * folds : (i + 1) * folds] if v is not None and not np.isnan(v)]
        out[name] = sum(known) / len(known) if known else None
    return out


def drop_unseen_labels(df: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """The rows of df whose label some row of train has: a classifier can't predict the others."""
    known = train.select(F.col(label).alias("_known")).distinct()
    return df.join(known, F.col(label) == F.col("_known"), "left_semi")


def gap_by_model(trtr: DataFrame, tstr: DataFrame) -> DataFrame:
    """(model, metric, gap) of two tables (model, metric, value): trained on real rows less trained on synthetic ones."""
    both = trtr.alias("r").join(tstr.alias("s"), ["model", "metric"])
    return both.select("model", "metric", (F.col("r.value") - F.col("s.value")).alias("gap"))


def numeric_utility(synth: DataFrame, train_real: DataFrame, test_real: DataFrame, schema: DataSchema, target: str, trees: int = 100, seed: int = 42) -> dict[str, float | None]:
    """macro-F1 on test_real of a forest over the numeric columns alone: trained on synthetic rows (tstr), and on real
    ones (real), which is its upper bound. Rows whose label the training table lacks are left out."""
    columns = [c for c in schema.continuous_columns if c != target]
    if not columns:
        return {"tstr": None, "real": None}
    test, out = labelled(ingest(test_real), target, TaskType.MULTI), {}
    for name, rows in (("tstr", synth), ("real", train_real)):
        train = labelled(ingest(rows), target, TaskType.MULTI)
        classes = classes_of(train)
        seen = drop_unseen_labels(test, train)
        if len(classes) < 2:
            out[name] = None
            continue
        rows = lambda df, train=train, classes=classes: coded(ordinal_features(df, train, schema, columns), classes)
        model = fitted_on(rows(train), "random_forest", {"trees": trees}, len(classes), seed)
        out[name] = macro_f1(model.transform(rows(seen).select("features", "y")), "y").first()["value"]
    return out

"""The results of one run as a JSON document."""

from __future__ import annotations

import dataclasses
import json
import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.operators.fairness import Dim5Result
from tabscore.operators.fidelity import Dim1Result
from tabscore.operators.logic import Dim2Result
from tabscore.operators.neighbors import Dim4Result
from tabscore.operators.schema import DataSchema, schema_fingerprint
from tabscore.operators.structural import Dim0Result
from tabscore.operators.utility import Dim3Result
from tabscore.sources.files import read_text, write_text

FORMAT = "1.0"
RESULTS = {"result0": Dim0Result, "result1": Dim1Result, "result2": Dim2Result, "result3": Dim3Result, "result4": Dim4Result, "result5": Dim5Result}
log = logging.getLogger(__name__)


def to_json(x):
    """NaN becomes null, tuples become lists; tables are left out by the caller."""
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, dict):
        return {str(k): to_json(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [to_json(v) for v in x]
    return x


@dataclass
class BundleMetadata:
    model: str = ""
    dataset: str = ""
    fingerprint: str = ""
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    format_version: str = FORMAT
    notes: str = ""


@dataclass
class ResultBundle:
    metadata: BundleMetadata = field(default_factory=BundleMetadata)
    result0: Dim0Result | None = None
    result1: Dim1Result | None = None
    result2: Dim2Result | None = None
    result3: Dim3Result | None = None
    result4: Dim4Result | None = None
    result5: Dim5Result | None = None
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def dimensions_computed(self) -> list[int]:
        return [i for i, name in enumerate(RESULTS) if getattr(self, name) is not None]

    @property
    def has_errors(self) -> bool:
        return bool(self.errors)

    def validate_schema(self, schema: DataSchema) -> bool:
        return self.metadata.fingerprint == schema_fingerprint(schema)

    def as_dict(self) -> dict:
        out = {"metadata": dataclasses.asdict(self.metadata), "errors": dict(self.errors)}
        for name in RESULTS:
            r = getattr(self, name)
            out[name] = None if r is None else {f.name: getattr(r, f.name) for f in dataclasses.fields(r) if f.name != "clean_df"}
        return to_json(out)

    def save(self, path: str, indent: int = 2) -> None:
        """Written in whatever file system Spark writes (a plain path is of its default one), whole or not at all."""
        write_text(SparkSession.active(), path, json.dumps(self.as_dict(), indent=indent, ensure_ascii=False))

    @classmethod
    def from_dict(cls, d: dict) -> ResultBundle:
        span = lambda x: {k: span(v) for k, v in x.items()} if isinstance(x, dict) else tuple(x) if x is not None else None
        only = lambda kind, v: kind(**{k: span(x) if k.endswith("_ci") else x for k, x in v.items() if k in {f.name for f in dataclasses.fields(kind)}})
        if (version := d.get("metadata", {}).get("format_version")) != FORMAT:
            log.warning("the bundle has format %s, this is %s", version, FORMAT)
        return cls(only(BundleMetadata, d.get("metadata", {})), *[only(kind, d[name]) if d.get(name) is not None else None for name, kind in RESULTS.items()], d.get("errors", {}))

    @classmethod
    def load(cls, path: str) -> ResultBundle:
        return cls.from_dict(json.loads(read_text(SparkSession.active(), path)))


def read_bundles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, model, dataset, metric, value) of all bundles at some paths or globs: each is read and unfolded where a task
    reads it, so that thousands of runs go to a leaderboard without the driver."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["value"], strict=True):
                b = ResultBundle.from_dict(json.loads(text))
                rows += [(path, b.metadata.model, b.metadata.dataset, m, v) for m, v in raw_scores(b).items()]
            yield pd.DataFrame(rows, columns=["path", "model", "dataset", "metric", "value"])

    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return texts.mapInPandas(kernel, "path string, model string, dataset string, metric string, value double")


def _numbers(x) -> list[float]:
    if isinstance(x, dict):
        return [n for v in x.values() for n in _numbers(v)]
    return [float(x)] if isinstance(x, (int, float)) and not math.isnan(x) else []


def extract(bundle: ResultBundle, path: str) -> float | None:
    """The number at a dotted path; of (nested) dictionaries the mean of their numbers."""
    x = bundle
    for part in path.split("."):
        x = getattr(x, part, None) if x is not None else None
    numbers = _numbers(x)
    return sum(numbers) / len(numbers) if numbers else None


def extract_interval(bundle: ResultBundle, path: str) -> tuple[float, float] | None:
    x = bundle
    for part in path.split("."):
        x = getattr(x, part, None) if x is not None else None
    if isinstance(x, dict):
        pairs = [v for v in x.values() if v is not None]
        return (sum(a for a, _ in pairs) / len(pairs), sum(b for _, b in pairs) / len(pairs)) if pairs else None
    return tuple(x) if x is not None else None


def raw_scores(b: ResultBundle) -> dict[str, float | None]:
    """The metrics of a leaderboard row."""
    best = lambda scores, k: max((s[k] for s in scores.values() if s.get(k) is not None), default=None)
    r3 = b.result3
    f1, r2 = (best(r3.tstr, k) if r3 else None for k in ("macro_f1", "r2"))
    paths = {
        "irr": "result0.irr", "mean_ks": "result1.mean_ks", "mean_tvd": "result1.mean_tvd", "pearson_error": "result1.pearson_matrix_error", "cramerv_error": "result1.cramerv_matrix_error",
        "alpha_precision": "result1.alpha_precision", "beta_recall": "result1.beta_recall", "c2st_auc": "result1.c2st_auc_mean", "icvr": "result2.icvr_overall", "hcs": "result2.hcs_overall",
        "mdi": "result2.mdi_mean", "dsi_gap": "result2.dsi_gap", "dcr_5th": "result4.dcr_5th", "dcr_95th": "result4.dcr_95th", "exact_match_rate": "result4.exact_match_rate",
        "delta_dp": "result5.delta_dp", "delta_eop": "result5.delta_eop", "delta_eo": "result5.delta_eo", "nmi": "result5.nmi",
    }
    return {k: extract(b, p) for k, p in paths.items()} | {"tstr_f1": f1, "tstr_r2": r2, "utility": f1 if f1 is not None else r2}


def tidy(spark: SparkSession, bundle: ResultBundle) -> DataFrame:
    """(dimension, metric, key, value): every number of the bundle in a row of its own."""
    rows = []
    for i, name in enumerate(RESULTS):
        r = getattr(bundle, name)
        for f in dataclasses.fields(r) if r is not None else ():
            v = getattr(r, f.name)
            items = v.items() if isinstance(v, dict) else [("", v)]
            rows += [(i, f.name, f"{k}.{k2}" if k2 else str(k), float(x)) for k, y in items for k2, x in (y.items() if isinstance(y, dict) else [("", y)]) if isinstance(x, (int, float)) and not isinstance(x, bool)]
    return spark.createDataFrame(rows, "dimension int, metric string, key string, value double")

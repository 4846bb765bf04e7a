"""Spark-native scoring of a synthetic table against the real table it imitates."""

from __future__ import annotations

from importlib import import_module

#: Public names, by the module that has them; a module is imported when one of its names is first used.
_NAMES = {
    "tabscore.operators.schema": ["DataSchema", "ColumnSchema", "schema_fingerprint"],
    "tabscore.operators.specs": [
        "LogicSpec", "FairSpec", "TaskType", "BenchmarkError", "GenerationCollapseError", "SchemaMismatchError", "InsufficientDataError", "DataCopyingWarning", "GroupCollapseWarning",
    ],
    "tabscore.operators.logic": ["discover_fds", "LogicEvaluator", "Dim2Result", "register_constraint"],
    "tabscore.operators.structural": ["StructuralInterceptor", "Dim0Result"],
    "tabscore.operators.fidelity": ["FidelityEvaluator", "Dim1Result"],
    "tabscore.operators.utility": ["MLUtilityEvaluator", "Dim3Result"],
    "tabscore.operators.serialize": ["LLMUtilityEvaluator", "MemorizationProbe"],
    "tabscore.operators.neighbors": ["PrivacyEvaluator", "Dim4Result", "register_search"],
    "tabscore.operators.fairness": ["FairnessEvaluator", "Dim5Result"],
    "tabscore.operators.leaderboard": ["ResultAggregator"],
    "tabscore.operators.profile": ["DatasetProfiler", "DatasetProfile", "ColumnProfile"],
    "tabscore.operators.significance": ["SignificanceTester", "SignificanceReport", "MetricTestResult"],
    "tabscore.operators.ordering": ["discover_fd_order"],
    "tabscore.plans.bundle": ["ResultBundle", "BundleMetadata"],
    "tabscore.plans.pipeline": ["BenchmarkPipeline", "PipelineConfig"],
    "tabscore.models": ["BaseTabularModel"],
}
_HOME = {name: module for module, names in _NAMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)

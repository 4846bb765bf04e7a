"""The registered queries: each applies its operator, with the parameters for production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabscore.llm import alignment, chat_format, fingerprint, infilling, license_scan, line_dedup, mixing, ngram_join, packing, quality_rules, secret_scan, swap_packing, toxicity
from tabscore.llm.common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": lambda s, d: license_scan.labels_of(license_scan.license_scan(documents(s, d).select("doc_id", "text"))),
        "op2_toxicity": lambda s, d: toxicity.classify(documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op3_line_dedup": lambda s, d: line_dedup.dedup_lines(documents(s, d)),
        "op4_source_mix": lambda s, d: mixing.mix(documents(s, d)),
        "op5_packing": lambda s, d: packing.pack(documents(s, d)),
        "op6_ngram_join": lambda s, d: ngram_join.near_duplicates(documents(s, d)),
        "op7_fingerprint": lambda s, d: fingerprint.compare_with_edits(documents(s, d)),
        "op8_quality_rules": lambda s, d: quality_rules.verdicts(documents(s, d)),
        "op9_chat_format": lambda s, d: chat_format.format_conversations(s, s.read.parquet(f"{d}/conversations.parquet")),
        "op10_secret_scan": lambda s, d: secret_scan.spans_of(secret_scan.secret_scan(documents(s, d).select("doc_id", "text"))),
        "op11_token_alignment": lambda s, d: alignment.alignment(documents(s, d)),
        "op12_fill_in_middle": lambda s, d: infilling.digests(documents(s, d)),
        "op13_swap_packing": lambda s, d: swap_packing.pack_by_swaps(documents(s, d)),
    }

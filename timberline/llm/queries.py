"""The queries of this subpackage and the SQL that mirrors them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import fingerprints, line_dedup, mixing, packing, repetition, simhash, suffix_dedup, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_repetition": repetition.op8_repetition,
    "op9_packing": packing.op9_packing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLES: dict[str, str] = {"op10_line_dedup": line_dedup.OP10_SQL}

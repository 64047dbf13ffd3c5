"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewright.llm import (
    decontamination, exact_dedup, html_text, language_model, media, mixing, packing, prefix_trie, sharding, simhash, source_audit, substring_dedup, toxicity,
)

QUERIES = [
    substring_dedup.op1_substring_dedup,
    sharding.op2_histogram_sharding,
    packing.op3_length_bucket_packing,
    mixing.op4_entropy_mixing,
    media.op6_media_columns,
    language_model.op5_maxent_scores,
    html_text.op7_html_main_text,
    simhash.op8_simhash_near_dedup,
    exact_dedup.op9_exact_dedup,
    toxicity.op10_toxicity,
    prefix_trie.op11_prefix_trie,
    source_audit.op12_source_audit,
    decontamination.op13_decontamination,
]

SQL = {
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_source_audit": source_audit.OP12_SQL,
    "op13_decontamination": decontamination.OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

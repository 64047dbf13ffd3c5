"""Every query of the graph library with its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewright.plans import (
    captured, cleaning, completeness, descriptors, enriched, evaluation, folded, further, graph, identities, mentions, navigation, normalisers, participants, persistence, ranking, readmodels,
    relational, replayed, resolution, rich, signals, snapshots, source_forms, spans, structure, texts, validation,
)

MODULES = [
    ranking, texts, relational, resolution, graph, persistence, readmodels, validation, evaluation, folded, cleaning, further, participants, normalisers, replayed,
    captured, structure, enriched, identities, mentions, navigation, signals, snapshots, descriptors, source_forms, completeness, spans, rich,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for module in MODULES for name, (q, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}

"""Relationship resolution, merging and entity-centred views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_relationships(candidates: DataFrame, endpoints: list[str], type_col: str = "relationship_type") -> DataFrame:
    """One row for each (endpoints, lower-cased type): best confidence, candidate count, distinct pages.

    Null endpoints or types form a group of their own; an empty input gives no rows.
    """
    return candidates.groupBy(*endpoints, F.lower(type_col).alias("semantic_type")).agg(
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("candidates"),
        F.countDistinct("page").alias("pages"),
    )

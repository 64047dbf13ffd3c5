"""Evidence scores, ranks within a type and prominence buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.operators.ranking import rank_in_groups


def evidence_score() -> Column:
    """3 x distinct pages + mentions + 2 x distinct relationships."""
    return 3 * F.col("pages") + F.col("mentions") + 2 * F.col("relationships")


def bucket_sizes(n: Column) -> tuple[Column, Column]:
    """How many of n entities are major and how many supporting (fixed for n up to 5, then 20 % and 30 %)."""

    def share(part: float) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(part) + F.lit(0.5)))

    major = F.when(n <= 0, 0).when(n <= 5, 1).otherwise(share(0.2))
    supporting = F.when(n <= 1, 0).when(n <= 4, 1).when(n == 5, 2).otherwise(share(0.3))
    return major, supporting


def rank_within_type(entities: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Rank by score, pages, mentions, relationships, name, id within each type; null types rank together.

    sizes (type, n) saves a second pass over entities where the caller has a cheaper count.
    """
    scored = entities.withColumn("score", evidence_score())
    order = [F.desc("score"), F.desc("pages"), F.desc("mentions"), F.desc("relationships"), F.asc("name"), F.asc("entity_id")]
    if sizes is None:
        sizes = scored.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    ranked = rank_in_groups(scored, "type", order, most=most)
    major, supporting = bucket_sizes(F.col("n"))
    # types are few next to entities, and a count per type needs no second sort of the entities
    sized = ranked.join(sizes.withColumnRenamed("type", "size_type"), F.col("type").eqNullSafe(F.col("size_type")))
    return sized.select(
        "entity_id", "name", "type", "pages", "mentions", "relationships", "score", "rank",
        F.when(F.col("rank") <= major, "major").when(F.col("rank") <= major + supporting, "supporting").otherwise("minor").alias("prominence"),
    )

"""Entity ranking by evidence over parts (entities) and line items (relationship candidates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators.prominence import rank_within_type
from lorewright.operators.relationships import merge_relationships


def part_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as relationship candidates: supplier to part, typed by return flag."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("source_id"),
        F.col("l_partkey").alias("target_id"),
        F.col("l_returnflag").alias("relationship_type"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence"),
        F.col("l_orderkey").alias("page"),
    )


def entity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score parts as 3 x pages + mentions + 2 x relationships, then rank and bucket within type."""
    edges = merge_relationships(part_relationships(spark, sf_dir), ["source_id", "target_id"])
    evidence = (
        part_relationships(spark, sf_dir)
        .groupBy(F.col("target_id").alias("entity_id"))
        .agg(F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("mentions"))
    )
    degree = edges.groupBy(F.col("target_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("relationships"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")
    )
    scored = parts.join(evidence, "entity_id", "left").join(degree, "entity_id", "left").na.fill(0, ["pages", "mentions", "relationships"])
    sizes = parts.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return rank_within_type(scored, sizes)


ENTITY_RANKING_SQL = """
WITH cand AS (SELECT l_suppkey s, l_partkey t, lower(l_returnflag) k, l_orderkey page FROM lineitem),
ev AS (SELECT t entity_id, count(DISTINCT page) pages, count(*) mentions FROM cand GROUP BY t),
deg AS (SELECT t entity_id, count(*) relationships FROM (SELECT DISTINCT s, t, k FROM cand) GROUP BY t),
sc AS (SELECT p_partkey entity_id, p_name AS name, p_type AS type, coalesce(pages, 0) pages, coalesce(mentions, 0) mentions,
  coalesce(relationships, 0) relationships,
  3 * coalesce(pages, 0) + coalesce(mentions, 0) + 2 * coalesce(relationships, 0) score
  FROM part LEFT JOIN ev ON p_partkey = ev.entity_id LEFT JOIN deg ON p_partkey = deg.entity_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, pages DESC, mentions DESC, relationships DESC, name, entity_id) rank,
  count(*) OVER (PARTITION BY type) n FROM sc),
bk AS (SELECT *, CASE WHEN n <= 5 THEN 1 ELSE greatest(1, CAST(floor(n * 0.2 + 0.5) AS BIGINT)) END major,
  CASE WHEN n = 1 THEN 0 WHEN n <= 4 THEN 1 WHEN n = 5 THEN 2 ELSE greatest(1, CAST(floor(n * 0.3 + 0.5) AS BIGINT)) END supporting FROM rk)
SELECT entity_id, name, type, pages, mentions, relationships, score, rank,
  CASE WHEN rank <= major THEN 'major' WHEN rank <= major + supporting THEN 'supporting' ELSE 'minor' END prominence FROM bk
"""

QUERIES = {"entity_ranking": (entity_ranking, ENTITY_RANKING_SQL)}

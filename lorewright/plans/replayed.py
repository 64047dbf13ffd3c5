"""Replay of captured chunks as queries: entities, relationships, facts, tree and rejects of one canonical graph.

A chunk is an order: its line items are candidates (the part, of the part's first type word) and edges from each line item to the next, so the last edge of every order names an unknown target and repeated
parts of an order give edges to themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.operators import replay
from lorewright.plans.base import registrar, table

QUERIES: dict = {}
register = registrar(QUERIES)

#: Versions of captured output that a replay accepts; those before 4 lack facts, which are filled in empty.
VERSIONS, FACTS_SINCE = (2, 3, 4, 5), 4
#: The order of an order's line items, whose numbers repeat.
PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and version of captured output; version 1 is too old."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_type", " ")[0].alias("kind"), "p_type", "p_size")
    place = Window.partitionBy("l_orderkey").orderBy(*PLACE)
    item = table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(place)).join(part, F.col("l_partkey") == F.col("p_partkey"))
    line, page = F.col("line"), F.col("p_size").cast("int").alias("page_number")
    source = F.array(F.struct(page, F.col("p_name").alias("supporting_text")))
    text = lambda x: x.cast("string")
    fact = F.struct(F.concat(F.lit("f"), text(line)).alias("temporary_id"), F.lit("finish").alias("field_key"), F.concat(F.lit("A "), "p_type").alias("content"), source.alias("sources"))
    entity = F.struct(
        F.concat(F.lit("e"), text(line)).alias("temporary_id"), F.col("p_name").alias("name"), F.col("kind").alias("type"), F.array(F.col("l_returnflag")).alias("roles"),
        F.array().cast("array<string>").alias("aliases"), F.col("p_type").alias("summary"), source.alias("sources"), F.array(fact).alias("facts"),
    )
    edge = F.struct(
        F.concat(F.lit("e"), text(line)).alias("source_temporary_id"), F.concat(F.lit("e"), text(line + 1)).alias("target_temporary_id"), F.concat(F.lit("Sold-As "), "l_returnflag").alias("relationship_type"),
        F.col("l_linestatus").alias("description"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), source.alias("sources"),
    )
    by_line = lambda x: F.transform(F.array_sort(F.collect_list(F.struct(line.alias("k"), x.alias("x")))), lambda r: r["x"])
    chunks = item.groupBy("l_orderkey").agg(F.struct(by_line(entity).alias("entities"), by_line(edge).alias("relationships")).alias("validated_output"))
    return chunks.select(
        F.lit("camp").alias("campaign_id"), F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("l_orderkey").cast("int").alias("chunk_index"), (F.col("l_orderkey") % 5 + 1).cast("int").alias("version"), "validated_output"
    )


def accepted(chunks: DataFrame) -> DataFrame:
    """Chunks of known versions, those before FACTS_SINCE with empty facts."""
    old = F.col("version") < FACTS_SINCE
    bare = F.transform("validated_output.entities", lambda e: e.withField("facts", F.when(old, F.filter(e["facts"], lambda _: F.lit(False))).otherwise(e["facts"])))
    known = chunks.where(F.col("version").isin(*VERSIONS))
    return known.select("campaign_id", "chunk_id", "chunk_index", F.col("validated_output").withField("entities", bare).alias("validated_output"))


def graph_of(spark: SparkSession, sf_dir: str) -> replay.Graph:
    pages = table(spark, sf_dir, "part").select(F.lit("camp").alias("campaign_id"), F.col("p_partkey").cast("int").alias("page_number"), F.col("p_name").alias("text"))
    return replay.build_graph(accepted(captured(spark, sf_dir)), pages)


_CAND = "i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(PLACE) + ") AS line FROM lineitem), " + r"""c AS MATERIALIZED (SELECT CAST(l_orderkey AS VARCHAR) || ':e' || line AS id, l_orderkey, line, l_orderkey * 1000000 + line - 1 AS ord, p_name AS name,
  trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm, split_part(p_type, ' ', 1) AS type, p_type, p_size, l_returnflag, l_linestatus, l_discount FROM i JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 5 + 1 IN (2, 3, 4, 5)),
  k AS MATERIALIZED (SELECT *, first_value(id) OVER (PARTITION BY type, norm ORDER BY ord) AS key FROM c)"""
_EDGES = r"""e AS MATERIALIZED (SELECT a.ord, a.key AS source_id, b.key AS target_id, 'sold as ' || lower(a.l_returnflag) AS semantic_type, round(1 - a.l_discount, 2) AS confidence FROM k a LEFT JOIN k b ON b.l_orderkey = a.l_orderkey AND b.line = a.line + 1)"""


@register(f"WITH {_CAND} SELECT key, arg_min(name, ord) AS name, any_value(type) AS type, count(*) AS candidates, count(DISTINCT l_returnflag) AS roles, count(DISTINCT (p_size, name)) AS sources, arg_max(p_type, (length(p_type), -ord)) AS summary FROM k GROUP BY key")
def replay_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical entities: first name, longest summary, united roles and sources."""
    return graph_of(spark, sf_dir).entities.select("key", "name", "type", "candidates", F.size("roles").cast("long").alias("roles"), F.size("sources").cast("long").alias("sources"), "summary")


@register(f"WITH {_CAND}, {_EDGES} SELECT source_id, target_id, semantic_type, count(*) AS candidates, max(confidence) AS confidence FROM e WHERE target_id IS NOT NULL AND source_id <> target_id GROUP BY ALL")
def replay_edges_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical relationships between canonical ends."""
    return graph_of(spark, sf_dir).relationships.select("source_id", "target_id", "semantic_type", "candidates", "confidence")


@register(f"WITH {_CAND}, {_EDGES} SELECT ord, CASE WHEN target_id IS NULL THEN 'unknown target' ELSE 'self edge' END AS reason FROM e WHERE target_id IS NULL OR source_id = target_id")
def replay_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replay does not take, with its reason."""
    return graph_of(spark, sf_dir).rejected.select("ord", "reason")


@register(f"""WITH {_CAND}, f AS (SELECT key, ord, 'A ' || p_type AS content, trim(regexp_replace(lower(p_type), '[^\\p{{L}}\\p{{N}}''+-]+', ' ', 'g')) AS norm, p_size, name FROM k WHERE l_orderkey % 5 + 1 >= 4),
  g AS (SELECT key, norm, min(ord) AS ord, arg_min(content, ord) AS content, count(DISTINCT (p_size, name)) AS evidence FROM f GROUP BY key, norm)
  SELECT key, content, evidence, row_number() OVER (PARTITION BY key ORDER BY ord) - 1 AS sort_order FROM g""")
def replay_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by field and normalised content, in order of first sight; old captures have none."""
    return graph_of(spark, sf_dir).facts.select(F.col("canonical").alias("key"), "content", F.col("evidence").cast("long").alias("evidence"), F.col("sort_order").cast("long").alias("sort_order"))

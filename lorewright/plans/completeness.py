"""Segments to read again for entities with too few relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import completeness as C
from lorewright.plans.base import registrar, table
from lorewright.storage import tasks_for

QUERIES: dict = {}
register = registrar(QUERIES)

#: Occurrences of a task.
OCCURRENCES = 500_000


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks_for(table(spark, sf_dir, "lineitem"), OCCURRENCES)


def readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, relationships, segments): customers as documents, orders as segments, parts and suppliers as thirty entities."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"), F.col("o_custkey").alias("doc"), F.col("o_totalprice").alias("price"))
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("segment"), (F.col("l_partkey") % 30).alias("a"), (F.col("l_suppkey") % 30).alias("b"), "l_discount")
    met = i.join(o.select("segment", "doc"), "segment")
    related = met.where("l_discount < 0.03").select("doc", "segment", F.col("a").alias("source"), F.col("b").alias("target"))
    return met.select("doc", "segment", F.col("a").alias("entity")), related, o.select("doc", "segment", F.floor(F.col("price") / 10).alias("characters"))


_PLAN = f"""met AS MATERIALIZED (SELECT o_custkey AS doc, l_orderkey AS segment, l_partkey % 30 AS a, l_suppkey % 30 AS b, l_discount FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  oc AS (SELECT DISTINCT doc, segment, a AS entity FROM met), us AS MATERIALIZED (SELECT * FROM oc SEMI JOIN (SELECT doc, segment FROM oc GROUP BY ALL HAVING count(*) >= 2) USING (doc, segment)),
  en AS (SELECT doc, segment, a AS entity FROM met WHERE l_discount < 0.03 UNION ALL SELECT doc, segment, b FROM met WHERE l_discount < 0.03), dg AS (SELECT doc, entity, count(*) AS degree FROM en GROUP BY ALL),
  pl AS MATERIALIZED (SELECT us.*, s.doc IS NOT NULL AS shown FROM us LEFT JOIN (SELECT DISTINCT * FROM en) s USING (doc, segment, entity)),
  ow AS (SELECT doc, entity, count(*) AS n, count_if(NOT shown) AS op, any_value(coalesce(degree, 0)) AS degree FROM pl LEFT JOIN dg USING (doc, entity) GROUP BY doc, entity HAVING count_if(NOT shown) > 0),
  sg AS (SELECT *, list_filter([CASE WHEN degree = 0 THEN 'zero_degree' END, CASE WHEN degree <= 1 AND n >= 2 THEN 'repeated_low_degree' END, CASE WHEN op >= 2 AND op / n >= 0.5 THEN 'uncovered_occurrences' END], lambda x: x IS NOT NULL) AS signals,
    CASE WHEN degree = 0 THEN {C.ZERO} ELSE 0 END + CASE WHEN degree <= 1 AND n >= 2 THEN {C.LOW} ELSE 0 END + CASE WHEN op >= 2 AND op / n >= 0.5 THEN {C.UNCOVERED} ELSE 0 END + op * {C.PER_UNCOVERED} + n AS weight FROM ow),
  tg AS MATERIALIZED (SELECT doc, entity, degree, signals, weight FROM sg WHERE len(signals) > 0 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY weight DESC, entity) <= {C.TARGETS})"""


@register(f"WITH {_PLAN} SELECT doc, entity, degree, signals, weight FROM tg")
def completeness_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that need another look, with why and how much."""
    occurrences, relationships, _ = readings(spark, sf_dir)
    return C.targets(occurrences, relationships, tasks=_tasks(spark, sf_dir))[0]


@register(f"""WITH RECURSIVE {_PLAN}, hd AS MATERIALIZED (SELECT pl.doc, pl.entity, pl.segment, weight, floor(o_totalprice / 10) / {C.CHARACTERS} AS cost FROM pl JOIN tg USING (doc, entity) JOIN orders ON o_orderkey = segment AND o_custkey = pl.doc WHERE NOT shown),
  st AS (SELECT doc, 0 AS step, NULL::BIGINT AS segment, []::BIGINT[] AS done FROM hd GROUP BY doc
    UNION ALL SELECT doc, step + 1, seg, list_concat(any_value(done), (SELECT list(entity) FROM hd h WHERE h.doc = q.doc AND h.segment = seg)) FROM (
      SELECT doc, step, any_value(done) AS done, arg_min(segment, (-score, segment)) AS seg FROM (SELECT st.doc, st.step, st.done, hd.segment, sum(weight) - cost AS score FROM st JOIN hd ON hd.doc = st.doc WHERE step < {C.SEGMENTS} AND NOT list_contains(done, hd.entity) GROUP BY st.doc, st.step, st.done, hd.segment, cost) GROUP BY doc, step) q GROUP BY doc, step, seg),
  ch AS (SELECT doc, segment, step FROM st WHERE step > 0), rm AS (SELECT doc, max(step) AS used FROM ch GROUP BY doc),
  mo AS (SELECT doc, segment, used + row_number() OVER (PARTITION BY doc ORDER BY score DESC, segment) AS step FROM (SELECT doc, segment, sum(weight) - cost AS score FROM hd ANTI JOIN ch USING (doc, segment) GROUP BY doc, segment, cost HAVING sum(weight) - cost > 0) JOIN rm USING (doc))
  SELECT doc, segment, step, 'cover' AS kind FROM ch UNION ALL SELECT doc, segment, step, 'supplement' FROM mo WHERE step <= {C.SEGMENTS}""")
def completeness_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to read again, chosen greedily for every document, then filled up."""
    occurrences, relationships, segments = readings(spark, sf_dir)
    tasks = _tasks(spark, sf_dir)
    found, places = C.targets(occurrences, relationships, tasks=tasks)
    return C.cover(found, places, segments, tasks=tasks)

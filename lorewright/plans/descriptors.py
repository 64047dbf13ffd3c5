"""Roles that texts state of named parents, and mentions that they resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import descriptors as D
from lorewright.plans.base import registrar, table
from lorewright.storage import materialize

QUERIES: dict = {}
register = registrar(QUERIES)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as units: doc, unit, place, context, text, asks; each states a role of a supplier, repeats one, or says nothing."""
    item = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    name = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_name").alias("name"))
    own = item.withColumn("s", F.col("s") % 3).join(name, "s")
    k = (F.col("l_orderkey") + F.col("l_linenumber") * 5) % 7
    pick = lambda n, *said: F.coalesce(*[F.when(n == i, x if isinstance(x, Column) else F.lit(x)) for i, x in enumerate(said)], F.lit("Nothing stirred."))
    n = F.col("name")
    text = pick(
        k, F.concat(n, F.lit("'s guards held.")), F.concat(F.lit("The second army of "), n, F.lit(" marched.")), "The guards slept.", F.concat(n, F.lit(" and its envoys left.")), "The second army rested.",
        F.concat(F.lit("At noon a "), n, F.lit(" guard was seen.")),
    )
    asks = pick(F.col("l_orderkey") % 4, "the guards", "the second army", F.concat(n, F.lit("'s guards")), "both envoys")
    return own.select(
        F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit"), F.col("l_linenumber").alias("place"),
        F.when(F.col("l_linenumber") <= 3, "first part").otherwise("second part").alias("context"), text.alias("text"), asks.alias("asks"),
    )


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"))


_UNITS = """it AS (SELECT l_orderkey AS doc, l_linenumber AS place, min(l_suppkey) % 3 AS s FROM lineitem GROUP BY l_orderkey, l_linenumber),
  un AS MATERIALIZED (SELECT doc, doc * 10 + place AS unit, place, place <= 3 AS c, s AS id, (doc + place * 5) % 7 AS k, doc % 4 AS q FROM it JOIN supplier ON s_suppkey = s),
  rg AS MATERIALIZED (SELECT *, CASE k WHEN 1 THEN 'army' WHEN 3 THEN 'envoy' ELSE 'guard' END AS role, CASE k WHEN 1 THEN 'second' END AS ordinal FROM un WHERE k IN (0, 1, 3, 5))"""


@register(f"WITH {_UNITS} SELECT doc, unit, place, id, role, ordinal FROM rg")
def stated_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of roles that units state of suppliers."""
    return D.registry(units(spark, sf_dir).drop("asks"), parents(spark, sf_dir)).drop("context")


@register(f"""WITH {_UNITS}, ak AS (SELECT *, CASE q WHEN 1 THEN 'army' WHEN 3 THEN 'envoy' ELSE 'guard' END AS r, CASE q WHEN 1 THEN 'second' END AS o, CASE q WHEN 2 THEN id END AS named FROM un),
  c1 AS (SELECT a.unit AS mention, min(g.id) AS id, arg_max(g.unit, g.place) AS unit FROM ak a JOIN rg g ON g.unit = a.unit AND g.role = a.r AND g.ordinal IS NOT DISTINCT FROM a.o AND (named IS NULL OR named = g.id) GROUP BY a.unit HAVING min(g.id) = max(g.id)),
  sh AS (SELECT *, k IN (1, 4) AND o IS NOT NULL AS num FROM ak WHERE r = 'guard' AND k = 2 OR o IS NOT NULL AND k IN (1, 4)),
  c2 AS (SELECT a.unit AS mention, min(g.id) AS id, arg_max(g.unit, g.place) AS unit FROM sh a JOIN rg g ON g.doc = a.doc AND g.place - a.place IN (-2, -1, 1) AND g.c = a.c AND g.role = a.r AND g.ordinal IS NOT DISTINCT FROM a.o AND (named IS NULL OR named = g.id)
    WHERE a.unit NOT IN (SELECT mention FROM c1) GROUP BY a.unit HAVING min(g.id) = max(g.id)),
  un1 AS (SELECT doc, role, ordinal, min(id) AS id FROM rg WHERE ordinal IS NOT NULL GROUP BY ALL HAVING min(id) = max(id)),
  c3 AS (SELECT a.unit AS mention, min(g.id) AS id, arg_max(g.unit, g.place) AS unit FROM sh a JOIN un1 u ON u.doc = a.doc AND u.role = a.r AND u.ordinal = a.o JOIN rg g ON g.doc = a.doc AND g.role = u.role AND g.ordinal = u.ordinal AND g.place < a.place
    WHERE num AND a.unit NOT IN (SELECT mention FROM c1 UNION ALL SELECT mention FROM c2) GROUP BY a.unit)
  SELECT mention, id, 'cited' AS how, unit FROM c1 UNION ALL SELECT mention, id, 'near', unit FROM c2 UNION ALL SELECT mention, id, 'earlier', unit FROM c3""")
def resolved_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by role of every line's claim, which cites the line itself."""
    own = materialize(units(spark, sf_dir), "units")
    mentions = own.select(F.col("unit").alias("mention"), F.col("unit").alias("claim"), F.col("asks").alias("text"))
    return D.resolve_descriptors(mentions, own.select(F.col("unit").alias("claim"), "doc", "unit"), own.drop("asks"), parents(spark, sf_dir))

"""Claims' participants: staged resolution, explicit identities, unsupported names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import participants as R
from lorewright.plans.base import PARTS, parts, registrar, table

QUERIES: dict = {}
register = registrar(QUERIES)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("id", F.concat_ws(" ", "name", "brand", "size").alias("name"), F.array(F.concat_ws(" ", "type", "brand", "size")).alias("aliases"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as mentions: the form depends on the line's place."""
    item = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, name = F.col("l_linenumber"), F.concat_ws(" ", "p_name", "p_brand", "p_size")
    text = F.when(n == 1, name).when(n == 2, F.concat_ws(" ", "p_type", "p_brand", "p_size")).when(n == 3, F.concat_ws(" ", F.lit("The"), name)).when(n == 4, F.lit("it")).when(n == 5, F.lit("Villagers")).otherwise("a stranger")
    return item.groupBy(F.col("l_orderkey").alias("claim"), n.alias("ord")).agg(F.min(text).alias("text"))


_FORMS = rf"""{PARTS}, en AS (SELECT id, lower(regexp_replace(name || ' ' || brand || ' ' || size, '[^a-zA-Z0-9]+', ' ', 'g')) AS n, lower(regexp_replace(type || ' ' || brand || ' ' || size, '[^a-zA-Z0-9]+', ' ', 'g')) AS a FROM pt),
  fm AS (SELECT DISTINCT form, stage, id FROM (SELECT n AS form, 0 AS stage, id FROM en UNION ALL SELECT a, 1, id FROM en UNION ALL SELECT 'the ' || n, 2, id FROM en UNION ALL SELECT string_split(n, ' ')[-1], 3, id FROM en)),
  cn AS (SELECT form, stage, count(*) AS k, min(id) AS id FROM fm GROUP BY ALL), fs AS (SELECT form, min(stage) AS stage, arg_min(k, stage) AS k, arg_min(id, stage) AS id FROM cn GROUP BY form),
  mt AS (SELECT l_orderkey AS claim, l_linenumber AS ord, min(CASE l_linenumber WHEN 1 THEN p_name || ' ' || p_brand || ' ' || p_size WHEN 2 THEN p_type || ' ' || p_brand || ' ' || p_size WHEN 3 THEN 'The ' || p_name || ' ' || p_brand || ' ' || p_size WHEN 4 THEN 'it' WHEN 5 THEN 'Villagers' ELSE 'a stranger' END) AS text FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
  st AS (SELECT claim, ord, text, CASE WHEN text = 'it' THEN 'pronoun' WHEN k = 1 THEN ['exact', 'alias', 'article', 'suffix'][stage + 1] WHEN k > 1 THEN 'ambiguous' WHEN text = 'Villagers' THEN 'generic' ELSE 'unresolved' END AS kind, CASE WHEN k = 1 THEN id END AS id
    FROM mt LEFT JOIN fs ON form = lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))),
  bf AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY claim ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM st)"""


@register(f"WITH {_FORMS} SELECT claim, ord, text, CASE WHEN kind <> 'pronoun' THEN kind WHEN before IS NULL THEN 'unresolved' ELSE 'coreference' END AS kind, CASE WHEN kind = 'pronoun' THEN before ELSE id END AS id FROM bf")
def participant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve(mentions(spark, sf_dir), entities(spark, sf_dir))


@register(f"""WITH RECURSIVE {PARTS}, p0 AS (SELECT DISTINCT lower(regexp_replace(name || ' ' || brand || ' ' || size, '[^a-zA-Z0-9]+', ' ', 'g')) AS a, lower(regexp_replace(type || ' ' || brand || ' ' || size, '[^a-zA-Z0-9]+', ' ', 'g')) AS b FROM pt),
  e AS (SELECT a, b FROM p0 UNION SELECT b, a FROM p0), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS name, min(b) AS component FROM r GROUP BY a""")
def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names connected by statements of identity."""
    said = parts(spark, sf_dir).select(F.concat_ws(" ", "name", "brand", "size", F.lit("is also known as"), "type", "brand", F.concat(F.col("size").cast("string"), F.lit("."))).alias("text"))
    return R.alias_components(R.explicit_identities(said)).select(F.col("node").alias("name"), "component")


@register(r"""WITH p AS (SELECT o_orderkey AS claim, c_name AS name, CASE o_orderkey % 4 WHEN 0 THEN 'as told by ' || upper(c_name) || ', at last' WHEN 1 THEN c_name || '1 said so' WHEN 2 THEN replace(c_name, '#', ' - ') ELSE 'nobody' END AS evidence
    FROM orders JOIN customer ON c_custkey = o_custkey), n AS (SELECT claim, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) AS name, trim(regexp_replace(lower(evidence), '[^\p{L}\p{N}]+', ' ', 'g')) AS evidence FROM p)
  SELECT claim FROM n WHERE NOT contains(' ' || evidence || ' ', ' ' || name || ' ')""")
def unsupported_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of customers whose name the evidence does not hold, token for token."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), "o_custkey")
    own = o.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")), F.col("o_custkey") == F.col("c_custkey"))
    told = F.concat(F.lit("as told by "), F.upper("name"), F.lit(", at last"))
    kind = F.col("claim") % 4
    evidence = F.when(kind == 0, told).when(kind == 1, F.concat("name", F.lit("1 said so"))).when(kind == 2, F.replace("name", F.lit("#"), F.lit(" - "))).otherwise("nobody")
    return R.unsupported(own.withColumn("evidence", evidence)).select("claim")

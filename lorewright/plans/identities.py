"""Identity statements enabled to a fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.operators import identities as R
from lorewright.plans.base import registrar, table
from lorewright.storage import tasks_for

QUERIES: dict = {}
register = registrar(QUERIES)

#: Statements of a task.
STATEMENTS = 50_000


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks_for(table(spark, sf_dir, "customer"), STATEMENTS)


def statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(statements, anchors): each customer is also called the next of its nation and segment, and every fifth statement
    cites itself, the others the one before; customers in debt are known entities."""
    along = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    own = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("statement"), F.col("c_name").alias("claimed_name"), F.lead("c_name").over(along).alias("other_name"),
        F.when(F.row_number().over(along) % 5 == 1, F.col("c_name")).otherwise(F.lag("c_name").over(along)).alias("source_name"),
        F.when(F.col("c_custkey") % 11 == 0, "transition").otherwise("alias").alias("kind"),
    )
    known = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return own, known


_STATE = """sm AS MATERIALIZED (SELECT c_custkey AS statement, c_name AS claimed, lead(c_name) OVER w AS other, CASE WHEN row_number() OVER w % 5 = 1 THEN c_name ELSE lag(c_name) OVER w END AS source,
    CASE WHEN c_custkey % 11 = 0 THEN 'transition' ELSE 'alias' END AS kind FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)),
  an AS MATERIALIZED (SELECT c_name AS name, c_custkey AS id FROM customer WHERE c_acctbal < 0),
  st AS (SELECT 0 AS r, statement, 0 AS rd FROM sm WHERE source = claimed
    UNION ALL SELECT * FROM (WITH cur AS (SELECT r, statement, rd FROM st),
      l0 AS (SELECT claimed AS a, other AS b FROM sm JOIN cur USING (statement) WHERE kind = 'alias' AND other IS NOT NULL),
      l1 AS (SELECT a, b FROM l0 UNION SELECT b, a FROM l0 UNION SELECT a, a FROM l0 UNION SELECT b, b FROM l0),
      l2 AS (SELECT DISTINCT x.a, y.b FROM l1 x JOIN l1 y ON x.b = y.a), l4 AS (SELECT DISTINCT x.a, y.b FROM l2 x JOIN l2 y ON x.b = y.a),
      l8 AS (SELECT DISTINCT x.a, y.b FROM l4 x JOIN l4 y ON x.b = y.a),
      ok AS (SELECT l8.a FROM l8 LEFT JOIN an ON an.name = l8.b GROUP BY l8.a HAVING count(DISTINCT id) <= 1),
      nw AS (SELECT statement FROM sm JOIN l8 ON l8.a = source AND l8.b = claimed WHERE source IN (SELECT a FROM ok) AND statement NOT IN (SELECT statement FROM cur))
      SELECT r + 1, statement, rd FROM cur WHERE EXISTS (SELECT 1 FROM nw)
      UNION ALL SELECT (SELECT max(r) FROM cur) + 1, statement, (SELECT max(r) FROM cur)::INT + 1 FROM nw)),
  en AS MATERIALIZED (SELECT statement, rd FROM st WHERE r = (SELECT max(r) FROM st))"""


@register(f"WITH RECURSIVE {_STATE} SELECT sm.statement, en.rd AS enabled_at FROM sm LEFT JOIN en USING (statement)")
def enabled_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements of identity count, and in which round they came to count."""
    return R.enabled_statements(*statements(spark, sf_dir), tasks=_tasks(spark, sf_dir))


@register(f"""WITH RECURSIVE {_STATE}, k0 AS (SELECT claimed AS a, other AS b FROM sm JOIN en USING (statement) WHERE kind = 'alias' AND other IS NOT NULL),
  k1 AS (SELECT a, b FROM k0 UNION SELECT b, a FROM k0), k2 AS (SELECT a, a AS b FROM k1 UNION SELECT k2.a, k1.b FROM k2 JOIN k1 ON k2.b = k1.a),
  cp AS (SELECT a AS name, min(b) AS component FROM k2 GROUP BY a), hd AS (SELECT component, min(id) AS lo, max(id) AS hi FROM cp JOIN an USING (name) GROUP BY component)
  SELECT name, component, CASE WHEN lo = hi THEN lo END AS entity, coalesce(lo < hi, false) AS ambiguous FROM cp LEFT JOIN hd USING (component)""")
def enabled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that statements connect, with the entity that their component holds."""
    return R.enabled_components(*statements(spark, sf_dir), tasks=_tasks(spark, sf_dir))[1]

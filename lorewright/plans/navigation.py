"""Navigation of containment trees, and sections that hold what stands between two headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import intervals
from lorewright.operators import navigation as N
from lorewright.operators.hierarchy import location_tree
from lorewright.plans.base import registrar, table
from lorewright.plans.graph import _PLACES, places
from lorewright.storage import materialize

QUERIES: dict = {}
register = registrar(QUERIES)

_PATHS = f"""{_PLACES}, pa AS (SELECT l.id, NULL::VARCHAR AS parent, l.id AS root, 0 AS depth, [l.id] AS path FROM loc l WHERE l.id NOT IN (SELECT child FROM chosen)
    UNION ALL SELECT c.child, c.parent, pa.root, depth + 1, list_append(path, c.child) FROM pa JOIN chosen c ON c.parent = pa.id),
  nv AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place FROM pa),
  sz AS (SELECT top AS id, count(*) AS size FROM (SELECT unnest(path) AS top FROM pa) GROUP BY top)"""


@register(f"""WITH RECURSIVE {_PATHS} SELECT nv.id, nv.parent, nv.root, nv.depth, nv.place, sz.size, count(ch.child) AS children FROM nv JOIN sz USING (id) LEFT JOIN chosen ch ON ch.parent = nv.id GROUP BY ALL""")
def hierarchy_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place with its parent, root, depth, pre-order number and size of its subtree."""
    rel, locations = places(spark, sf_dir)
    tree = materialize(location_tree(rel, locations)[0].select("child", "parent"), "tree")
    return N.navigation(locations.withColumn("name", F.col("id")), tree)


@register(f"""WITH RECURSIVE {_PATHS} SELECT a.id, b.id AS node, b.place - a.place AS place FROM nv a JOIN nv b ON a.root = b.root AND b.place > a.place AND list_contains(b.path, a.id) WHERE a.id LIKE 'n%'""")
def nation_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of every nation, in pre-order."""
    rel, locations = places(spark, sf_dir)
    tree = materialize(location_tree(rel, locations)[0].select("child", "parent"), "tree")
    found = materialize(N.navigation(locations.withColumn("name", F.col("id")), tree), "navigation")
    return N.descendants(found, table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))


@register("""WITH h AS (SELECT o_custkey AS doc, o_orderkey AS section, o_orderkey % 9 AS page, o_orderkey % 700 AS off, CASE WHEN o_orderpriority = '5-LOW' THEN 'loose' ELSE 'ranged' END AS kind, (o_orderkey * 7) % 9 AS to_page, (o_orderkey * 13) % 700 AS to_off FROM orders),
    s AS (SELECT *, CASE WHEN kind = 'ranged' THEN (to_page, to_off) > (page, off) ELSE false END AS closed FROM h),
    e AS (SELECT l_orderkey * 10 + l_linenumber AS item, o_custkey AS doc, l_partkey % 9 AS page, l_suppkey % 700 AS off FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
  SELECT e.item, s.section FROM e JOIN s ON s.doc = e.doc AND (e.page, e.off) >= (s.page, s.off) AND (e.page, e.off) < (s.to_page, s.to_off) WHERE s.closed""")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence (line items at a page and offset of their customer's document) in sections (orders) from one heading to another."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    sections = o.where("o_orderpriority <> '5-LOW'").select(
        F.col("o_custkey").alias("doc"), k.alias("section"), (k % 9).alias("page"), (k % 700).alias("start"), ((k * 7) % 9).alias("to_page"), ((k * 13) % 700).alias("to_start")
    )
    i = table(spark, sf_dir, "lineitem").join(o.select(k.alias("l_orderkey"), F.col("o_custkey").alias("doc")), "l_orderkey")
    points = i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), "doc", (F.col("l_partkey") % 9).alias("page"), (F.col("l_suppkey") % 700).alias("start"))
    return intervals.points_in_ranges(points, sections, ["doc"]).select("item", "section")

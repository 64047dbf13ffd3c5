"""Visibility-filtered read models and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.operators.ranking import rank_in_groups
from lorewright.plans.base import EDGES, PARTS, edges, parts, rank_of, registrar, table
from lorewright.storage import materialize

QUERIES: dict = {}
register = registrar(QUERIES)


@register(f"WITH {PARTS}, {EDGES}, v AS (SELECT id FROM pt WHERE visible) SELECT (SELECT count(*) FROM v) AS entities, (SELECT count(*) FROM ed WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)) AS relationships, (SELECT count(*) FROM events WHERE user_id IN (SELECT id FROM v)) AS facts")
def visible_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = parts(spark, sf_dir).where("visible").select("id")
    e = edges(spark, sf_dir).join(v.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(v.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    f = table(spark, sf_dir, "events").join(v.withColumnRenamed("id", "user_id"), "user_id", "left_semi")
    n = F.count(F.lit(1))
    return v.agg(n.alias("entities")).crossJoin(e.agg(n.alias("relationships"))).crossJoin(f.agg(n.alias("facts")))


@register(f"WITH {PARTS} SELECT DISTINCT lower(type) AS category FROM pt WHERE visible UNION SELECT 'enemies' FROM pt WHERE visible AND brand = 'Brand#13'")
def category_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with an entity, and "enemies" if any has that role."""
    p = parts(spark, sf_dir).where("visible")
    return p.select(F.lower("type").alias("category")).union(p.where("brand = 'Brand#13'").select(F.lit("enemies"))).distinct()


@register(f"""WITH {PARTS}, {EDGES} SELECT id, name, coalesce(n_edges, 0) AS n_edges, coalesce(n_facts, 0) AS n_facts, coalesce(n_sources, 0) AS n_sources FROM pt
  LEFT JOIN (SELECT target_id, count(*) AS n_edges, count(DISTINCT page) AS n_sources FROM ed GROUP BY 1) ON id = target_id LEFT JOIN (SELECT user_id, count(*) AS n_facts FROM events GROUP BY 1) ON id = user_id WHERE visible""")
def entity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).groupBy("target_id").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("page").alias("n_sources"))
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_facts"))
    own = parts(spark, sf_dir).where("visible").join(e, F.col("id") == F.col("target_id"), "left").join(f, F.col("id") == F.col("user_id"), "left").na.fill(0, ["n_edges", "n_facts", "n_sources"])
    return own.select("id", "name", "n_edges", "n_facts", "n_sources")


@register("""WITH g AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'past' WHEN event_type IN ('click', 'view') THEN 'present' WHEN event_type = 'purchase' THEN 'future' ELSE 'undated' END AS bucket, CAST(ts AS DATE) AS d FROM events)
  SELECT event_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY d NULLS LAST, event_id) AS place FROM g""")
def event_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by bucket and date; buckets are few, so large ones are ranked by ranges."""
    t = F.col("event_type")
    bucket = F.when(t == "signup", "past").when(t.isin("click", "view"), "present").when(t == "purchase", "future").otherwise("undated")
    own = table(spark, sf_dir, "events").select("event_id", bucket.alias("bucket"), F.to_date("ts").alias("d"))
    ranked = rank_in_groups(own, "bucket", [F.asc_nulls_last("d"), F.col("event_id")], "place")
    return ranked.select("event_id", "bucket", "place")


@register("""WITH d AS (SELECT DISTINCT l_partkey AS e, l_suppkey AS doc, l_orderkey AS page FROM lineitem), p AS (SELECT e, doc, count(*) AS pages FROM d GROUP BY ALL) SELECT e, count(*) AS documents, sum(pages) AS pages, arg_max(doc, (pages, -doc)) AS main_document FROM p GROUP BY e""")
def source_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of an entity by document, then page; equal texts once."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("e"), F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page")).distinct()
    p = d.groupBy("e", "doc").agg(F.count(F.lit(1)).alias("pages"))
    return p.groupBy("e").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), (-F.max(F.struct("pages", (-F.col("doc")).alias("nd"))).getField("nd")).alias("main_document"))


@register("""WITH f(field, section, label) AS (VALUES ('signup', 'origin', 'Joined'), ('purchase', 'deeds', 'Bought'), ('click', 'deeds', 'Clicked')) SELECT user_id, coalesce(section, 'other') AS section, count(*) AS facts, min(coalesce(label, upper(substr(event_type, 1, 1)) || substr(event_type, 2))) AS first_label
  FROM events LEFT JOIN f ON field = event_type GROUP BY ALL""")
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by section of the article; a field without a label is shown in title case."""
    dim = spark.createDataFrame([("signup", "origin", "Joined"), ("purchase", "deeds", "Bought"), ("click", "deeds", "Clicked")], "field string, section string, label string")
    own = table(spark, sf_dir, "events").join(F.broadcast(dim), F.col("field") == F.col("event_type"), "left")
    return own.groupBy("user_id", F.coalesce("section", F.lit("other")).alias("section")).agg(F.count(F.lit(1)).alias("facts"), F.min(F.coalesce("label", F.initcap("event_type"))).alias("first_label"))


@register(f"""WITH {PARTS} SELECT id, name, r, label FROM (SELECT id, name, upper(type[1]) || lower(type[2:]) || CASE WHEN size > 30 THEN ', major' WHEN visible THEN ', known' ELSE '' END AS label,
  row_number() OVER (PARTITION BY type ORDER BY lower(name), id) AS r FROM pt) WHERE r <= 4""")
def overview_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four entities of each type by name, with a label of their type and standing."""
    standing = F.when(F.col("size") > 30, ", major").when(F.col("visible"), ", known").otherwise("")
    label = F.concat(F.upper(F.substring("type", 1, 1)), F.lower(F.expr("substring(type, 2)")), standing)
    return parts(spark, sf_dir).select("id", "name", F.row_number().over(rank_of(["type"], [F.lower("name"), "id"])).alias("r"), label.alias("label")).where("r <= 4")


@register(f"WITH {PARTS} SELECT type, coalesce(CASE WHEN size > 30 THEN 'major' WHEN size > 10 THEN 'supporting' END, 'minor') AS grp, count(*) AS n FROM pt GROUP BY ALL")
def organiser_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grp = F.coalesce(F.when(F.col("size") > 30, "major").when(F.col("size") > 10, "supporting"), F.lit("minor"))
    return parts(spark, sf_dir).groupBy("type", grp.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {EDGES} SELECT source_id, target_id, count(*) AS n FROM ed WHERE type <> 'Sold As A' GROUP BY ALL")
def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections by related entity, without the kind that the page shows elsewhere."""
    return edges(spark, sf_dir).where("type <> 'Sold As A'").groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH d(p, lo, hi) AS (VALUES ('signup', 0, 10), ('view', 10, 60), ('click', 60, 90), ('purchase', 90, 100)), s AS (SELECT user_id, event_id, ts, lo + CAST(floor((hi - lo) * least(1, event_id % 8 / 4.0)) AS BIGINT) AS pct FROM events JOIN d ON p = event_type)
  SELECT event_id, pct, max(pct) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS shown FROM s""")
def monotonic_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress by phase, which never falls back."""
    dim = spark.createDataFrame([("signup", 0, 10), ("view", 10, 60), ("click", 60, 90), ("purchase", 90, 100)], "p string, lo long, hi long")
    share = F.least(F.lit(1.0), F.col("event_id") % 8 / 4.0)
    own = table(spark, sf_dir, "events").join(F.broadcast(dim), F.col("p") == F.col("event_type")).select("user_id", "event_id", "ts", (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * share)).alias("pct"))
    return own.select("event_id", "pct", F.max("pct").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("shown"))


@register("""WITH v AS (SELECT p_partkey, [p_size // 10, p_size % 10, p_partkey % 5] AS ver FROM part), l AS (SELECT v.p_partkey, ver, lag(ver) OVER (PARTITION BY p_brand ORDER BY v.p_partkey) AS prev FROM v JOIN part ON part.p_partkey = v.p_partkey) SELECT p_partkey, prev IS NULL OR prev > ver AS newest_first FROM l""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each version of a changelog is older than the one before it; a brand's parts stand for a changelog."""
    size = F.col("p_size")
    ver = F.struct(F.floor(size / 10).alias("a"), (size % 10).cast("long").alias("b"), (F.col("p_partkey") % 5).alias("c"))
    own = table(spark, sf_dir, "part").select("p_partkey", "p_brand", ver.alias("ver"))
    placed = materialize(rank_in_groups(own, "p_brand", [F.col("p_partkey")], "place"), "versions")  # brands may be few and large
    before = placed.select("p_brand", (F.col("place") + 1).alias("place"), F.col("ver").alias("prev"))
    met = placed.join(before, ["p_brand", "place"], "left")
    return met.select("p_partkey", (F.col("prev").isNull() | (F.col("prev") > F.col("ver"))).alias("newest_first"))


@register(f"WITH {PARTS} SELECT n.n_nationkey AS id, CASE WHEN n.n_regionkey <> 3 THEN n.n_regionkey END AS shown_parent FROM nation n")
def hierarchy_for_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of hidden parents become roots."""
    shown = table(spark, sf_dir, "region").where("r_regionkey <> 3").select("r_regionkey")
    return table(spark, sf_dir, "nation").join(shown, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("id"), F.col("r_regionkey").alias("shown_parent"))

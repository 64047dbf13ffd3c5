"""Projection, filter, join, aggregation, ranking, limit and set operators over the driver's tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.operators.ranking import running_sum
from lorewright.plans.base import EDGES, PAGES, PARTS, edges, pages, parts, rank_of, registrar, table
from lorewright.storage import tasks_for

QUERIES: dict = {}
register = registrar(QUERIES)


@register("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#1' OR p_type IN ('TYPE1', 'ECONOMY') OR p_size BETWEEN 5 AND 9")
def keyed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan by predicates with an explicit column list; both reach the Parquet reader."""
    wanted = (F.col("p_brand") == "Brand#1") | F.col("p_type").isin("TYPE1", "ECONOMY") | F.col("p_size").between(5, 9)
    return table(spark, sf_dir, "part").where(wanted).select("p_partkey", "p_name")


@register("SELECT conv_id, turn, role, n FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations) WHERE turn = 1")
def single_row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row by key with the number of rows that the key has, so that a caller can insist on one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id", "turn"))
    return table(spark, sf_dir, "conversations").where("turn = 1").withColumn("n", n).select("conv_id", "turn", "role", "n")


@register("""SELECT c_custkey, c_name, o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS page_rank
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'""")
def load_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A campaign with its documents and their ordered pages: customer, orders, line items."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    joined = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(item, F.col("o_orderkey") == F.col("l_orderkey"))
    rank = F.row_number().over(rank_of(["o_orderkey"], ["l_linenumber"]))
    return joined.select("c_custkey", "c_name", "o_orderkey", "l_linenumber", rank.alias("page_rank"))


@register("""SELECT user_id, event_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) r FROM events WHERE value > 1) WHERE r = 1""")
def latest_complete_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest complete cache run of each key (here user and event type)."""
    latest = F.row_number().over(rank_of(["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]))
    return table(spark, sf_dir, "events").where("value > 1").withColumn("r", latest).where("r = 1").select("user_id", "event_id", "event_type", "props")


@register(f"WITH {PARTS} SELECT id, CASE WHEN id % 2 = 0 THEN coalesce(name, brand, '') ELSE coalesce(CASE WHEN visible THEN brand END, '') END AS summary FROM pt")
def masked_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary column: a game master sees the full one, a player the visible one or nothing."""
    player = F.coalesce(F.when(F.col("visible"), F.col("brand")), F.lit(""))
    return parts(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.coalesce("name", "brand", F.lit(""))).otherwise(player).alias("summary"))


@register(f"WITH {PARTS} SELECT id, type IN (SELECT DISTINCT type FROM pt WHERE size > 45) AS known_type, size IN (1, 2, 3) AS small FROM pt")
def domain_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parts(spark, sf_dir)
    known = own.where("size > 45").select(F.col("type").alias("k_type")).distinct()
    return own.join(known, F.col("type") == F.col("k_type"), "left").select("id", F.col("k_type").isNotNull().alias("known_type"), F.col("size").isin(1, 2, 3).alias("small"))


@register("SELECT event_id, event_type FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT event_type, user_id % 4 AS k FROM events GROUP BY ALL HAVING sum(value) > avg(value) * 20) f WHERE f.event_type = e.event_type AND f.k = e.user_id % 4)")
def allowed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose (type, field) the domain table allows: a left semi join."""
    facts = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 4).alias("k"), "value")
    allowed = facts.groupBy("event_type", "k").agg(F.sum("value").alias("s"), F.avg("value").alias("a")).where("s > a * 20").select("event_type", "k")
    return facts.join(allowed, ["event_type", "k"], "left_semi").select("event_id", "event_type")


@register("SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL")
def document_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = [F.col(c).isNotNull() for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")]
    return table(spark, sf_dir, "orders").where(reduce(lambda a, b: a & b, needed)).select("o_orderkey")


@register(f"WITH {PARTS} SELECT id, name FROM pt WHERE contains(lower(name), '1') OR len(list_filter([brand, type], lambda x: contains(lower(x), '1'))) > 0")
def name_or_alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring of the name or of any alias, without case; an empty term finds nothing."""
    return search(parts(spark, sf_dir).withColumn("aliases", F.array("brand", "type")), " 1 ").select("id", "name")


def search(entities: DataFrame, term: str, least: int = 1) -> DataFrame:
    """Entities whose name or an alias holds the term; terms under least letters find nothing."""
    wanted = term.strip().lower()
    if len(wanted) < least:
        return entities.where(F.lit(False))
    return entities.where(F.contains(F.lower("name"), F.lit(wanted)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(wanted))))


@register(f"WITH {PARTS} SELECT id, name, type, size FROM pt WHERE contains(lower(name), 'brand#1') OR contains(lower(brand), 'brand#1') ORDER BY name, id LIMIT 8")
def typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of two letters or more; the first eight by name."""
    return search(parts(spark, sf_dir).withColumn("aliases", F.array("brand")), "Brand#1", least=2).orderBy("name", "id").limit(8).select("id", "name", "type", "size")


@register("""SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown field' WHEN value < 0 THEN 'bad value' WHEN user_id IS NULL THEN 'no owner' END AS reason FROM events""")
def curation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch rows with the first rule that they break; null: accepted."""
    reason = F.when(~F.col("event_type").isin("click", "view", "purchase"), "unknown field").when(F.col("value") < 0, "bad value").when(F.col("user_id").isNull(), "no owner")
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@register(f"""WITH {EDGES}, s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 500), p AS (SELECT id FROM pt WHERE size > 3), {PARTS}
  SELECT ord, CASE WHEN s_suppkey IS NULL THEN 'unknown source' WHEN p.id IS NULL THEN 'unknown target' ELSE 'kept' END AS outcome
  FROM ed LEFT JOIN s ON source_id = s_suppkey LEFT JOIN (SELECT p_partkey AS id FROM part WHERE p_size > 3) p ON target_id = p.id""".replace("p AS (SELECT id FROM pt WHERE size > 3), ", ""))
def endpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both endpoints resolved by equi-joins; a miss is kept with its reason."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 500").select("s_suppkey")
    p = parts(spark, sf_dir).where("size > 3").select("id")
    joined = edges(spark, sf_dir).join(s, F.col("source_id") == F.col("s_suppkey"), "left").join(p, F.col("target_id") == F.col("id"), "left")
    return joined.select("ord", F.when(F.col("s_suppkey").isNull(), "unknown source").when(F.col("id").isNull(), "unknown target").otherwise("kept").alias("outcome"))


@register("SELECT l_orderkey, l_linenumber, coalesce(p_name, 'Campaign PDF') AS filename FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 30) ON l_partkey = p_partkey")
def default_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size < 30").select("p_partkey", "p_name")
    return table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("Campaign PDF")).alias("filename"))


@register("SELECT n, count(*) AS edges, sum(CASE WHEN out THEN 1 ELSE 0 END) AS outgoing FROM (SELECT source_id AS n, true AS out FROM e UNION ALL SELECT target_id, false FROM e WHERE target_id <> source_id) GROUP BY n".replace("FROM (SELECT source_id", "FROM (WITH e AS (SELECT l_suppkey AS source_id, l_partkey AS target_id FROM lineitem) SELECT source_id"))
def either_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at a node whichever end it is: two endpoint rows an edge instead of an OR join; self edges count once."""
    e = edges(spark, sf_dir).select("source_id", "target_id")
    ends = e.select(F.explode(F.array(F.struct(F.col("source_id").alias("n"), F.lit(True).alias("out")), F.struct(F.col("target_id").alias("n"), F.lit(False).alias("out")))).alias("e"), (F.col("source_id") == F.col("target_id")).alias("own"))
    return ends.where("e.out OR NOT own").groupBy("e.n").agg(F.count(F.lit(1)).alias("edges"), F.count_if("e.out").alias("outgoing"))


@register(f"""WITH {PARTS}, a AS (SELECT id, unnest([lower(name), lower(brand || ' ' || size), lower(type || ' ' || brand || ' ' || size)]) AS alias FROM pt),
  q AS (SELECT p_partkey AS qid, lower(p_brand || ' ' || p_size) AS alias FROM part WHERE p_size > 20 UNION ALL SELECT p_partkey, lower(p_name) FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 'nobody' FROM part WHERE p_brand = 'Brand#3')
  SELECT qid, q.alias, count(DISTINCT a.id) AS matches, CASE count(DISTINCT a.id) WHEN 0 THEN 'unknown' WHEN 1 THEN 'match' ELSE 'ambiguous' END AS outcome FROM q LEFT JOIN a ON q.alias = a.alias GROUP BY ALL""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed names against all names and aliases: none, one or several entities."""
    p = parts(spark, sf_dir)
    aliases = p.select("id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(F.concat_ws(" ", "brand", "size")), F.lower(F.concat_ws(" ", "type", "brand", "size"))))).alias("alias"))
    ask = p.where("size > 20").select(F.col("id").alias("qid"), F.lower(F.concat_ws(" ", "brand", "size")).alias("asked"))
    ask = ask.unionByName(p.where("size < 10").select(F.col("id").alias("qid"), F.lower("name").alias("asked"))).unionByName(p.where("brand = 'Brand#3'").select(F.col("id").alias("qid"), F.lit("nobody").alias("asked")))
    found = aliases.groupBy("alias").agg(F.countDistinct("id").alias("matches"))
    n = F.coalesce("matches", F.lit(0))
    return ask.join(found, F.col("asked") == F.col("alias"), "left").groupBy("qid", F.col("asked").alias("alias")).agg(F.max(n).alias("matches")).withColumn(
        "outcome", F.when(F.col("matches") == 0, "unknown").when(F.col("matches") == 1, "match").otherwise("ambiguous")
    )


@register(f"""WITH {PARTS}, a AS (SELECT id, 1 AS tier, lower(name) AS k FROM pt WHERE size > 20 UNION ALL SELECT id, 2, lower(type) FROM pt WHERE size = 50 UNION ALL SELECT id, 3, lower(brand) FROM pt),
  q AS (SELECT id AS qid, unnest([lower(name), lower(type), lower(brand)]) AS k FROM pt), m AS (SELECT qid, tier, a.id FROM q JOIN a USING (k)),
  b AS (SELECT qid, min(tier) AS tier FROM m GROUP BY qid) SELECT b.qid, b.tier, count(DISTINCT m.id) AS matches FROM b JOIN m ON m.qid = b.qid AND m.tier = b.tier GROUP BY ALL""")
def tiered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact name, then alias, then looser forms; the first tier with a match decides."""
    p = parts(spark, sf_dir)
    keys = p.where("size > 20").select("id", F.lit(1).alias("tier"), F.lower("name").alias("k"))
    keys = keys.unionByName(p.where("size = 50").select("id", F.lit(2).alias("tier"), F.lower("type").alias("k"))).unionByName(p.select("id", F.lit(3).alias("tier"), F.lower("brand").alias("k")))
    asked = p.where("id IS NOT NULL").select(F.col("id").alias("qid"), F.explode(F.array(F.lower("name"), F.lower("type"), F.lower("brand"))).alias("k"))
    return first_tier(asked, keys)


def first_tier(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, tier, matches): the least tier of keys (id, tier, k) that one of the keys asked (qid, k) is in, and its distinct ids.

    Ids that hold the same keys of a tier are one class with a count, askers that hit the same keys another; only classes
    meet, so ids neither travel with the askers nor with the keys.  Null ids make a tier but count as none.
    """
    hit = asked.join(keys.select("tier", "k").distinct(), "k").groupBy("qid", "tier").agg(F.array_sort(F.collect_set("k")).alias("hit"))
    best = hit.groupBy("qid").agg(F.min(F.struct("tier", "hit")).alias("b")).select("qid", "b.tier", "b.hit")
    held = keys.where("id IS NOT NULL").groupBy("tier", "id").agg(F.array_sort(F.collect_set("k")).alias("held"))
    sizes = held.groupBy("tier", "held").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.explode("held"))
    met = best.select("tier", "hit").distinct().withColumn("k", F.explode("hit")).join(sizes, ["tier", "k"])
    counted = met.dropDuplicates(["tier", "hit", "held"]).groupBy("tier", "hit").agg(F.sum("n").alias("matches"))
    return best.join(counted, ["tier", "hit"], "left").select("qid", "tier", F.coalesce("matches", F.lit(0)).alias("matches"))


@register("""WITH p AS (SELECT DISTINCT l_partkey AS id, l_orderkey AS page FROM lineitem) SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared_pages FROM p a JOIN p b ON a.page = b.page AND a.id < b.id
  GROUP BY ALL HAVING count(*) >= 2""")
def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities on the same page, on two pages at least; a page (an order) has a handful of entities."""
    return pairs_of_pages(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("page")))


#: Members of pages in a task; pairs in a task.
MEMBERS, PAIRS = 500_000, 500_000


def pairs_of_pages(members: DataFrame, least: int = 2) -> DataFrame:
    """left_id, right_id, shared_pages of members (id, page) that share least pages; repeated members count once, nulls are none.

    Members and pairs are dealt among tasks by their number.  Pairs of a page are listed from its sorted members, without a join.
    """
    of = members.where("id IS NOT NULL AND page IS NOT NULL")
    sets = of.repartition(tasks_for(of, MEMBERS), "page").groupBy("page").agg(F.sort_array(F.collect_set("id")).alias("ids"))  # a page's own members
    n = F.size("ids").cast("long")
    listed = sets.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    each = sets.select("ids", F.posexplode("ids").alias("place", "left_id")).select("left_id", F.explode(F.slice("ids", F.col("place") + 2, F.size("ids"))).alias("right_id"))
    pairs = each.repartition(max(1, math.ceil(listed / PAIRS)), "left_id", "right_id")
    return pairs.groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("shared_pages")).where(F.col("shared_pages") >= least)


@register(f"WITH {EDGES}, {PARTS} SELECT ord FROM ed WHERE target_id IN (SELECT id FROM pt WHERE visible) AND source_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def visible_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = parts(spark, sf_dir).where("visible").select(F.col("id").alias("target_id"))
    makers = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("source_id"))
    return edges(spark, sf_dir).join(shown, "target_id", "left_semi").join(makers, "source_id", "left_semi").select("ord")


@register(f"WITH {EDGES}, f AS (SELECT DISTINCT source_id, target_id, lower(type) AS k FROM ed WHERE quantity <= 25) SELECT ord, f.k IS NOT NULL AS duplicate FROM ed LEFT JOIN f ON f.source_id = ed.source_id AND f.target_id = ed.target_id AND f.k = lower(type) WHERE quantity > 25")
def first_pass_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-pass rows flagged as duplicate of the first pass or novel; all stay."""
    e = edges(spark, sf_dir).withColumn("k", F.lower("type"))
    first = e.where("quantity <= 25").select("source_id", "target_id", "k", F.lit(True).alias("seen")).distinct()
    return e.where("quantity > 25").join(first, ["source_id", "target_id", "k"], "left").select("ord", F.coalesce("seen", F.lit(False)).alias("duplicate"))


@register("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount = 0.1 AND l_tax = 0.08)
  AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = p_partkey AND event_type = 'purchase')""")
def prunable_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with no anchor of any of three kinds."""
    item = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    facts = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("p_partkey"))
    own = table(spark, sf_dir, "part").select("p_partkey")
    for anchors in (item.where("l_quantity > 49").select("p_partkey"), item.where("l_discount = 0.1 AND l_tax = 0.08").select("p_partkey"), facts):
        own = own.join(anchors, "p_partkey", "left_anti")
    return own


@register("""WITH w AS (SELECT c_custkey AS id, [c_custkey, c_custkey + 7] AS ids FROM customer), h AS (SELECT o_orderkey AS run, o_orderdate AS made, o_custkey AS k FROM orders)
  SELECT w.id, arg_min(run, (made, run)) AS first_run FROM w JOIN h ON list_contains(w.ids, h.k) GROUP BY w.id""")
def overlapping_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest row whose id is among a row's candidate ids: ids exploded, then an equi-join."""
    want = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 7)).alias("k"))
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("run")).alias("o"))
    return want.join(have, "k").groupBy("id").agg(F.min("o").alias("o")).select("id", F.col("o.run").alias("first_run"))


@register("""WITH want AS (SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1), got AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT -o_orderkey FROM orders WHERE o_totalprice < 2000),
  w AS (SELECT k, count(*) n FROM want GROUP BY k), g AS (SELECT k, count(*) m FROM got GROUP BY k)
  SELECT coalesce(w.k, g.k) AS key, CASE WHEN m IS NULL THEN 'missing' WHEN n IS NULL THEN 'unexpected' WHEN m > 1 THEN 'duplicate' ELSE 'ok' END AS state FROM w FULL JOIN g ON w.k = g.k""")
def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected keys against returned keys, each exactly once: missing, unexpected, duplicate or ok."""
    o = table(spark, sf_dir, "orders")
    want = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    got = o.where("o_orderstatus <> 'P'").select("o_orderkey").union(o.where("o_totalprice > 400000").select("o_orderkey")).union(o.where("o_totalprice < 2000").select(-F.col("o_orderkey")))
    got = got.groupBy(F.col("o_orderkey").alias("g")).agg(F.count(F.lit(1)).alias("m"))
    state = F.when(F.col("m").isNull(), "missing").when(F.col("n").isNull(), "unexpected").when(F.col("m") > 1, "duplicate").otherwise("ok")
    return want.join(got, F.col("k") == F.col("g"), "full_outer").select(F.coalesce("k", "g").alias("key"), state.alias("state"))


@register("""SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS near FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag
  AND b.l_linenumber BETWEEN a.l_linenumber - 2 AND a.l_linenumber + 1""")
def order_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units from two before to one after in the same context: the offsets are exploded, so it is an equi-join."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    wanted = a.select("l_orderkey", "l_returnflag", "l_linenumber", F.explode(F.sequence(F.col("l_linenumber") - 2, F.col("l_linenumber") + 1)).alias("near"))
    b = a.select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("near"))
    return wanted.join(b, ["l_orderkey", "l_returnflag", "near"]).select("l_orderkey", "l_linenumber", "near")


@register("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events""")
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of lookup: the latest anchor strictly before each row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("before"))


@register(f"WITH {EDGES} SELECT ord, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = page AND o_custkey % 10 = source_id % 10) AS owned FROM ed")
def evidence_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the cited evidence belongs to the owner that cites it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 10).alias("owner"), F.lit(True).alias("owned")).distinct()
    e = edges(spark, sf_dir).withColumn("owner", F.col("source_id") % 10)
    return e.join(o, ["page", "owner"], "left").select("ord", F.coalesce("owned", F.lit(False)).alias("owned"))


@register("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def counts_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@register("SELECT place, event_type, n FROM (VALUES (1, 'purchase'), (2, 'view'), (3, 'click'), (4, 'nothing')) d(place, t) JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) ON t = event_type WHERE n > 0")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in a fixed order of categories, empty ones left out."""
    dim = spark.createDataFrame([(1, "purchase"), (2, "view"), (3, "click"), (4, "nothing")], "place int, t string")
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(dim), F.col("t") == F.col("event_type")).select("place", "event_type", "n")


@register("SELECT l_partkey, count(DISTINCT l_orderkey) AS pages, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY l_partkey")
def distinct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("pages"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))


@register(f"WITH {EDGES} SELECT source_id, target_id, min(ord) AS ord FROM ed GROUP BY source_id, target_id")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key by its ordinal."""
    return edges(spark, sf_dir).groupBy("source_id", "target_id").agg(F.min("ord").alias("ord"))


@register(f"""WITH {EDGES} SELECT source_id, target_id, lower(type) AS k, max(confidence) AS confidence, count(*) AS n, arg_max(type || '-' || quantity, (length(type || '-' || quantity), -ord)) AS label,
  list_sort(list(DISTINCT page)) AS pages FROM (SELECT ord, source_id, target_id, type, confidence, page, CAST(quantity AS BIGINT) AS quantity FROM ed) GROUP BY ALL""")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges merged by (source, target, type): best confidence, longest label (the first of equals), all pages."""
    e = edges(spark, sf_dir).withColumn("label", F.concat_ws("-", "type", F.col("quantity").cast("long")))
    return e.groupBy("source_id", "target_id", F.lower("type").alias("k")).agg(
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"), F.max(F.struct(F.length("label"), -F.col("ord"), "label")).getField("label").alias("label"),
        F.sort_array(F.collect_set("page")).alias("pages"),
    )


@register("""SELECT user_id, CASE WHEN count(*) = 0 THEN 0 WHEN count(v) < count(*) THEN NULL ELSE sum(v) END AS total FROM (SELECT user_id, CASE WHEN event_id % 97 <> 0 THEN CAST(value * 100 AS BIGINT) END AS v FROM events) GROUP BY user_id""")
def null_propagating_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum that is unknown as soon as one part is; no parts give 0."""
    usage = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 97 != 0, F.round(F.col("value") * 100).cast("long")).alias("v"))
    return usage.groupBy("user_id").agg(F.when(F.count(F.lit(1)) == 0, 0).when(F.count("v") < F.count(F.lit(1)), None).otherwise(F.sum("v")).alias("total"))


@register(f"WITH {PARTS} SELECT type, count(*) FILTER (visible) AS shown, count(*) FILTER (NOT visible AND size > 25) AS hidden_large, count(*) AS n FROM pt GROUP BY type")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).groupBy("type").agg(F.count_if("visible").alias("shown"), F.count_if(~F.col("visible") & (F.col("size") > 25)).alias("hidden_large"), F.count(F.lit(1)).alias("n"))


@register("""SELECT quality, toxic, n, round(CASE WHEN q = 0 THEN 0 ELSE n * 1.0 / q END, 6) AS share FROM (SELECT quality, toxic, count(*) AS n, sum(count(*)) OVER (PARTITION BY quality) AS q FROM labels GROUP BY quality, toxic)""")
def guarded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    q = F.sum("n").over(Window.partitionBy("quality"))
    return own.select("quality", "toxic", "n", F.round(F.when(q == 0, 0.0).otherwise(F.col("n") / q), 6).alias("share"))


@register("SELECT l_suppkey, round(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) * 1.0 / sum(CAST(l_quantity AS BIGINT)), 6) AS weighted FROM lineitem GROUP BY l_suppkey")
def weighted_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, x = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(w * x) / F.sum(w), 6).alias("weighted"))


@register("SELECT reason, count(*) AS n FROM (SELECT unnest([l_returnflag, l_linestatus, CASE WHEN l_discount > 0.08 THEN 'steep' END]) AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY reason")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_compact(F.array("l_returnflag", "l_linestatus", F.when(F.col("l_discount") > 0.08, "steep")))
    return table(spark, sf_dir, "lineitem").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT role, list(turn ORDER BY turn) AS turns, count(*) AS n FROM (SELECT DISTINCT role, turn FROM conversations) GROUP BY role")
def collected_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows of a group in a stated order."""
    own = table(spark, sf_dir, "conversations").select("role", "turn").distinct()
    return own.groupBy("role").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.count(F.lit(1)).alias("n"))


@register("SELECT t, sum(CASE WHEN c = 'small' THEN 1 ELSE 0 END) AS small, sum(CASE WHEN c = 'large' THEN 1 ELSE 0 END) AS large FROM (SELECT p_type AS t, CASE WHEN p_size < 20 THEN 'small' ELSE 'large' END AS c FROM part) GROUP BY t")
def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.col("p_type").alias("t"), F.when(F.col("p_size") < 20, "small").otherwise("large").alias("c"))
    return own.groupBy("t").pivot("c", ["small", "large"]).count().na.fill(0)


@register("""SELECT c_nationkey, c_custkey, round(c_acctbal - coalesce(lead(c_acctbal) OVER w, c_acctbal), 2) AS margin FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) QUALIFY row_number() OVER w = 1""")
def best_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest candidate of each group and its lead over the runner-up."""
    w = rank_of(["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"])
    own = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("r"))
    two = own.where("r <= 2").groupBy("c_nationkey")  # every task sends its best two rows of a nation
    of = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    best = two.agg(of(1, "c_custkey").alias("c_custkey"), of(1, "c_acctbal").alias("first"), of(2, "c_acctbal").alias("next"))
    return best.select("c_nationkey", "c_custkey", F.round(F.col("first") - F.coalesce("next", "first"), 2).alias("margin"))


@register(f"WITH {EDGES} SELECT source_id, target_id, arg_min(ord, (-confidence, ord)) AS ord FROM ed GROUP BY source_id, target_id")
def strongest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest edge of each pair; of equals the first."""
    return edges(spark, sf_dir).groupBy("source_id", "target_id").agg(F.min(F.struct(-F.col("confidence"), "ord")).getField("ord").alias("ord"))


@register("SELECT doc_id, line_no, max(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near_blank FROM (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) p FROM documents))")
def neighbour_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-4, 4)
    return own.select("doc_id", "line_no", F.max(F.when(F.col("line") == "", 1).otherwise(0)).over(w).alias("near_blank"))


@register("SELECT l_suppkey, l_partkey, n, r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS r FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r <= 20")
def top_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most relevant of each group by count, then id."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(rank_of(["l_suppkey"], [F.desc("n"), "l_partkey"]))).where("r <= 20")


@register("SELECT p_partkey, p FROM (SELECT p_partkey, (CASE WHEN p_size < 5 THEN 10000 WHEN p_size < 15 THEN 3000 ELSE 1000 END) + 20 * (p_partkey % 9) + p_size AS p FROM part) ORDER BY p DESC, p_partkey LIMIT 24")
def target_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority by signal, uncovered pages and occurrences; the first 24."""
    signal = F.when(F.col("p_size") < 5, 10000).when(F.col("p_size") < 15, 3000).otherwise(1000)
    own = table(spark, sf_dir, "part").select("p_partkey", (signal + 20 * (F.col("p_partkey") % 9) + F.col("p_size")).alias("p"))
    return own.orderBy(F.desc("p"), "p_partkey").limit(24)


@register("""WITH q AS (SELECT event_id, length(props) AS tokens, round(value / (SELECT max(value) FROM events), 6) AS quality FROM events WHERE value IS NOT NULL)
  SELECT event_id, quality FROM q WHERE (SELECT max(quality) FROM q) - quality < 0.02 ORDER BY tokens, quality DESC, event_id LIMIT 1""")
def near_best_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among candidates whose quality (0 to 1) is less than 0.02 below the best, the fewest tokens, then the best, then the first."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.length("props").alias("tokens"), "value")
    top = F.broadcast(e.agg(F.max("value").alias("top")))  # one row
    q = e.join(top).select("event_id", "tokens", F.round(F.col("value") / F.col("top"), 6).alias("quality"))
    best = F.broadcast(q.agg(F.max("quality").alias("best")))  # one row
    return q.join(best, F.col("best") - F.col("quality") < 0.02).orderBy("tokens", F.desc("quality"), "event_id").limit(1).select("event_id", "quality")


@register("SELECT event_type AS pattern, n FROM (SELECT event_type, count(*) AS n, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place FROM events WHERE event_type <> 'purchase' GROUP BY event_type) ORDER BY n DESC, place LIMIT 1")
def most_frequent_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    n = table(spark, sf_dir, "events").where("event_type <> 'purchase'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), place).limit(1).select(F.col("event_type").alias("pattern"), "n")


@register("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY lower(c_name), c_custkey LIMIT 4")
def top_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").orderBy(F.lower("c_name"), "c_custkey").limit(4).select("c_custkey", "c_name")


@register("SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 3")
def preview_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three preview rows for each related entity."""
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(rank_of(["o_custkey"], ["o_orderdate", "o_orderkey"])).alias("r")).where("r <= 3")


@register("SELECT r_regionkey, r_name, count(n_nationkey) AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL ORDER BY r_name LIMIT 8")
def first_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    own = table(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return own.orderBy("r_name").limit(8).select("r_regionkey", "r_name", F.coalesce("n", F.lit(0)).alias("children"))


@register("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 9 END, ts, event_id) AS place FROM events""")
def field_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in the fields' own order, then by their sort order, then id."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(9)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(rank_of(["user_id"], [rank, "ts", "event_id"])).alias("place"))


@register(f"""WITH {PAGES}, o AS (SELECT l_partkey AS target, l_orderkey AS page, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem)
  SELECT target, page, r FROM o ORDER BY r, target LIMIT 12""")
def round_robin_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One excerpt of each target in turn, twelve in all."""
    own = table(spark, sf_dir, "lineitem")
    r = F.row_number().over(rank_of(["l_partkey"], ["l_orderkey", "l_linenumber"]))
    return own.select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("page"), r.alias("r")).orderBy("r", "target").limit(12)


@register("SELECT pass, count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT 1 AS pass, l_partkey AS k FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT 2, l_partkey FROM lineitem WHERE l_quantity >= 5) GROUP BY pass")
def union_of_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes one after another; what both found stays twice."""
    item = table(spark, sf_dir, "lineitem")
    first = item.where("l_quantity < 10").select(F.lit(1).alias("pass"), F.col("l_partkey").alias("k"))
    both = first.unionByName(item.where("l_quantity >= 5").select(F.lit(2).alias("pass"), F.col("l_partkey").alias("k")))
    return both.groupBy("pass").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("keys"))


@register("SELECT p_type, p_brand, p_size FROM part WHERE p_size < 20 UNION SELECT p_type, p_brand, p_size FROM part WHERE p_type = 'PROMO'")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, cols = table(spark, sf_dir, "part"), ["p_type", "p_brand", "p_size"]
    return p.where("p_size < 20").select(*cols).union(p.where("p_type = 'PROMO'").select(*cols)).distinct()


@register("""WITH a AS (SELECT DISTINCT p_type AS t, p_brand AS b FROM part WHERE p_size < 25), n AS (SELECT p_partkey AS k, p_type AS t, p_brand AS b, p_size AS s, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS r FROM part WHERE p_size >= 25)
  SELECT k, CASE WHEN s > 45 THEN 'not grounded' WHEN a.t IS NOT NULL THEN 'known' WHEN r > 1 THEN 'repeated' ELSE 'added' END AS outcome FROM n LEFT JOIN a ON a.t = n.t AND a.b = n.b""")
def inventory_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions to an inventory, with the reason why one does not enter."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("t"), F.col("p_brand").alias("b"), F.col("p_size").alias("s"))
    known = p.where("s < 25").select("t", "b", F.lit(True).alias("known")).distinct()
    new = p.where("s >= 25")
    groups = new.groupBy("t", "b").agg(F.min("k").alias("first")).join(known, ["t", "b"], "left")  # a row per type and brand, counted in each task first
    outcome = F.when(F.col("s") > 45, "not grounded").when(F.col("known"), "known").when(F.col("k") > F.col("first"), "repeated").otherwise("added")
    return new.join(groups, ["t", "b"]).select("k", outcome.alias("outcome"))


@register("SELECT conv_id, turn, sum(1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS local_idx, (SELECT count(*) FROM conversations c2 WHERE c2.conv_id < c.conv_id) + sum(1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS global_idx FROM conversations c")
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapless index over (request, local place) without one task for all rows: request sizes are summed up first."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    # a row per request; ranges of requests are summed apart where they are many
    offset = running_sum(sizes.withColumn("all", F.lit(0)), "all", [F.col("conv_id")], "n", "offset").select(F.col("conv_id").alias("c"), "offset")
    local = F.row_number().over(rank_of(["conv_id"], ["turn"])) - 1
    return own.withColumn("local_idx", local).join(offset, F.col("conv_id") == F.col("c")).select("conv_id", "turn", "local_idx", (F.col("offset") + F.col("local_idx")).alias("global_idx"))


@register("SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AND (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS same")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    return a.subtract(b).unionByName(b.subtract(a)).agg((F.count(F.lit(1)) == 0).alias("same"))


@register("WITH s AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_partkey)) AS p FROM lineitem GROUP BY l_suppkey) SELECT k, len(list_intersect(p, (SELECT p FROM s WHERE k = 1))) AS shared FROM s")
def page_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_partkey").alias("p"))
    one = sets.where("k = 1").select(F.col("p").alias("q"))
    return sets.crossJoin(F.broadcast(one)).select("k", F.size(F.array_intersect("p", "q")).alias("shared"))


@register("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_partkey"))


@register(f"WITH {PAGES} SELECT document_id, page, (SELECT count(*) FROM pg q WHERE q.document_id = pg.document_id) AS pages FROM pg")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("document_id", "page", F.count(F.lit(1)).over(Window.partitionBy("document_id")).alias("pages"))



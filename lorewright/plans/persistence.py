"""Snapshot replacement, overrides, upserts, checkpoint reuse, budgets and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.plans.base import rank_of, registrar, table

QUERIES: dict = {}
register = registrar(QUERIES)


def snapshot_merge(current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], anchored: Column) -> DataFrame:
    """The new snapshot of a keyed replace: updated, inserted, kept or pruned.

    Incoming rows win over current ones of the same key; a current row that does not come again stays only if it is
    anchored by something outside this document.  Columns: keys, values, state.
    """
    cur = current.select(*[F.col(k).alias(f"c_{k}") for k in keys], *[F.col(v).alias(f"c_{v}") for v in values], anchored.alias("anchored"), F.lit(True).alias("had"))
    new = incoming.select(*keys, *values, F.lit(True).alias("comes"))
    joined = new.join(cur, [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys], "full_outer")
    state = F.when(F.col("comes") & F.col("had"), "updated").when(F.col("comes"), "inserted").when(F.col("anchored"), "kept").otherwise("pruned")
    pick = lambda c: F.when(F.col("comes"), F.col(c)).otherwise(F.col(f"c_{c}")).alias(c)
    return joined.select(*[pick(k) for k in keys], *[pick(v) for v in values], state.alias("state"))


@register("""WITH cur AS (SELECT o_orderkey AS k, o_orderstatus AS v, o_totalprice > 200000 AS anchored FROM orders WHERE o_orderstatus <> 'P'), inc AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_totalprice > 100000)
  SELECT coalesce(inc.k, cur.k) AS k, CASE WHEN inc.k IS NOT NULL THEN inc.v ELSE cur.v END AS v, CASE WHEN inc.k IS NOT NULL AND cur.k IS NOT NULL THEN 'updated' WHEN inc.k IS NOT NULL THEN 'inserted' WHEN anchored THEN 'kept' ELSE 'pruned' END AS state
  FROM inc FULL JOIN cur ON inc.k = cur.k""")
def keyed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cur = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), "o_totalprice")
    inc = o.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return snapshot_merge(cur, inc, ["k"], ["v"], F.col("o_totalprice") > 200000)


@register("""WITH inc AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type, [c_custkey + 100000, c_custkey * 2] AS ids FROM customer WHERE c_acctbal > 3000), cur AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type, c_acctbal AS made FROM customer WHERE c_mktsegment <> 'BUILDING'),
  m AS (SELECT inc.id AS new_id, cur.id AS old_id, 1 AS tier, made FROM inc JOIN cur ON inc.id = cur.id UNION ALL SELECT inc.id, cur.id, 2, made FROM inc JOIN cur ON inc.name = cur.name AND inc.type = cur.type
  UNION ALL SELECT inc.id, cur.id, 3, made FROM inc JOIN cur ON list_contains(inc.ids, cur.id)) SELECT new_id, arg_min(old_id, (tier, made, old_id)) AS old_id, min(tier) AS tier FROM m GROUP BY new_id""")
def entity_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows for incoming entities: by id, else by name and type, else the oldest whose id is a candidate's."""
    c = table(spark, sf_dir, "customer")
    inc = c.where("c_acctbal > 3000").select(F.col("c_custkey").alias("new_id"), "c_name", "c_mktsegment", F.array(F.col("c_custkey") + 100000, F.col("c_custkey") * 2).alias("ids"))
    cur = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("old_id"), F.col("c_name").alias("o_name"), F.col("c_mktsegment").alias("o_type"), F.col("c_acctbal").alias("made"))

    def tier(joined: DataFrame, n: int) -> DataFrame:
        return joined.select("new_id", F.struct(F.lit(n).alias("tier"), "made", "old_id").alias("m"))

    found = tier(inc.join(cur, F.col("new_id") == F.col("old_id")), 1)
    found = found.unionByName(tier(inc.join(cur, (F.col("c_name") == F.col("o_name")) & (F.col("c_mktsegment") == F.col("o_type"))), 2))
    found = found.unionByName(tier(inc.select("new_id", F.explode("ids").alias("k")).join(cur, F.col("k") == F.col("old_id")), 3))
    return found.groupBy("new_id").agg(F.min("m").alias("m")).select("new_id", "m.old_id", "m.tier")


@register("SELECT l_orderkey, l_linenumber, o_orderkey IS NULL AS unknown_endpoint FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def unknown_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", F.col("o_orderkey").isNull().alias("unknown_endpoint"))


def insist(df: DataFrame, wrong: Column, message: str) -> DataFrame:
    """df, which fails as a whole when a row is wrong."""
    return df.where(F.assert_true(~wrong, F.lit(message)).isNull())


@register("SELECT p_partkey, coalesce(n, 0) AS mentions, CASE WHEN p_type = 'PROMO' THEN 'not_started' END AS quest_status FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def metrics_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    own = table(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left")
    return own.select("p_partkey", F.coalesce("n", F.lit(0)).alias("mentions"), F.when(F.col("p_type") == "PROMO", "not_started").alias("quest_status"))


@register("SELECT n.p_partkey, CASE WHEN o.p_size % 5 = 0 THEN o.p_brand ELSE n.p_type END AS visibility, CASE WHEN o.p_size % 7 = 0 THEN o.p_name ELSE 'minor' END AS prominence FROM part n LEFT JOIN (SELECT * FROM part WHERE p_type <> 'PROMO') o USING (p_partkey)")
def kept_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were set by hand survive a replacement."""
    p = table(spark, sf_dir, "part")
    old = p.where("p_type <> 'PROMO'").select("p_partkey", F.col("p_brand").alias("o_brand"), F.col("p_name").alias("o_name"), F.col("p_size").alias("o_size"))
    joined = p.join(old, "p_partkey", "left")
    return joined.select(
        "p_partkey", F.when(F.col("o_size") % 5 == 0, F.col("o_brand")).otherwise(F.col("p_type")).alias("visibility"),
        F.when(F.col("o_size") % 7 == 0, F.col("o_name")).otherwise("minor").alias("prominence"),
    )


@register("SELECT user_id, event_type, props, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert on a composite key: of all writes the last."""
    last = F.row_number().over(rank_of(["user_id", "event_type", "props"], [F.desc("ts"), F.desc("event_id")]))
    return table(spark, sf_dir, "events").withColumn("r", last).where("r = 1").select("user_id", "event_type", "props", "event_id")


@register("""WITH st AS (SELECT user_id, event_type, props, value FROM events WHERE value < 10), ask AS (SELECT event_id, user_id, event_type, props FROM events WHERE value >= 10)
  SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.user_id = ask.user_id AND st.event_type = ask.event_type AND st.props = ask.props) THEN 'REUSE' WHEN EXISTS (SELECT 1 FROM st WHERE st.user_id = ask.user_id AND st.event_type = ask.event_type AND st.value < 0.2) THEN 'INVALIDATED' ELSE 'RUN' END AS status FROM ask""")
def checkpoint_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REUSE on an exact key, INVALIDATED where only the operation is stored, else RUN."""
    e = table(spark, sf_dir, "events")
    stored = e.where("value < 10").select("user_id", "event_type", "props", "value")
    exact = stored.drop("value").distinct().withColumn("exact", F.lit(True))
    some = stored.where("value < 0.2").select("user_id", "event_type", F.lit(True).alias("some")).distinct()
    ask = e.where("value >= 10").join(exact, ["user_id", "event_type", "props"], "left").join(some, ["user_id", "event_type"], "left")
    return ask.select("event_id", F.when(F.col("exact"), "REUSE").when(F.col("some"), "INVALIDATED").otherwise("RUN").alias("status"))


@register("""WITH s1 AS (SELECT user_id, sha256(string_agg(props, ',' ORDER BY event_id)) AS h1 FROM events WHERE event_type = 'view' GROUP BY user_id), s2 AS (SELECT user_id, sha256(string_agg(props, ',' ORDER BY event_id)) AS own FROM events WHERE event_type = 'click' GROUP BY user_id)
  SELECT user_id, h1, sha256(h1 || '|' || own) AS h2 FROM s1 JOIN s2 USING (user_id)""")
def chained_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's key includes the fingerprint of the stage before."""
    def told(kind: str) -> DataFrame:
        own = table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "props"))).alias("p"))
        return own.select("user_id", F.sha2(F.array_join(F.transform("p", lambda x: x["props"]), ","), 256).alias(kind))

    joined = told("view").join(told("click"), "user_id")
    return joined.select("user_id", F.col("view").alias("h1"), F.sha2(F.concat_ws("|", "view", "click"), 256).alias("h2"))


@register("""SELECT user_id, count(*) AS planned, count(*) FILTER (event_type = 'error') AS runs, CASE WHEN count(*) FILTER (event_type = 'error') > 12 THEN 'BLOCK' ELSE 'ALLOW' END AS verdict FROM events GROUP BY user_id""")
def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("planned"), runs.alias("runs"), F.when(runs > 12, "BLOCK").otherwise("ALLOW").alias("verdict"))


@register("""WITH r AS (SELECT event_id, user_id, (CAST(ceil(CAST(round(value * 100) AS BIGINT) * 1.2) AS BIGINT) + 500) * 2 AS reserved FROM events) SELECT event_id, reserved, 100000 - sum(reserved) OVER (PARTITION BY user_id ORDER BY event_id) AS left_over FROM r""")
def token_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ceil(in x multiplier) + most out) x (retries + 1), and what is left after each call in order."""
    reserved = (F.ceil(F.round(F.col("value") * 100).cast("long") * F.lit("1.2").cast("decimal(2,1)")) + 500) * 2
    own = table(spark, sf_dir, "events").select("event_id", "user_id", reserved.cast("long").alias("reserved"))
    return own.select("event_id", "reserved", (F.lit(100000) - F.sum("reserved").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("left_over"))


@register("SELECT event_id, CAST(least(4000, greatest(0, floor((50000 - CAST(round(value * 100) AS BIGINT)) / 10)), 200 * (user_id % 30)) AS BIGINT) AS allowance FROM events")
def output_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least of three limits."""
    money = F.greatest(F.lit(0), F.floor((F.lit(50000) - F.round(F.col("value") * 100).cast("long")) / 10))
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(4000), money, 200 * (F.col("user_id") % 30)).cast("long").alias("allowance"))


@register("""WITH pr(alias, i, c, w, o) AS (VALUES ('view', 10, 1, 12, 50), ('click', 4, 2, 5, 20), ('purchase', 2, 1, 3, 12)),
  u AS (SELECT event_id, event_type || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-2024' ELSE '-x' END AS model, CAST(round(value * 100) AS BIGINT) AS input, user_id % 50 AS cached, user_id % 7 AS written, event_id % 1000 AS output FROM events)
  SELECT event_id, (greatest(0, input - cached - written) * i + cached * c + written * w) * CASE WHEN input > 10000 THEN 2 ELSE 1 END + output * o * CASE WHEN input > 10000 THEN 1.5 ELSE 1 END AS cost
  FROM u LEFT JOIN pr ON model = alias OR starts_with(model, alias || '-20')""")
def call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost by the prices of the model, or of its dated alias: beyond a size input costs twice and output one and a half times as much.  An unknown model has an unknown cost."""
    prices = spark.createDataFrame([("view", 10, 1, 12, 50), ("click", 4, 2, 5, 20), ("purchase", 2, 1, 3, 12)], "alias string, i int, c int, w int, o int")
    suffix = F.element_at(F.array(F.lit(""), F.lit("-2024"), F.lit("-x")), (F.col("event_id") % 3 + 1).cast("int"))
    calls = table(spark, sf_dir, "events").select(
        "event_id", F.concat("event_type", suffix).alias("model"), F.round(F.col("value") * 100).cast("long").alias("input"), (F.col("user_id") % 50).alias("cached"),
        (F.col("user_id") % 7).alias("written"), (F.col("event_id") % 1000).alias("output"),
    )
    known = F.regexp_replace("model", "-20.*$", "")  # a dated model has its alias's prices: an equi-join
    own = calls.join(F.broadcast(prices), known == F.col("alias"), "left")
    fresh = F.greatest(F.lit(0), F.col("input") - F.col("cached") - F.col("written"))
    long = F.col("input") > 10000
    read = (fresh * F.col("i") + F.col("cached") * F.col("c") + F.col("written") * F.col("w")) * F.when(long, 2).otherwise(1)
    return own.select("event_id", (read + F.col("output") * F.col("o") * F.when(long, 1.5).otherwise(1.0)).alias("cost"))


@register("""WITH m AS (SELECT event_id, event_type AS model, CASE WHEN event_id % 5 <> 0 THEN user_id END AS a, CASE WHEN event_id % 7 <> 0 THEN event_id % 100 END AS b FROM events) SELECT event_id, a + b AS tokens, model || '+' || model AS models FROM m""")
def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls' usage: unknown if either is."""
    a, b = F.when(F.col("event_id") % 5 != 0, F.col("user_id")), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 100)
    return table(spark, sf_dir, "events").select("event_id", (a + b).alias("tokens"), F.concat_ws("+", "event_type", "event_type").alias("models"))


@register("""WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'error') AS e, count(*) AS n FROM events GROUP BY user_id)
  SELECT user_id, CASE WHEN e = 0 THEN 'REUSE' ELSE 'RUN' END AS extract_status, CASE WHEN e > 0 OR v > 15 THEN 'RUN' ELSE 'REUSE' END AS enrich_status, CAST(ceil(n / 12.0) AS BIGINT) AS most_calls FROM s""")
def dependent_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage runs when its parent does; calls are bounded by batches of twelve."""
    t = F.col("event_type")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(t == "view").alias("v"), F.count_if(t == "error").alias("e"), F.count(F.lit(1)).alias("n"))
    return s.select(
        "user_id", F.when(F.col("e") == 0, "REUSE").otherwise("RUN").alias("extract_status"), F.when((F.col("e") > 0) | (F.col("v") > 15), "RUN").otherwise("REUSE").alias("enrich_status"),
        F.ceil(F.col("n") / 12).alias("most_calls"),
    )


@register("""SELECT event_type, count(*) AS calls, CASE WHEN count(c) < count(*) THEN NULL ELSE sum(c) END AS cost FROM (SELECT event_type, CASE WHEN event_type <> 'error' OR event_id % 2 = 0 THEN CAST(round(value * 100) AS BIGINT) END AS c FROM events) GROUP BY event_type""")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when((F.col("event_type") != "error") | (F.col("event_id") % 2 == 0), F.round(F.col("value") * 100).cast("long"))
    own = table(spark, sf_dir, "events").select("event_type", c.alias("c"))
    return own.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.when(F.count("c") < F.count(F.lit(1)), None).otherwise(F.sum("c")).alias("cost"))


@register("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL OR s_suppkey IS NULL THEN 'unknown' WHEN p_size > 5 AND s_acctbal > 0 THEN 'revealed' ELSE 'blocked' END AS outcome
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def reveal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relationship can be revealed only where both ends can be seen (here parts over size 5, suppliers with a balance over 0)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 5).alias("target"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 0).alias("source"))
    own = table(spark, sf_dir, "lineitem").join(p, "l_partkey", "left").join(s, "l_suppkey", "left")
    outcome = F.when(F.col("target").isNull() | F.col("source").isNull(), "unknown").when(F.col("target") & F.col("source"), "revealed").otherwise("blocked")
    return own.select("l_orderkey", "l_linenumber", outcome.alias("outcome"))


@register("SELECT doc_id, coalesce(quality, 0) AS quality, CASE WHEN quality IS NULL THEN 3 ELSE 4 END AS cache_schema_version FROM documents LEFT JOIN labels USING (doc_id)")
def schema_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older schema get the missing fields' defaults."""
    own = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return own.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.when(F.col("quality").isNull(), 3).otherwise(4).alias("cache_schema_version"))


@register("""WITH x AS (SELECT p_partkey // 100 AS slice, lpad(CAST(p_partkey AS VARCHAR), 12, '0') || ':' || p_type || '|' || p_brand AS x FROM part), h AS (SELECT slice, sha256(string_agg(x, ',' ORDER BY x)) AS h, count(*) AS n FROM x GROUP BY slice)
  SELECT slice // 100 AS part_no, sha256(string_agg(h, ',' ORDER BY slice)) AS fingerprint, sum(n) AS n FROM h GROUP BY 1""")
def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes over the sorted projection of a graph's entities: of slices of keys, then of the slices' hashes, as a tree."""
    row = F.concat_ws(":", F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.concat_ws("|", "p_type", "p_brand"))
    own = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("slice"), row.alias("x"))
    leaves = own.groupBy("slice").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), ","), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    nodes = leaves.groupBy(F.floor(F.col("slice") / 100).alias("part_no")).agg(F.sort_array(F.collect_list(F.struct("slice", "h"))).alias("hs"), F.sum("n").alias("n"))
    return nodes.select("part_no", F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), ","), 256).alias("fingerprint"), "n")


@register("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders UNION ALL SELECT o_orderkey, 'seen', o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log with a batch appended."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return o.unionByName(o.where("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("seen")))

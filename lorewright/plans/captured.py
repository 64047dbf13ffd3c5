"""Validation of captured compact outputs, re-resolution after merges, revalidation before reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.plans.base import EDGES, PAGES, PARTS, edges, pages, parts, registrar, table
from lorewright.plans.persistence import insist

QUERIES: dict = {}
register = registrar(QUERIES)

_NAME = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def first_is_accepted(rows: DataFrame, reason: Column, key: list[str], order: list) -> DataFrame:
    """rows with their outcome: the reason, or "duplicate" for those after the first valid one of a key, or "accepted"."""
    coded = rows.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy(F.col("reason").isNull(), *key).orderBy(*order))
    return coded.withColumn("outcome", F.coalesce("reason", F.when(place == 1, "accepted").otherwise("duplicate"))).drop("reason")


@register(f"""WITH {PAGES}, a AS (SELECT document_id, page, document_id % 50 AS entity, page + CASE WHEN (document_id + page) % 4 = 0 THEN 1 ELSE 0 END AS span, array_to_string(string_split(text, ' ')[1:2], ' ') AS alias FROM pg),
  r AS (SELECT a.*, CASE WHEN entity % 11 = 0 THEN 'unknown entity' WHEN s.page IS NULL THEN 'unknown span' WHEN NOT contains({_NAME.format('s.text')}, {_NAME.format('alias')}) THEN 'absent from span' END AS reason,
    {_NAME.format('alias')} AS k FROM a LEFT JOIN pg s ON s.document_id = a.document_id AND s.page = span)
  SELECT document_id, page, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL, entity, k ORDER BY document_id, page) = 1 THEN 'accepted' ELSE 'duplicate' END) AS outcome FROM r""")
def compact_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed aliases: the owner and the span are known, the alias stands in the span, and it is the owner's first of that key."""
    own = pages(spark, sf_dir).select(
        "document_id", "page", (F.col("document_id") % 50).alias("entity"), (F.col("page") + F.when((F.col("document_id") + F.col("page")) % 4 == 0, 1).otherwise(0)).alias("span"),
        F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("alias"),
    )
    spans = pages(spark, sf_dir).select("document_id", F.col("page").alias("span"), T.normalize_name(F.col("text")).alias("said"))
    met = own.join(spans, ["document_id", "span"], "left").withColumn("k", T.normalize_name(F.col("alias")))
    reason = F.when(F.col("entity") % 11 == 0, "unknown entity").when(F.col("said").isNull(), "unknown span").when(~F.contains("said", "k"), "absent from span")
    return first_is_accepted(met, reason, ["entity", "k"], ["document_id", "page"]).select("document_id", "page", "outcome")


#: Which facts a type may have (here kinds of events of a status).
ALLOWED = (("O", "click"), ("O", "view"), ("F", "purchase"), ("F", "click"), ("P", "view"))


@register("""WITH al(s, f) AS (VALUES ('O', 'click'), ('O', 'view'), ('F', 'purchase'), ('F', 'click'), ('P', 'view')),
  r AS (SELECT event_id, user_id, event_type, props, CASE WHEN o.o_orderkey IS NULL THEN 'unknown entity' WHEN p.p_partkey IS NULL THEN 'unknown span' WHEN al.f IS NULL THEN 'invalid field' END AS reason
    FROM events LEFT JOIN orders o ON o_orderkey = user_id LEFT JOIN part p ON p_partkey = event_id % 300 LEFT JOIN al ON s = o_orderstatus AND f = event_type)
  SELECT event_id, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL, user_id, event_type, props ORDER BY event_id) = 1 THEN 'accepted' ELSE 'duplicate' END) AS outcome FROM r""")
def compact_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed facts: owner and span are known, the field is one of the owner's type, and the value is new."""
    allowed = F.broadcast(spark.createDataFrame(ALLOWED, "s string, f string"))  # a constant
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    p = table(spark, sf_dir, "part").select("p_partkey")
    met = table(spark, sf_dir, "events").join(o, F.col("o_orderkey") == F.col("user_id"), "left").join(p, F.col("p_partkey") == F.col("event_id") % 300, "left")
    met = met.join(allowed, (F.col("s") == F.col("o_orderstatus")) & (F.col("f") == F.col("event_type")), "left")
    reason = F.when(F.col("o_orderkey").isNull(), "unknown entity").when(F.col("p_partkey").isNull(), "unknown span").when(F.col("f").isNull(), "invalid field")
    return first_is_accepted(met, reason, ["user_id", "event_type", "props"], ["event_id"]).select("event_id", "outcome")


_SIMPLE = f"""{EDGES}, {PARTS}, sg AS (SELECT 'S' || o_orderkey AS segment, o_custkey % 3 AS page FROM orders WHERE o_orderstatus <> 'P'),
  pr AS (SELECT ord, CASE ord % 3 WHEN 0 THEN 'S' || page WHEN 1 THEN '[S' || page || '] as told' ELSE 'see S' || page END AS cited, page % 3 AS page, source_id, target_id, type FROM ed),
  nm AS (SELECT lower(name || ' ' || brand) AS n, count(*) AS matches, min(id) AS id FROM pt GROUP BY 1),
  rs AS (SELECT pr.*, coalesce(sg1.segment, sg2.segment) AS segment, coalesce(sg1.page, sg2.page) AS on_page, a.matches AS sm, b.matches AS tm, a.id AS s, b.id AS t FROM pr
    LEFT JOIN sg sg1 ON sg1.segment = cited LEFT JOIN sg sg2 ON sg2.segment = nullif(regexp_extract(cited, '^\\[([^\\]\\r\\n]+)\\]', 1), '')
    LEFT JOIN pt p1 ON p1.id = source_id LEFT JOIN pt p2 ON p2.id = target_id LEFT JOIN nm a ON a.n = lower(p1.name || ' ' || p1.brand) LEFT JOIN nm b ON b.n = lower(p2.name || ' ' || p2.brand)),
  oc AS (SELECT *, CASE WHEN segment IS NULL THEN 'segment' WHEN on_page <> page THEN 'page' WHEN sm IS NULL OR tm IS NULL THEN 'unknown' WHEN sm > 1 OR tm > 1 THEN 'ambiguous' WHEN s = t THEN 'self' END AS reason FROM rs)"""


def simple_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed edges with segment, ends and the first rule that they break.  A segment is cited by its id or by a leading [id]."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    segments = o.select(F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("segment"), (F.col("o_custkey") % 3).alias("on_page"))
    name = F.concat(F.lit("S"), F.col("page").cast("string"))
    cited = F.when(F.col("ord") % 3 == 0, name).when(F.col("ord") % 3 == 1, F.concat(F.lit("["), name, F.lit("] as told"))).otherwise(F.concat(F.lit("see "), name))
    own = edges(spark, sf_dir).select("ord", cited.alias("cited"), (F.col("page") % 3).alias("page"), "source_id", "target_id", "type")
    lead = F.regexp_extract("cited", r"^\[([^\]\r\n]+)\]", 1)
    own = own.withColumn("at", F.when(lead != "", lead).otherwise(F.col("cited"))).join(segments, F.col("at") == F.col("segment"), "left")
    p = parts(spark, sf_dir).select("id", F.lower(F.concat_ws(" ", "name", "brand")).alias("n"))
    names = p.groupBy("n").agg(F.count(F.lit(1)).alias("matches"), F.min("id").alias("first"))
    ends = p.join(names, "n").select("id", "matches", "first")
    for end, count, at in (("source_id", "sm", "s"), ("target_id", "tm", "t")):
        own = own.join(ends.select(F.col("id").alias(end), F.col("matches").alias(count), F.col("first").alias(at)), end, "left")
    reason = (
        F.when(F.col("segment").isNull(), "segment").when(F.col("on_page") != F.col("page"), "page").when(F.col("sm").isNull() | F.col("tm").isNull(), "unknown")
        .when((F.col("sm") > 1) | (F.col("tm") > 1), "ambiguous").when(F.col("s") == F.col("t"), "self")
    )
    return own.withColumn("reason", reason)


@register(f"WITH {_SIMPLE} SELECT ord, coalesce(reason, 'accepted') AS outcome FROM oc")
def simple_graph_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_graph(spark, sf_dir).select("ord", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


@register(f"WITH {_SIMPLE} SELECT s, t, lower(type) AS relationship, count(*) AS proposals, count(DISTINCT segment) AS segments FROM oc WHERE reason IS NULL GROUP BY ALL")
def simple_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted edges once, with all segments that they were found in."""
    kept = simple_graph(spark, sf_dir).where("reason IS NULL")
    return kept.groupBy("s", "t", F.lower("type").alias("relationship")).agg(F.count(F.lit(1)).alias("proposals"), F.count_distinct("segment").alias("segments"))


@register(f"""WITH {EDGES}, r AS (SELECT ord, source_id, target_id, lower(type) AS k, CASE WHEN a.p_partkey IS NULL OR b.p_partkey IS NULL THEN 'invalid entity' WHEN o_orderkey IS NULL THEN 'invalid segment' WHEN source_id = target_id THEN 'self edge' END AS reason
    FROM ed LEFT JOIN (SELECT * FROM part WHERE p_size > 5) a ON a.p_partkey = source_id LEFT JOIN (SELECT * FROM part WHERE p_size > 5) b ON b.p_partkey = target_id LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = page)
  SELECT ord, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL, source_id, target_id, k ORDER BY ord) = 1 THEN 'accepted' ELSE 'duplicate' END) AS outcome FROM r""".replace("ORDER BY ord)", "ORDER BY ord, quantity)").replace("SELECT ord, source_id, target_id, lower(type) AS k", "SELECT ord, quantity, source_id, target_id, lower(type) AS k"))
def compact_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by local ids: both entities, the segment, no self edge, and the first of its semantic key."""
    p = table(spark, sf_dir, "part").where("p_size > 5")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    met = edges(spark, sf_dir).join(p.select(F.col("p_partkey").alias("a")), F.col("a") == F.col("source_id"), "left").join(p.select(F.col("p_partkey").alias("b")), F.col("b") == F.col("target_id"), "left")
    met = met.join(o, F.col("o_orderkey") == F.col("page"), "left").withColumn("k", F.lower("type"))
    reason = F.when(F.col("a").isNull() | F.col("b").isNull(), "invalid entity").when(F.col("o_orderkey").isNull(), "invalid segment").when(F.col("source_id") == F.col("target_id"), "self edge")
    return first_is_accepted(met, reason, ["source_id", "target_id", "k"], ["ord", "quantity"]).select("ord", "outcome")


@register(f"""WITH {EDGES}, mg AS (SELECT p_partkey AS id, p_partkey - p_partkey % 6 AS final FROM part), r AS (SELECT page % 4 AS pass, a.final AS source_id, b.final AS target_id, lower(type) AS relationship FROM ed JOIN mg a ON a.id = source_id JOIN mg b ON b.id = target_id)
  SELECT source_id, target_id, relationship, count(*) AS candidates, count(DISTINCT pass) AS passes FROM r WHERE source_id <> target_id GROUP BY ALL""")
def resolved_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw passes resolved again against the merged inventory; an end that is still a merged entity fails the whole query."""
    merged = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 6).alias("final"))
    own = edges(spark, sf_dir).select((F.col("page") % 4).alias("pass"), "source_id", "target_id", F.lower("type").alias("relationship"))
    for end in ("source_id", "target_id"):
        own = own.join(merged.select(F.col("id").alias(end), F.col("final").alias(f"final_{end}")), end).drop(end).withColumnRenamed(f"final_{end}", end)
    own = insist(own, (F.col("source_id") % 6 != 0) | (F.col("target_id") % 6 != 0), "an end was resolved to a merged entity")
    return own.where("source_id <> target_id").groupBy("source_id", "target_id", "relationship").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("pass").alias("passes"))


_STORED = """st AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 5) ELSE props END AS output FROM events),
  rv AS (SELECT event_id, CASE WHEN NOT json_valid(output) THEN 'does not parse' WHEN c_custkey IS NULL THEN 'unknown entity' WHEN CAST(json_extract(output, '$.k') AS INTEGER) >= 90 THEN 'out of range' END AS why
    FROM st LEFT JOIN customer ON c_custkey = user_id)"""


@register(f"WITH {_STORED} SELECT event_id, why, CASE WHEN why IS NULL THEN 'reuse' ELSE 'failed' END AS state, why IS NOT NULL AS runs_again FROM rv")
def revalidated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored outputs are parsed and validated again before they are reused; the others are marked failed and run again."""
    output = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    stored = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json(output, "k int, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("o"))
    own = stored.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey") == F.col("user_id"), "left")
    why = F.when(F.col("o._corrupt_record").isNotNull(), "does not parse").when(F.col("c_custkey").isNull(), "unknown entity").when(F.col("o.k") >= 90, "out of range")
    return own.select("event_id", why.alias("why"), F.when(why.isNull(), "reuse").otherwise("failed").alias("state"), why.isNotNull().alias("runs_again"))


@register(f"""WITH {EDGES}, f AS (SELECT source_id AS request, source_id, target_id, lower(type) AS k, min(ord) AS ord FROM ed GROUP BY ALL), e AS (SELECT l_suppkey AS request, count(DISTINCT l_partkey) AS entities FROM lineitem GROUP BY 1)
  SELECT request, entities, count(*) AS known, min(ord) AS first_ord FROM f JOIN e USING (request) GROUP BY ALL""")
def blanket_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completeness request per source: its entities, and its accepted edges once by semantic key, the first of each."""
    own = edges(spark, sf_dir)
    known = own.groupBy(F.col("source_id").alias("request"), "target_id", F.lower("type").alias("k")).agg(F.min("ord").alias("ord"))
    return known.groupBy("request").agg(F.count_distinct("target_id").alias("entities"), F.count(F.lit(1)).alias("known"), F.min("ord").alias("first_ord"))


@register("""WITH old AS (SELECT r_regionkey AS campaign, 'Old ' || r_name AS overview, 1 AS generation FROM region), new AS (SELECT n_regionkey AS campaign, min(n_name) AS overview, 2 AS generation FROM nation WHERE n_regionkey <> 3 GROUP BY 1)
  SELECT * FROM new UNION ALL SELECT * FROM old WHERE campaign NOT IN (SELECT campaign FROM new)""")
def replaced_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews of campaigns after a combined call: written ones replace those of their campaigns, the others stay."""
    old = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("campaign"), F.concat(F.lit("Old "), "r_name").alias("overview"), F.lit(1).alias("generation"))
    new = table(spark, sf_dir, "nation").where("n_regionkey <> 3").groupBy(F.col("n_regionkey").alias("campaign")).agg(F.min("n_name").alias("overview"), F.lit(2).alias("generation"))
    return new.unionByName(old.join(new.select("campaign"), "campaign", "left_anti"))

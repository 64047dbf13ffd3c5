"""Mentions, relationships, facts, containment, coverage, rescue and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.operators.hierarchy import ancestors, location_tree
from lorewright.plans.base import EDGES, PARTS, edges, parts, registrar, table
from lorewright.storage import materialize

QUERIES: dict = {}
register = registrar(QUERIES)


# mentions: needles are benchmark tokens, pages are documents

_TOK = r"tok AS (SELECT doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM documents)"
_NEEDLE = r"nd AS (SELECT item_id, w FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')[1] AS w FROM benchmark) WHERE length(w) >= 4)"


def needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-token entity names that are safe to mention: the first word of every benchmark passage."""
    own = table(spark, sf_dir, "benchmark").select("item_id", T.tokens_of(F.col("text"))[0].alias("w"))
    return own.where(F.length("w") >= 4)


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens_of(F.col("text"))).alias("w"))


@register(f"WITH {_TOK}, {_NEEDLE} SELECT item_id, count(*) AS mentions, count(DISTINCT doc_id) AS pages FROM nd JOIN tok USING (w) GROUP BY item_id")
def mention_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of an entity and pages with one: tokens meet the names first (the smaller side is sent round), then count."""
    met = document_tokens(spark, sf_dir).join(needles(spark, sf_dir), "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("item_id").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("pages"))


@register(f"WITH {_TOK}, {_NEEDLE}, o AS (SELECT DISTINCT item_id, doc_id FROM nd JOIN tok USING (w)) SELECT doc_id, count(*) AS entities, min(item_id) AS first_entity FROM o GROUP BY doc_id")
def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other direction of the inverted index: entities by page."""
    seen = document_tokens(spark, sf_dir).distinct()
    return needles(spark, sf_dir).join(seen, "w").groupBy("doc_id").agg(F.countDistinct("item_id").alias("entities"), F.min("item_id").alias("first_entity"))


@register(f"WITH {_NEEDLE}, c AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS p FROM conversations) SELECT conv_id, turn, count(*) AS mentioned FROM c JOIN (SELECT DISTINCT w FROM nd WHERE length(w) >= 3) ON contains(p, ' ' || w || ' ') GROUP BY ALL".replace("{{", "{").replace("}}", "}"))
def knowledge_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-token mentions of names of three letters or more."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(T.tokens_of(F.col("text")))).alias("w"))
    names = needles(spark, sf_dir).where(F.length("w") >= 3).select("w").distinct()
    return own.join(names, "w").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("mentioned"))


@register("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(n_name) AS h FROM nation WHERE n_regionkey = 2) WHERE contains(lower('nation_' || (e.user_id % 30) || ' ' || e.event_type), h))")
def hidden_term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that name no hidden entity, by plain substring without word bounds. Nations are 25 rows."""
    facts = table(spark, sf_dir, "events").select("event_id", F.lower(F.concat(F.lit("nation_"), F.col("user_id") % 30, F.lit(" "), "event_type")).alias("said"))
    hidden = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.lower("n_name").alias("h")).distinct()
    return facts.join(F.broadcast(hidden), F.contains("said", "h"), "left_anti").select("event_id")


EXCERPT_LENGTH, WORD_BOUNDARY = 400, 0.7


def capped(text: Column, most: int = EXCERPT_LENGTH) -> Column:
    """text, or its beginning up to the last space in the last third, and an ellipsis."""
    head = F.substr(text, F.lit(1), F.lit(most - 1))
    last = F.instr(F.reverse(head), " ")
    at = F.when(last == 0, -1).otherwise(F.length(head) - last)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.when(at > most * WORD_BOUNDARY, F.substr(head, F.lit(1), at)).otherwise(head)), F.lit("…")))


@register(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w, lang || ' ' || source AS label FROM documents),
  s AS (SELECT doc_id, text, list_filter([w[3], w[30]], lambda x: x <> '') AS names, list_filter(string_split(label, ' '), lambda x: length(x) > 3) AS label,
    list_filter(list_transform(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM d),
  f AS (SELECT *, list_filter(p, lambda x: len(names) >= 2 AND len(list_filter(names, lambda n: contains(lower(x), n))) = len(names)) AS full_p FROM s),
  wn AS (SELECT doc_id, i, array_to_string(p[i:i + 1], ' ') AS said, names, label FROM (SELECT doc_id, p, names, label, unnest(range(1, len(p) + 1)) AS i FROM f)),
  sc AS (SELECT doc_id, arg_max(said, (3 * len(list_filter(names, lambda n: contains(lower(said), n))) + len(list_filter(label, lambda n: contains(lower(said), lower(n)))), -i)) AS best FROM wn GROUP BY doc_id),
  x AS (SELECT doc_id, coalesce(full_p[1], best, text) AS x FROM f LEFT JOIN sc USING (doc_id)), h AS (SELECT doc_id, x, x[1:399] AS head FROM x),
  c AS (SELECT *, CASE WHEN strpos(reverse(head), ' ') = 0 THEN -1 ELSE length(head) - strpos(reverse(head), ' ') END AS cut FROM h)
  SELECT doc_id, CASE WHEN length(x) <= 400 THEN x ELSE rtrim(CASE WHEN cut > 280 THEN head[1:cut] ELSE head END) || '…' END AS excerpt FROM c""")
def concise_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence with both endpoints (here the third and thirtieth word); else the two neighbouring sentences that
    name most endpoints and label words, the first of equals; at most EXCERPT_LENGTH characters."""
    ends = r"^\s+|\s+$"
    w = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " ")
    own = table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace("text", ends, "").alias("text"), F.filter(F.array_compact(F.array(F.get(w, F.lit(2)), F.get(w, F.lit(29)))), lambda x: x != "").alias("names"),
        F.filter(F.split(F.concat_ws(" ", "lang", "source"), " "), lambda x: F.length(x) > 3).alias("label"),
    )
    said = F.transform(F.regexp_extract_all("text", F.lit(r"[^.!?]+(?:[.!?]+|$)"), F.lit(0)), lambda x: F.regexp_replace(x, ends, ""))
    own = own.withColumn("p", F.filter(said, lambda x: x != ""))
    held = lambda x, words: F.size(F.filter(words, lambda n: F.contains(F.lower(x), F.lower(n))))
    both = F.filter("p", lambda x: (F.size("names") >= 2) & (held(x, F.col("names")) == F.size("names")))
    pair = lambda x, i: F.struct((3 * held(F.array_join(F.slice("p", i + 1, 2), " "), F.col("names")) + held(F.array_join(F.slice("p", i + 1, 2), " "), F.col("label"))).alias("score"), (-i).alias("at"))
    best = F.array_max(F.transform("p", pair))
    window = F.when(F.size("p") > 0, F.array_join(F.slice("p", 1 - best["at"], 2), " "))
    return own.select("doc_id", capped(F.coalesce(F.get(both, F.lit(0)), window, "text")).alias("excerpt"))


# relationships


@register(f"""WITH {EDGES}, r AS (SELECT *, CASE WHEN source_id = target_id THEN 'self edge' WHEN quantity < 3 THEN 'unresolved' END AS reason FROM ed) SELECT coalesce(reason, 'kept') AS outcome, count(*) AS candidates,
  count(DISTINCT (source_id, target_id, lower(type))) AS canonical FROM r GROUP BY 1""")
def resolved_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates kept or rejected with a reason, and the canonical edges that they make."""
    reason = F.when(F.col("source_id") == F.col("target_id"), "self edge").when(F.col("quantity") < 3, "unresolved").otherwise("kept")
    own = edges(spark, sf_dir).withColumn("outcome", reason)
    return own.groupBy("outcome").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("source_id", "target_id", F.lower("type")).alias("canonical"))


@register(f"WITH {EDGES} SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS instances, count(DISTINCT type) AS types FROM ed GROUP BY ALL HAVING count(*) > 1")
def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances grouped by endpoints in either order; singles pass by."""
    e = edges(spark, sf_dir).groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"))
    return e.agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("type").alias("types")).where("instances > 1")


@register(f"WITH {EDGES} SELECT source_id, target_id, substr(sha256(string_agg(CAST(ord AS VARCHAR), chr(31) ORDER BY ord)), 1, 20) AS group_id FROM ed GROUP BY ALL")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of reconciliation groups: a hash over their members in order."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("ord")), lambda x: x.cast("string")), "\x1f")
    return edges(spark, sf_dir).groupBy("source_id", "target_id").agg(F.substring(F.sha2(ids, 256), 1, 20).alias("group_id"))


@register(f"""WITH {EDGES}, v AS (SELECT source_id AS me, target_id AS other, true AS out, type, confidence FROM ed UNION ALL SELECT target_id, source_id, false, type, confidence FROM ed)
  SELECT me, other, out, count(DISTINCT type) AS types, max(confidence) AS confidence FROM v GROUP BY ALL""")
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as seen from each entity, with their direction."""
    e = edges(spark, sf_dir)
    seen = e.select(F.col("source_id").alias("me"), F.col("target_id").alias("other"), F.lit(True).alias("out"), "type", "confidence")
    seen = seen.unionByName(e.select(F.col("target_id").alias("me"), F.col("source_id").alias("other"), F.lit(False).alias("out"), "type", "confidence"))
    return seen.groupBy("me", "other", "out").agg(F.countDistinct("type").alias("types"), F.max("confidence").alias("confidence"))


@register(f"""WITH {EDGES}, g AS (SELECT source_id, target_id, lower(type) AS k, list_sort(list(DISTINCT page)) AS pages FROM ed GROUP BY ALL) SELECT source_id, target_id, k, len(pages) AS pages, pages[1] AS first_page,
  substr(sha256(k || '|' || array_to_string(pages, ',')), 1, 16) AS provenance FROM g""")
def lean_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lean graph core: an edge for each semantic key with its pages and a provenance hash."""
    g = edges(spark, sf_dir).groupBy("source_id", "target_id", F.lower("type").alias("k")).agg(F.sort_array(F.collect_set("page")).alias("p"))
    told = F.array_join(F.transform("p", lambda x: x.cast("string")), ",")
    return g.select("source_id", "target_id", "k", F.size("p").alias("pages"), F.col("p")[0].alias("first_page"), F.substring(F.sha2(F.concat("k", F.lit("|"), told), 256), 1, 16).alias("provenance"))


@register(f"WITH {EDGES} SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY source_id, target_id, lower(type) ORDER BY ord) AS r FROM ed) WHERE r = 1")
def replay_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges before a replay, each key once, the first kept."""
    return edges(spark, sf_dir).groupBy("source_id", "target_id", F.lower("type")).agg(F.min("ord").alias("ord")).select("ord")


@register("""WITH f AS (SELECT event_id, user_id, event_type, regexp_replace(trim(regexp_replace(lower(props), '[^\\p{L}\\p{N}''+-]+', ' ', 'g')), '^(?:a|an)\\s+', '') AS content FROM events),
  a AS (SELECT user_id, event_type, content, count(*) AS evidence, min(event_id) AS first_seen FROM f WHERE content <> '' GROUP BY ALL)
  SELECT user_id, event_type || ':' || substr(sha256(event_type || chr(0) || content), 1, 24) AS stable_key, evidence, first_seen, row_number() OVER (PARTITION BY user_id ORDER BY first_seen) - 1 AS sort_order FROM a""")
def fact_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by (entity, field, normalised content): evidence united, a hashed key, order of first sight."""
    f = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", T.normalize_fact(F.col("props")).alias("content")).where("content <> ''")
    a = f.groupBy("user_id", "event_type", "content").agg(F.count(F.lit(1)).alias("evidence"), F.min("event_id").alias("first_seen"))
    key = F.concat("event_type", F.lit(":"), F.substring(F.sha2(F.concat("event_type", F.lit("\0"), "content"), 256), 1, 24))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("first_seen")) - 1
    return a.select("user_id", key.alias("stable_key"), "evidence", "first_seen", order.alias("sort_order"))


# containment


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(relationships, locations): regions, nations and customers, with rivals, duplicates and weak edges."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer")
    locations = r.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"))).unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("id")))

    def rows(df: DataFrame, id_, source, target, kind: str, confidence) -> DataFrame:
        return df.select(id_.alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), confidence.cast("double").alias("confidence"))

    nation, region, cust = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("c"), "c_custkey")
    home, rival = F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("n"), (F.col("c_nationkey") + 1) % 25)
    grade = F.floor(F.pmod(F.col("c_custkey") * 7, F.lit(11))) / 20 + F.lit(0.5)
    rel = rows(n, F.concat(F.lit("a"), nation), nation, region, "Located in", F.lit(0.95))
    rel = rel.unionByName(rows(c, F.concat(F.lit("b"), cust), cust, home, "located-in", grade))
    rel = rel.unionByName(rows(c.where("c_mktsegment = 'BUILDING'"), F.concat(F.lit("d"), cust), rival, cust, "contains", F.lit(0.72)))
    rel = rel.unionByName(rows(c.where("c_acctbal > 7000"), F.concat(F.lit("e"), cust), cust, home, "located in", F.lit(0.81)))
    rel = rel.unionByName(rows(c.where("c_acctbal < -900"), F.concat(F.lit("f"), cust), cust, cust, "located in", F.lit(0.9)))
    return rel.unionByName(rows(c.where("c_acctbal > 9800"), F.concat(F.lit("g"), cust), cust, F.concat(F.lit("x"), "c_custkey"), "located in", F.lit(0.9))), locations


_PLACES = """loc AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer),
  rel AS (SELECT 'an' || n_nationkey AS id, 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent, 0.95::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'bc' || c_custkey, 'c' || c_custkey, 'n' || c_nationkey, floor((c_custkey * 7) % 11) / 20 + 0.5::DOUBLE FROM customer
  UNION ALL SELECT 'dc' || c_custkey, 'c' || c_custkey, 'n' || ((c_nationkey + 1) % 25), 0.72::DOUBLE FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'ec' || c_custkey, 'c' || c_custkey, 'n' || c_nationkey, 0.81::DOUBLE FROM customer WHERE c_acctbal > 7000
  UNION ALL SELECT 'fc' || c_custkey, 'c' || c_custkey, 'c' || c_custkey, 0.9::DOUBLE FROM customer WHERE c_acctbal < -900
  UNION ALL SELECT 'gc' || c_custkey, 'c' || c_custkey, 'x' || c_custkey, 0.9::DOUBLE FROM customer WHERE c_acctbal > 9800),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY child, parent ORDER BY confidence DESC, id) AS r FROM rel WHERE child <> parent AND parent IN (SELECT id FROM loc)) WHERE r = 1),
  rk AS (SELECT *, row_number() OVER w AS rank, max(confidence) OVER (PARTITION BY child) AS top, nth_value(confidence, 2) OVER (PARTITION BY child ORDER BY confidence DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
    FROM best WINDOW w AS (PARTITION BY child ORDER BY confidence DESC, id)),
  chosen AS (SELECT child, parent FROM rk WHERE rank = 1 AND top >= 0.7 AND (second IS NULL OR top >= 0.8 AND top - second >= 0.15))"""


@register(f"WITH {_PLACES} SELECT child, parent FROM chosen")
def containment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents chosen among rivals, duplicates and weak edges."""
    return location_tree(*places(spark, sf_dir))[0].select("child", "parent")


@register(f"WITH RECURSIVE {_PLACES}, up AS (SELECT child AS node, parent AS above FROM chosen UNION SELECT up.node, c.parent FROM up JOIN chosen c ON up.above = c.child) SELECT node, count(*) AS depth, list_sort(list(above)) AS above FROM up GROUP BY node")
def hierarchy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and ancestors of every place that has a parent."""
    tree = materialize(location_tree(*places(spark, sf_dir))[0], "tree")
    return ancestors(tree).groupBy("node").agg(F.count(F.lit(1)).alias("depth"), F.sort_array(F.collect_list("above")).alias("above"))


@register(f"WITH {_PLACES} SELECT l.id, c.parent IS NULL AS root, count(d.child) AS children FROM loc l LEFT JOIN chosen c ON c.child = l.id LEFT JOIN chosen d ON d.parent = l.id GROUP BY ALL")
def roots_and_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel, locations = places(spark, sf_dir)
    tree = materialize(location_tree(rel, locations)[0], "tree")
    below = tree.groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    own = locations.join(tree.select("child", "parent"), F.col("id") == F.col("child"), "left").join(below, F.col("id") == F.col("p"), "left")
    return own.select("id", F.col("parent").isNull().alias("root"), F.coalesce("n", F.lit(0)).alias("children"))


@register(f"WITH {_PLACES} SELECT r.id, c.child IS NOT NULL AS selected FROM rel r LEFT JOIN (SELECT rk.id, rk.child FROM rk JOIN chosen USING (child, parent)) c USING (id) WHERE r.child IN (SELECT id FROM loc)")
def considered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which considered containment edges the graph keeps."""
    rel, locations = places(spark, sf_dir)
    kept = location_tree(rel, locations)[0].select("id", F.lit(True).alias("kept"))
    return rel.join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("selected"))


# coverage, rescue, enrichment


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with pages (orders of any line item), neighbours on them, and degree and evidence pages of their accepted edges.

    Acceptance is an attribute of an edge: here line items of quantity 48 and more at a discount over 0.05.
    """
    item = table(spark, sf_dir, "lineitem")
    seen = item.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("page"))
    pages = seen.groupBy("id").agg(F.countDistinct("page").alias("mention_pages"))
    other = seen.select(F.col("id").alias("o_id"), "page").distinct()
    near = seen.distinct().join(other, "page").where("id <> o_id").groupBy("id").agg(F.countDistinct("o_id").alias("nearby"))
    touch = item.where("l_quantity >= 48 AND l_discount > 0.05").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("l_orderkey").alias("evidence_pages"))
    own = parts(spark, sf_dir).select("id").join(pages, "id", "left").join(near, "id", "left").join(touch, "id", "left").na.fill(0)
    zero = (F.col("degree") == 0) & (F.col("mention_pages") >= 2) & (F.col("nearby") >= 1)
    low = (F.col("degree") <= 1) & (F.col("mention_pages") >= 2) & (F.col("nearby") >= 2) & (F.col("evidence_pages") < F.col("mention_pages"))
    return own.withColumn("flag", F.when(zero, "SUSPICIOUS_ZERO_RELATIONSHIPS").when(low, "SUSPICIOUS_LOW_COVERAGE").otherwise("SPARSE_OK"))


_COVER = f"""{PARTS}, seen AS (SELECT DISTINCT l_partkey AS id, l_orderkey AS page FROM lineitem), mp AS (SELECT id, count(*) AS mention_pages FROM seen GROUP BY id),
  nb AS (SELECT a.id, count(DISTINCT b.id) AS nearby FROM seen a JOIN seen b ON a.page = b.page AND a.id <> b.id GROUP BY a.id),
  tc AS (SELECT l_partkey AS id, count(*) AS degree, count(DISTINCT l_orderkey) AS evidence_pages FROM lineitem WHERE l_quantity >= 48 AND l_discount > 0.05 GROUP BY 1),
  cv0 AS (SELECT pt.id, coalesce(mention_pages, 0) AS mention_pages, coalesce(nearby, 0) AS nearby, coalesce(degree, 0) AS degree, coalesce(evidence_pages, 0) AS evidence_pages FROM pt LEFT JOIN mp USING (id) LEFT JOIN nb USING (id) LEFT JOIN tc USING (id)),
  cv AS (SELECT *, CASE WHEN degree = 0 AND mention_pages >= 2 AND nearby >= 1 THEN 'SUSPICIOUS_ZERO_RELATIONSHIPS' WHEN degree <= 1 AND mention_pages >= 2 AND nearby >= 2 AND evidence_pages < mention_pages THEN 'SUSPICIOUS_LOW_COVERAGE' ELSE 'SPARSE_OK' END AS flag FROM cv0)"""


@register(f"WITH {_COVER} SELECT id, mention_pages, nearby, degree, evidence_pages, flag FROM cv")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir)


@register(f"""WITH {_COVER}, tg AS (SELECT DISTINCT s.id, page FROM cv JOIN seen s USING (id) WHERE flag <> 'SPARSE_OK'), pw AS (SELECT page, CAST(floor((row_number() OVER (ORDER BY page) - 1) / 4) AS BIGINT) AS wnd FROM (SELECT DISTINCT page FROM tg)),
  tw AS (SELECT DISTINCT wnd, id FROM tg JOIN pw USING (page)) SELECT wnd, id, CAST(floor((row_number() OVER (PARTITION BY wnd ORDER BY id) - 1) / 12) AS BIGINT) AS grp FROM tw""")
def rescue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspicious pages in windows of four, their targets in groups of twelve."""
    targets = coverage(spark, sf_dir).where("flag <> 'SPARSE_OK'").select("id")
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("page")).distinct()
    on = materialize(seen.join(targets, "id", "left_semi"), "targets")
    # pages are numbered by ranges: a count per range, then ranks inside
    paged = on.select("page").distinct().repartitionByRange("page").withColumn("part", F.spark_partition_id())
    paged = materialize(paged, "pages")
    before = paged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(F.col("part").alias("b_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    rank = F.row_number().over(Window.partitionBy("part").orderBy("page")) - 1
    windows = paged.withColumn("rank", rank).join(before, F.col("part") == F.col("b_part")).select("page", F.floor((F.col("before") + F.col("rank")) / 4).alias("wnd"))
    own = on.join(windows, "page").select("wnd", "id").distinct()
    return own.select("wnd", "id", F.floor((F.row_number().over(Window.partitionBy("wnd").orderBy("id")) - 1) / 12).alias("grp"))


@register(f"WITH {PARTS} SELECT id, 'dm_only' AS visibility, name AS gm_summary, CASE WHEN type = 'PROMO' THEN 'not_started' END AS quest_status, NULL::VARCHAR AS prominence FROM pt")
def lean_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(
        "id", F.lit("dm_only").alias("visibility"), F.col("name").alias("gm_summary"), F.when(F.col("type") == "PROMO", "not_started").alias("quest_status"), F.lit(None).cast("string").alias("prominence")
    )


@register("""SELECT kind || ':' || owner || ':' || page || ':' || idx AS evidence_id FROM (SELECT 'entity' AS kind, l_partkey AS owner, l_orderkey AS page, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS idx FROM lineitem
  UNION ALL SELECT 'fact', user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 FROM events)""")
def evidence_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner-indexed evidence ids of two kinds."""
    item = table(spark, sf_dir, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")) - 1
    one = item.select(F.concat_ws(":", F.lit("entity"), "l_partkey", "l_orderkey", i).alias("evidence_id"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return one.unionByName(table(spark, sf_dir, "events").select(F.concat_ws(":", F.lit("fact"), "user_id", "event_id", k).alias("evidence_id")))


@register(f"WITH {EDGES}, {PARTS} SELECT ord, CASE WHEN a.visible AND NOT b.size > 25 THEN 'player' WHEN a.visible THEN 'mixed' ELSE 'gm' END AS audience FROM ed JOIN pt a ON a.id = target_id JOIN pt b ON b.id = source_id")
def audience_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the audience that may see both ends."""
    p = parts(spark, sf_dir)
    a, b = p.select(F.col("id").alias("target_id"), "visible"), p.select(F.col("id").alias("source_id"), "size")
    joined = edges(spark, sf_dir).join(a, "target_id").join(b, "source_id")
    return joined.select("ord", F.when(F.col("visible") & ~(F.col("size") > 25), "player").when(F.col("visible"), "mixed").otherwise("gm").alias("audience"))


@register(f"WITH {EDGES}, {PARTS} SELECT source_id, count(*) AS visible_edges_to_hidden FROM ed JOIN pt a ON a.id = source_id JOIN pt b ON b.id = target_id WHERE a.visible AND NOT b.visible GROUP BY source_id")
def visibility_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible entities that refer to hidden ones."""
    p = parts(spark, sf_dir)
    a, b = p.where("visible").select(F.col("id").alias("source_id")), p.where("NOT visible").select(F.col("id").alias("target_id"))
    return edges(spark, sf_dir).join(a, "source_id", "left_semi").join(b, "target_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("visible_edges_to_hidden"))


@register("SELECT p_type, count(*) AS n, CAST(ceil(count(*) / 12.0) AS BIGINT) AS calls_12, CAST(ceil(count(*) / 100.0) AS BIGINT) AS calls_100, CAST(ceil(count(*) / 60.0) AS BIGINT) AS calls_60 FROM part GROUP BY p_type")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "part").groupBy("p_type").agg(n.alias("n"), *[F.ceil(n / k).alias(f"calls_{k}") for k in (12, 100, 60)])


@register(f"WITH {EDGES}, known AS (SELECT DISTINCT source_id, target_id, lower(type) AS k FROM ed WHERE quantity < 20) SELECT ord, CASE WHEN ed.target_id % 7 <> 0 THEN 'no target' WHEN known.k IS NOT NULL THEN 'existing edge' ELSE 'novel' END AS outcome FROM ed LEFT JOIN known ON known.source_id = ed.source_id AND known.target_id = ed.target_id AND known.k = lower(type) WHERE quantity >= 20")
def completeness_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-pass edges: those that touch no target and those that exist are rejected."""
    e = edges(spark, sf_dir).withColumn("k", F.lower("type"))
    known = e.where("quantity < 20").select("source_id", "target_id", "k", F.lit(True).alias("known")).distinct()
    own = e.where("quantity >= 20").join(known, ["source_id", "target_id", "k"], "left")
    return own.select("ord", F.when(F.col("target_id") % 7 != 0, "no target").when(F.col("known"), "existing edge").otherwise("novel").alias("outcome"))


@register(f"WITH {EDGES} SELECT DISTINCT source_id, target_id, lower(type) AS k FROM ed WHERE quantity >= 40 EXCEPT SELECT source_id, target_id, lower(type) FROM ed WHERE quantity < 40")
def blanket_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).withColumn("k", F.lower("type"))
    cols = ["source_id", "target_id", "k"]
    return e.where("quantity >= 40").select(*cols).distinct().join(e.where("quantity < 40").select(*cols), cols, "left_anti")


@register(f"WITH {PARTS} SELECT id FROM pt WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)")
def zero_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("id"))
    return parts(spark, sf_dir).select("id").join(touched, "id", "left_anti")

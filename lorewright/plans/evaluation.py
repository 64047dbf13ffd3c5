"""Evaluation metrics: matches, crosswalks, weighted quality, audits, regression gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.operators.ranking import rank_in_groups
from lorewright.plans.base import PARTS, parts, rank_of, registrar, table

QUERIES: dict = {}
register = registrar(QUERIES)


@register("SELECT (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM lineitem) AS relationships, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS linked, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem)) AS evidence_pages")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("relationships"), F.countDistinct("l_partkey").alias("linked"), F.countDistinct("l_orderkey").alias("evidence_pages"))
    return table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("entities")).crossJoin(item)


_MATCH = f"""{PARTS}, gold AS (SELECT DISTINCT name, type FROM pt WHERE size < 26), got AS (SELECT id, name, CASE WHEN id % 9 = 0 THEN 'PROMO' ELSE type END AS type, row_number() OVER (PARTITION BY name, type ORDER BY id) AS r FROM pt WHERE size >= 26),
  cl AS (SELECT id, got.type, CASE WHEN gn.name IS NULL THEN 'FP' WHEN gt.name IS NULL THEN 'TYPE_MISMATCH' WHEN r > 1 THEN 'DUPLICATE' WHEN gn.n > 4 THEN 'AMBIGUOUS' ELSE 'TP' END AS class FROM got LEFT JOIN (SELECT name, count(*) AS n FROM gold GROUP BY name) gn USING (name) LEFT JOIN gold gt ON gt.name = got.name AND gt.type = got.type)"""


@register(f"WITH {_MATCH} SELECT class, count(*) AS n FROM cl GROUP BY class".replace("PARTITION BY name, type ORDER BY id", "PARTITION BY name, pt.type ORDER BY id"))
def entity_match_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    gold = p.where("size < 26").select(F.col("name").alias("g_name"), F.col("type").alias("g_type")).distinct()
    names = gold.groupBy(F.col("g_name").alias("n_name")).agg(F.count(F.lit(1)).alias("n"))
    got = p.where("size >= 26").withColumn("r", F.row_number().over(rank_of(["name", "type"], ["id"])))
    got = got.withColumn("type", F.when(F.col("id") % 9 == 0, "PROMO").otherwise(F.col("type")))
    joined = got.join(names, F.col("name") == F.col("n_name"), "left").join(gold, (F.col("name") == F.col("g_name")) & (F.col("type") == F.col("g_type")), "left")
    cls = F.when(F.col("n").isNull(), "FP").when(F.col("g_name").isNull(), "TYPE_MISMATCH").when(F.col("r") > 1, "DUPLICATE").when(F.col("n") > 4, "AMBIGUOUS").otherwise("TP")
    return joined.select("id", "type", cls.alias("class"))


@register(f"""WITH {_MATCH}, c AS (SELECT type, count(*) FILTER (class = 'TP') AS tp, count(*) FILTER (class IN ('FP', 'DUPLICATE')) AS fp, count(*) FILTER (class = 'TYPE_MISMATCH') AS fn FROM cl GROUP BY type)
  SELECT type, tp, fp, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp * 1.0 / (tp + fp) END, 4) AS p, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp * 1.0 / (tp + fn) END, 4) AS r FROM c""".replace("PARTITION BY name, type ORDER BY id", "PARTITION BY name, pt.type ORDER BY id"))
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall by type; an empty denominator counts as 1."""
    c = F.col("class")
    n = classed(spark, sf_dir).groupBy("type").agg(F.count_if(c == "TP").alias("tp"), F.count_if(c.isin("FP", "DUPLICATE")).alias("fp"), F.count_if(c == "TYPE_MISMATCH").alias("fn"))
    share = lambda d: F.round(F.when(d == 0, 1.0).otherwise(F.col("tp") / d), 4)
    return n.select("type", "tp", "fp", share(F.col("tp") + F.col("fp")).alias("p"), share(F.col("tp") + F.col("fn")).alias("r"))


@register("SELECT quality, count(*) AS n, count(*) FILTER (n_chars > 500) AS hits, round(count(*) FILTER (n_chars > 500) * 1.0 / count(*), 4) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def gold_inventory_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    hit, n = F.count_if(F.col("n_chars") > 500), F.count(F.lit(1))
    return own.groupBy("quality").agg(n.alias("n"), hit.alias("hits"), F.round(hit / n, 4).alias("recall"))


_FAM = "fam(rel, fam) AS (VALUES ('A', 'moves'), ('R', 'moves'), ('N', 'stays'), ('R', 'returns'), ('N', 'moves'))"


@register(f"""WITH {_FAM}, g AS (SELECT l_suppkey AS s, l_partkey AS t, l_returnflag AS r FROM lineitem WHERE l_linestatus = 'O'), c AS (SELECT l_suppkey AS s, l_partkey AS t, l_returnflag AS r FROM lineitem WHERE l_linestatus <> 'O'),
  m AS (SELECT g.s, g.t, g.r, max(CASE WHEN c.r = g.r THEN 3 WHEN EXISTS (SELECT 1 FROM fam a JOIN fam b USING (fam) WHERE a.rel = g.r AND b.rel = c.r) THEN 2 WHEN c.r IS NOT NULL THEN 1 ELSE 0 END) AS score FROM g LEFT JOIN c ON c.s = g.s AND c.t = g.t GROUP BY ALL)
  SELECT CASE score WHEN 3 THEN 'EXACT' WHEN 2 THEN 'NORMALIZED' WHEN 1 THEN 'BOUNDED' ELSE 'NO' END AS verdict, count(*) AS n FROM m GROUP BY 1""")
def relationship_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold edges (line items still open) against found ones (all others): exact wording, same family, same endpoints, or none."""
    fam = spark.createDataFrame([("A", ["moves"]), ("R", ["moves", "returns"]), ("N", ["stays", "moves"])], "rel string, fams array<string>")
    item = table(spark, sf_dir, "lineitem")
    one = item.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t"), F.col("l_returnflag").alias("r"))
    two = item.where("l_linestatus <> 'O'").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t"), F.col("l_returnflag").alias("cr"))
    one = one.join(F.broadcast(fam.withColumnRenamed("fams", "gf")), F.col("r") == F.col("rel"), "left").drop("rel")
    two = two.join(F.broadcast(fam.withColumnRenamed("fams", "cf")), F.col("cr") == F.col("rel"), "left").drop("rel")
    score = F.when(F.col("cr") == F.col("r"), 3).when(F.arrays_overlap("gf", "cf"), 2).when(F.col("cr").isNotNull(), 1).otherwise(0)
    m = one.join(two, ["s", "t"], "left").withColumn("score", score).groupBy("s", "t", "r").agg(F.max("score").alias("score"))
    verdict = F.when(F.col("score") == 3, "EXACT").when(F.col("score") == 2, "NORMALIZED").when(F.col("score") == 1, "BOUNDED").otherwise("NO")
    return m.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_WALK = f"{PARTS}, a AS (SELECT name AS k, type, size, id FROM pt WHERE brand <= 'Brand#17'), b AS (SELECT name AS k, type, size, id FROM pt WHERE brand > 'Brand#17' AND size > 15)"


@register(f"""WITH {_WALK}, w AS (SELECT id, k, type, row_number() OVER (PARTITION BY k ORDER BY (CASE WHEN type IN (SELECT type FROM b b2 WHERE b2.k = a.k) THEN 4 ELSE 0 END) + (CASE WHEN type <> 'STANDARD' THEN 2 ELSE 0 END) + (CASE WHEN k IN (SELECT k FROM b) THEN 1 ELSE 0 END) DESC, id) AS r FROM a)
  SELECT id, k FROM w WHERE r = 1""")
def duplicate_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of duplicates of a name the one that matches its counterpart best; the first of equals."""
    p = parts(spark, sf_dir)
    b = p.where("brand > 'Brand#17' AND size > 15").groupBy(F.col("name").alias("b_k")).agg(F.collect_set("type").alias("types"))
    a = p.where("brand <= 'Brand#17'").join(b, F.col("name") == F.col("b_k"), "left")
    score = F.when(F.expr("array_contains(types, type)"), 4).otherwise(0) + F.when(F.col("type") != "STANDARD", 2).otherwise(0) + F.when(F.col("b_k").isNotNull(), 1).otherwise(0)
    own = a.select("id", F.col("name").alias("k"), F.row_number().over(rank_of(["name"], [F.desc(score), "id"])).alias("r"))
    return own.where("r = 1").select("id", "k")


@register(f"""WITH {_WALK}, d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM a), bt AS (SELECT DISTINCT k, type FROM b), bn AS (SELECT DISTINCT k FROM b), bs AS (SELECT DISTINCT type, size FROM b)
  SELECT d.id, CASE WHEN r > 1 THEN 'duplicate' WHEN bn.k IS NOT NULL AND bt.k IS NULL THEN 'retyped' WHEN bn.k IS NULL AND bs.type IS NOT NULL THEN 'renamed' WHEN bt.k IS NOT NULL THEN 'same' ELSE 'missing' END AS class
  FROM d LEFT JOIN bt ON bt.k = d.k AND bt.type = d.type LEFT JOIN bn ON bn.k = d.k LEFT JOIN bs ON bs.type = d.type AND bs.size = d.size""")
def crosswalk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity of one version in another: duplicate, retyped, renamed, same or missing."""
    return walked(spark, sf_dir).select("id", "class")


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    b = p.where("brand > 'Brand#17' AND size > 15")
    a = p.where("brand <= 'Brand#17'").select("id", "name", "type", "size", F.row_number().over(rank_of(["name"], ["id"])).alias("r"))
    bt = b.select("name", "type", F.lit(True).alias("bt")).distinct()
    bn = b.select("name", F.lit(True).alias("bn")).distinct()
    bs = b.select("type", "size", F.lit(True).alias("bs")).distinct()
    joined = a.join(bt, ["name", "type"], "left").join(bn, "name", "left").join(bs, ["type", "size"], "left")
    cls = (
        F.when(F.col("r") > 1, "duplicate").when(F.col("bn") & F.col("bt").isNull(), "retyped").when(F.col("bn").isNull() & F.col("bs"), "renamed")
        .when(F.col("bt"), "same").otherwise("missing")
    )
    return joined.select("id", "type", cls.alias("class"))


@register(f"""WITH {_WALK}, x AS (SELECT type, count(*) AS n, count(*) FILTER (k IN (SELECT k FROM b)) AS hit FROM a GROUP BY type) SELECT type, n, hit, round(hit * 1.0 / n, 4) AS recall, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS unmatched FROM x""")
def type_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by type, and how many of the other side match nothing."""
    p = parts(spark, sf_dir)
    a, b = p.where("brand <= 'Brand#17'"), p.where("brand > 'Brand#17' AND size > 15")
    bn = b.select("name", F.lit(True).alias("hit")).distinct()
    rest = b.join(a.select("name"), "name", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
    own = a.join(bn, "name", "left").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hit"))
    return own.select("type", "n", "hit", F.round(F.col("hit") / F.col("n"), 4).alias("recall")).crossJoin(F.broadcast(rest))


@register(f"""WITH {PARTS}, m AS (SELECT type || ':' || lower(name) AS k, list_sort(list(DISTINCT brand)) AS aliases, count(*) AS evidence FROM pt WHERE size BETWEEN 10 AND 30 GROUP BY 1), e AS (SELECT DISTINCT type || ':' || lower(name) AS k FROM pt WHERE size > 45)
  SELECT k, aliases, evidence FROM m UNION ALL SELECT k, [], 0 FROM e WHERE k NOT IN (SELECT k FROM m)""")
def gold_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference merged by type and name, with rows of the other side only where absent."""
    p = parts(spark, sf_dir).withColumn("k", F.concat_ws(":", "type", F.lower("name")))
    m = p.where("size BETWEEN 10 AND 30").groupBy("k").agg(F.sort_array(F.collect_set("brand")).alias("aliases"), F.count(F.lit(1)).alias("evidence"))
    e = p.where("size > 45").select("k").distinct().join(m.select("k"), "k", "left_anti")
    return m.unionByName(e.select("k", F.array().cast("array<string>").alias("aliases"), F.lit(0).cast("long").alias("evidence")))


@register("SELECT (SELECT count(*) FROM nation) = 25 AS nations, (SELECT count(*) FROM region) = 5 AS regions, (SELECT sum(n_nationkey) FROM nation) = 300 AS keys")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen totals that must hold exactly."""
    n = table(spark, sf_dir, "nation").agg((F.count(F.lit(1)) == 25).alias("nations"), (F.sum("n_nationkey") == 300).alias("keys"))
    return n.crossJoin(table(spark, sf_dir, "region").agg((F.count(F.lit(1)) == 5).alias("regions")))


@register("SELECT source, sum(length(text)) AS chars, sum(strlen(text)) AS bytes, arg_max(doc_id, (length(text), -doc_id)) AS largest FROM documents GROUP BY source")
def payload_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = (-F.max(F.struct(F.length("text"), (-F.col("doc_id")).alias("nd"))).getField("nd")).alias("largest")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), big)


@register("""WITH o AS (SELECT l_orderkey AS c, l_linenumber AS p, l_partkey AS v FROM lineitem), n AS (SELECT l_orderkey AS c, l_linenumber AS p, CASE WHEN l_quantity > 48 THEN NULL WHEN l_discount = 0 THEN l_partkey + 1 ELSE l_partkey END AS v FROM lineitem)
  SELECT c, p, CASE WHEN o.v IS NOT NULL AND n.v IS NULL THEN 'lost' ELSE 'changed' END AS change FROM o JOIN n USING (c, p) WHERE o.v IS DISTINCT FROM n.v""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ between versions by position, null-safely; lost resolutions are told apart."""
    item = table(spark, sf_dir, "lineitem")
    new = F.when(F.col("l_quantity") > 48, None).when(F.col("l_discount") == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    a = item.select(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("p"), F.col("l_partkey").alias("o"))
    b = item.select(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("p"), new.alias("v"))
    return a.join(b, ["c", "p"]).where(~F.col("o").eqNullSafe(F.col("v"))).select("c", "p", F.when(F.col("v").isNull(), "lost").otherwise("changed").alias("change"))


@register("SELECT category, k, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, k) AS place FROM (SELECT CASE WHEN p_size > 30 THEN 'large' WHEN starts_with(p_name, 'red') THEN 'red' ELSE 'other' END AS category, p_name AS k, count(*) AS n FROM part GROUP BY ALL)")
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = F.when(F.col("p_size") > 30, "large").when(F.col("p_name").startswith("red"), "red").otherwise("other")
    n = table(spark, sf_dir, "part").groupBy(cat.alias("category"), F.col("p_name").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return rank_in_groups(n, "category", [F.desc("n"), F.col("k")], "place")


@register("""WITH h AS (SELECT conv_id AS sec, min((turn, length(text))) AS lo, max((turn, length(text))) AS hi FROM conversations GROUP BY conv_id), m AS (SELECT turn, length(text) AS off, conv_id FROM conversations)
  SELECT m.conv_id, m.turn, count(*) AS sections FROM m JOIN h ON h.sec = m.conv_id AND (m.turn, m.off) >= lo AND (m.turn, m.off) < hi GROUP BY ALL""")
def section_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, offset) between the start and the end of a section, in lexicographic order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("turn", F.length("text").alias("off")).alias("at"))
    h = c.groupBy(F.col("conv_id").alias("sec")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return c.join(h, (F.col("sec") == F.col("conv_id")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("sections"))


@register("""WITH v AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS rank FROM labels), c AS (SELECT a.doc_id, a.rank AS own, b.rank AS other FROM v a JOIN v b ON b.doc_id = a.doc_id + 1) SELECT CASE WHEN own > other THEN 'improved' WHEN own < other THEN 'missed' ELSE 'even' END AS outcome, count(*) AS n FROM c GROUP BY 1""")
def verdict_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict ranks 2, 1, 0 against a comparator."""
    v = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).alias("own"))
    other = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("own").alias("other"))
    outcome = F.when(F.col("own") > F.col("other"), "improved").when(F.col("own") < F.col("other"), "missed").otherwise("even")
    return v.join(other, "doc_id").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT string_split(reason, ':')[1] AS prefix, count(*) AS n FROM (SELECT l_returnflag || l_linestatus || ':' || l_linenumber AS reason FROM lineitem) GROUP BY 1")
def issue_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat("l_returnflag", "l_linestatus", F.lit(":"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(F.split(reason, ":")[0].alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p_partkey AS k, row_number() OVER (ORDER BY CASE WHEN p_brand = 'Brand#7' THEN 0 ELSE 1 END, p_size, p_partkey) AS place FROM part")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected candidate first, then by sample, then by row; every row has its place, ranked by ranges where rows are many."""
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size", F.when(F.col("p_brand") == "Brand#7", 0).otherwise(1).alias("rest"), F.lit(0).alias("all"))
    return rank_in_groups(own, "all", [F.col("rest"), F.col("p_size"), F.col("k")], "place").select("k", "place")


@register("SELECT l_suppkey, round(0.5 * avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) + 0.15 * avg(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) + 0.35, 6) - least(1, 0.05 * count(*) FILTER (l_discount > 0.09)) AS raw, greatest(0, round(0.5 * avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) + 0.15 * avg(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) + 0.35, 6) - least(1, 0.05 * count(*) FILTER (l_discount > 0.09))) AS quality FROM lineitem GROUP BY l_suppkey".replace("SELECT l_suppkey, round(0.5", "SELECT l_suppkey, round(0.5", 1))
def weighted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted shares less a penalty for each unsupported row, not below zero."""
    share = lambda c: F.avg(F.when(c, 1).otherwise(0))
    base = F.round(0.5 * share(F.col("l_returnflag") == "N") + 0.15 * share(F.col("l_linestatus") == "F") + 0.35, 6)
    raw = base - F.least(F.lit(1.0), 0.05 * F.count_if(F.col("l_discount") > 0.09))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(raw.alias("raw")).withColumn("quality", F.greatest(F.lit(0.0), F.col("raw")))


@register("SELECT quality, sum(n_chars) AS points, count(*) AS rows, max(n_chars) AS best FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def reviewed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return own.groupBy("quality").agg(F.sum("n_chars").alias("points"), F.count(F.lit(1)).alias("rows"), F.max("n_chars").alias("best"))


@register("SELECT l_orderkey, round(0.8 * avg(l_quantity) + 0.2 * min(l_quantity), 6) AS quality FROM lineitem GROUP BY l_orderkey HAVING count(*) = 3")
def candidate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.8 mean + 0.2 least over exactly three samples."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(0.8 * F.avg("l_quantity") + 0.2 * F.min("l_quantity"), 6).alias("quality"), F.count(F.lit(1)).alias("n"))
    return own.where("n = 3").select("l_orderkey", "quality")


@register("""WITH r AS (SELECT event_id, user_id, md5(event_type || '|' || props) AS stored, md5(event_type || '|' || CASE WHEN event_id % 9 = 0 THEN '{}' ELSE props END) AS again, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type FROM events)
  SELECT user_id, count(*) AS stored, count(*) FILTER (stored = again) AS equal_hash, count(*) FILTER (stored <> again) AS changed, count(*) FILTER (before = event_type) AS repeated FROM r GROUP BY user_id""")
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored outputs against those of a replay that lost every ninth payload, by hash; and how often a call repeats the one before."""
    digest = lambda payload: F.md5(F.concat_ws("|", "event_type", payload).cast("binary"))
    again = digest(F.when(F.col("event_id") % 9 == 0, "{}").otherwise(F.col("props")))
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    own = table(spark, sf_dir, "events").select("user_id", (digest(F.col("props")) == again).alias("same"), (before == F.col("event_type")).alias("repeats"))
    return own.groupBy("user_id").agg(F.count(F.lit(1)).alias("stored"), F.count_if("same").alias("equal_hash"), F.count_if(~F.col("same")).alias("changed"), F.count_if("repeats").alias("repeated"))

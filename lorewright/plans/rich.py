"""Validation of rich output against an inventory: what must fail as a whole, and what drops with a diagnostic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions.text import normalize_name, quote_matches
from lorewright.plans.base import registrar, table
from lorewright.plans.persistence import insist

QUERIES: dict = {}
register = registrar(QUERIES)

FAILS = (
    "duplicate id", "unknown id", "type mismatch", "duplicate fact id", "invalid field", "unknown endpoint", "self relationship",
)
NO_EVIDENCE, OMITTED, KEPT = "no valid source evidence", "omitted, kept without detail", "kept"


def _grounded(rows: DataFrame, key: list[str], pages: DataFrame) -> DataFrame:
    """key, grounded of rows (key, sources: array of page and quote): whether one quote stands on its page."""
    each = rows.select(*key, F.explode("sources").alias("s")).select(*key, F.col("s.page").alias("page"), normalize_name(F.col("s.quote")).alias("quote"))
    text = pages.select("page", normalize_name(F.col("text")).alias("text"))
    met = each.join(text, "page").where(quote_matches(F.col("quote"), F.col("text")))
    return met.select(*key).distinct().withColumn("grounded", F.lit(True))


def rich_outcomes(entities: DataFrame, facts: DataFrame, relationships: DataFrame, inventory: DataFrame, fields: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, identifier, outcome of every row: one of FAILS, a diagnostic, or kept.

    entities: id, type; facts: owner, fact, field, sources; relationships: source, target, type, sources; inventory: id, type;
    fields: type, field (which fields a type may have); pages: page, text; sources: array of page and quote.  A row that breaks
    several rules has the first of FAILS.  Facts of owners that fail have outcomes of their own.  Inventory entities that the
    output leaves out are told as such.  Null sources ground nothing.
    """
    own = inventory.select("id", F.col("type").alias("own_type"))
    first = lambda *cases: F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in cases], F.lit(KEPT))
    text = lambda *cols: F.concat_ws(":", *[F.col(c).cast("string") for c in cols])

    times = entities.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    many = entities.groupBy("id").agg(F.count(F.lit(1)).alias("all"))
    told = times.join(many, "id").join(own, "id", "left")
    e = told.select(F.lit("entity").alias("kind"), text("id").alias("identifier"), first((F.col("all") > 1, FAILS[0]), (F.col("own_type").isNull(), FAILS[1]), (F.col("own_type") != F.col("type"), FAILS[2])).alias("outcome")).distinct()
    left = own.join(entities.select("id"), "id", "left_anti").select(F.lit("entity").alias("kind"), text("id").alias("identifier"), F.lit(OMITTED).alias("outcome"))

    twice = facts.groupBy("owner", "fact").agg(F.count(F.lit(1)).alias("n"))
    allowed = fields.select(F.col("type").alias("own_type"), "field", F.lit(True).alias("allowed")).distinct()
    f = facts.join(twice, ["owner", "fact"]).join(own.withColumnRenamed("id", "owner"), "owner", "left").join(allowed, ["own_type", "field"], "left")
    f = f.join(_grounded(facts, ["owner", "fact"], pages), ["owner", "fact"], "left")
    outcome = first((F.col("own_type").isNull(), FAILS[1]), (F.col("n") > 1, FAILS[3]), (F.col("allowed").isNull(), FAILS[4]), (F.col("grounded").isNull(), NO_EVIDENCE))
    f = f.select(F.lit("fact").alias("kind"), text("owner", "fact").alias("identifier"), outcome.alias("outcome"))

    def end(name: str) -> DataFrame:
        return own.select(F.col("id").alias(name), F.lit(True).alias(f"has_{name}"))

    r = relationships.join(end("source"), "source", "left").join(end("target"), "target", "left")
    r = r.join(_grounded(relationships, ["source", "target", "type"], pages), ["source", "target", "type"], "left")
    unknown: Column = F.col("has_source").isNull() | F.col("has_target").isNull()
    outcome = first((unknown, FAILS[5]), (F.col("source") == F.col("target"), FAILS[6]), (F.col("grounded").isNull(), NO_EVIDENCE))
    r = r.select(F.lit("relationship").alias("kind"), text("source", "target", "type").alias("identifier"), outcome.alias("outcome"))
    return e.unionByName(left).unionByName(f).unionByName(r)


def validated(outcomes: DataFrame) -> DataFrame:
    """outcomes without those kept; the query fails if one of FAILS is among them."""
    return insist(outcomes, F.col("outcome").isin(*FAILS), "rich output must not break the inventory").where(F.col("outcome") != KEPT)


def _source(page: Column, quote: Column) -> Column:
    return F.array(F.struct(page.alias("page"), quote.alias("quote")))


@register("""WITH inv AS (SELECT p_partkey AS id, p_type AS type FROM part), en AS (SELECT p_partkey + CASE WHEN p_size = 1 THEN 1000000 ELSE 0 END AS id, CASE WHEN p_size = 2 THEN 'OTHER' ELSE p_type END AS type FROM part WHERE p_size <> 3 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size = 4),
  e AS (SELECT id, type, count(*) OVER (PARTITION BY id) AS n FROM en), fa AS (SELECT l_partkey AS owner, l_orderkey * 10 + CASE WHEN l_quantity = 7 THEN 0 ELSE l_linenumber END AS fact, CASE WHEN l_quantity = 9 THEN 'secret' ELSE l_returnflag END AS field, l_discount < 0.075 AS ok FROM lineitem),
  gr AS (SELECT owner, fact, coalesce(bool_or(ok), false) AS ok, count(*) AS n FROM fa GROUP BY owner, fact),
  re AS (SELECT l_partkey AS source, l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 WHEN l_linenumber = 6 THEN 0 ELSE 1 END AS target, l_linestatus AS type, l_discount AS dsc FROM lineitem), rg AS (SELECT source, target, type, coalesce(bool_or(dsc < 0.045), false) AS ok FROM re GROUP BY ALL)
  SELECT DISTINCT 'entity' AS kind, e.id::VARCHAR AS identifier, CASE WHEN n > 1 THEN 'duplicate id' WHEN inv.type IS NULL THEN 'unknown id' WHEN inv.type <> e.type THEN 'type mismatch' ELSE 'kept' END AS outcome FROM e LEFT JOIN inv USING (id)
  UNION ALL SELECT 'entity', id::VARCHAR, 'omitted, kept without detail' FROM inv WHERE id NOT IN (SELECT id FROM en)
  UNION ALL SELECT 'fact', owner || ':' || fact, CASE WHEN inv.id IS NULL THEN 'unknown id' WHEN n > 1 THEN 'duplicate fact id' WHEN field = 'secret' THEN 'invalid field' WHEN NOT gr.ok THEN 'no valid source evidence' ELSE 'kept' END FROM fa JOIN gr USING (owner, fact) LEFT JOIN inv ON inv.id = owner
  UNION ALL SELECT 'relationship', source || ':' || target || ':' || re.type, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'unknown endpoint' WHEN source = target THEN 'self relationship' WHEN NOT rg.ok THEN 'no valid source evidence' ELSE 'kept' END FROM re JOIN rg USING (source, target, type) LEFT JOIN inv a ON a.id = source LEFT JOIN inv b ON b.id = target""")
def rich_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every row of a rich output over parts: entities, facts and relationships of line items."""
    p, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    k, size = F.col("p_partkey"), F.col("p_size")
    inventory = p.select(k.alias("id"), F.col("p_type").alias("type"))
    entities = p.where("p_size <> 3").select((k + F.when(size == 1, 1_000_000).otherwise(0)).alias("id"), F.when(size == 2, "OTHER").otherwise(F.col("p_type")).alias("type"))
    entities = entities.unionByName(p.where("p_size = 4").select(k.alias("id"), F.col("p_type").alias("type")))
    good = lambda cond: F.when(cond, F.lit("was sold in great numbers")).otherwise(F.lit("was never seen in any market"))
    page = F.col("l_orderkey") % 50
    facts = item.select(
        F.col("l_partkey").alias("owner"), (F.col("l_orderkey") * 10 + F.when(F.col("l_quantity") == 7, 0).otherwise(F.col("l_linenumber"))).alias("fact"),
        F.when(F.col("l_quantity") == 9, "secret").otherwise(F.col("l_returnflag")).alias("field"), _source(page, good(F.col("l_discount") < 0.075)).alias("sources"),
    )
    target = F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 1_000_000).when(F.col("l_linenumber") == 6, 0).otherwise(1)
    relationships = item.select(F.col("l_partkey").alias("source"), target.alias("target"), F.col("l_linestatus").alias("type"), _source(page, good(F.col("l_discount") < 0.045)).alias("sources"))
    fields = p.select(F.col("p_type").alias("type")).distinct().withColumn("field", F.explode(F.array(*[F.lit(x) for x in "ANR"])))
    pages = item.select(page.alias("page")).distinct().withColumn("text", F.lit("The thing was sold in great numbers, they say."))
    return rich_outcomes(entities, facts, relationships, inventory, fields, pages)

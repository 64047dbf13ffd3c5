"""Mentions that texts use as a class, and definite nouns that refer to one named thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import participants as P
from lorewright.operators import source_forms as S
from lorewright.plans.base import registrar, table
from lorewright.storage import materialize

QUERIES: dict = {}
register = registrar(QUERIES)

#: What a line says, by its number, and what its claim asks: template tables that Spark and SQL both read.
SAID = (
    "Several guards stood by.", "The guard sleeps here.", "A wounded soldier called Bert came.", "The Elder spoke.", "Wolves hunt, wolves hunt.", "Nothing stirred.", "The {0} stood.", "Then another tower rose.", "The {0} fell.",
)
ASKED = ("guards", "the tower", "soldier", "elder", "the guard", "wolves", "the spire")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders: doc, unit, place, context, text, asks."""
    item = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    doc, place = F.col("l_orderkey"), F.col("l_linenumber")
    name = pick(("Iron Tower", "Old Tower", "Moon Spire"), F.col("p"))
    text = F.replace(pick(SAID, doc * 3 + place * 5 + F.floor(doc / 9)), F.lit("{0}"), name)
    context = F.when(place <= 2, "a").when(place <= 4, "a > b").otherwise("c")
    return item.select(doc.alias("doc"), (doc * 10 + place).alias("unit"), place.alias("place"), context.alias("context"), text.alias("text"), pick(ASKED, doc + place).alias("asks"))


def towers(spark: SparkSession) -> DataFrame:
    """The three places that lines name."""
    return spark.createDataFrame([(1, "Iron Tower", None, "location"), (2, "Old Tower", None, "location"), (3, "Moon Spire", None, "location")], "id long, name string, aliases array<string>, type string")


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_UNITS = f"""it AS (SELECT l_orderkey AS doc, l_linenumber AS place, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber),
  un AS MATERIALIZED (SELECT doc, doc * 10 + place AS unit, place, (doc * 3 + place * 5 + doc // 9) % {len(SAID)} AS k, p % 3 + 1 AS t, {_LIST(ASKED)}[(doc + place) % {len(ASKED)} + 1] AS asks, CASE WHEN place <= 2 THEN 0 WHEN place <= 4 THEN 1 ELSE 2 END AS c FROM it),
  sc AS MATERIALIZED (SELECT a.unit AS mention, a.asks, a.place AS cp, u.* FROM un a JOIN un u ON u.doc = a.doc AND u.place <= a.place AND CASE a.c WHEN 0 THEN u.c = 0 WHEN 1 THEN u.c <= 1 ELSE u.c = 2 END)"""


@register(f"""WITH {_UNITS}, us AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'guard' WHEN k = 2 THEN 'soldier' WHEN k = 3 THEN 'elder' WHEN k = 4 THEN 'wolve' END AS noun FROM sc),
  mt AS (SELECT * FROM us WHERE noun = CASE asks WHEN 'guards' THEN 'guard' WHEN 'the guard' THEN 'guard' WHEN 'wolves' THEN 'wolve' ELSE asks END)
  SELECT mention, CASE WHEN any_value(noun) = 'guard' THEN arg_min(unit, CASE WHEN k IN (0, 1) THEN place END) ELSE arg_min(unit, place) END AS proof FROM mt
  WHERE noun IN ('guard', 'wolve') GROUP BY mention HAVING bool_or(unit = mention) AND (any_value(noun) = 'guard' OR count(*) >= 2)""")
def class_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims' mentions that the cited line and its scope use as a class."""
    own = materialize(units(spark, sf_dir), "units")
    mentions = own.select(F.col("unit").alias("mention"), F.col("unit").alias("claim"), F.col("asks").alias("text"))
    return S.generic_mentions(mentions, own.select(F.col("unit").alias("claim"), "doc", "unit"), own.drop("asks"), towers(spark))


@register(f"""WITH {_UNITS}, nm AS (SELECT *, CASE WHEN t = 3 THEN 'the spire' ELSE 'the tower' END AS head FROM sc WHERE k IN (6, 8)),
  a AS (SELECT mention, min(t) AS id, max(t) AS top, min(place) AS fp, arg_min(unit, place) AS anchor, any_value(asks) AS asks, any_value(cp) AS cp FROM nm WHERE head = asks GROUP BY mention HAVING min(t) = max(t))
  SELECT mention, id, anchor FROM a WHERE NOT (asks = 'the tower' AND EXISTS (SELECT 1 FROM sc WHERE sc.mention = a.mention AND sc.k = 7 AND sc.place > a.fp))""")
def definite_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims' mentions "the tower" and "the spire" with the one place of their scope that they refer to."""
    own = materialize(units(spark, sf_dir), "units")
    mentions = own.select(F.col("unit").alias("mention"), F.col("unit").alias("claim"), F.col("asks").alias("text"))
    return S.referred_entities(mentions, own.select(F.col("unit").alias("claim"), "doc", "unit"), own.drop("asks"), towers(spark))


NAMED = ("Iron Tower", "guards", "the tower", "Bert", "Elder", "the spire guards", "they", "villagers", "the old tower", "Gold Hand", "nobody here")


@register(f"""WITH {_UNITS}, mn AS (SELECT *, {_LIST(NAMED)}[(doc * 2 + place) % {len(NAMED)} + 1] AS m FROM un),
  s AS (SELECT mn.unit AS mention, mn.m, mn.place AS cp, u.unit, u.place, u.k, u.t FROM mn JOIN un u ON u.doc = mn.doc AND u.place <= mn.place AND CASE mn.c WHEN 0 THEN u.c = 0 WHEN 1 THEN u.c <= 1 ELSE u.c = 2 END),
  nm AS (SELECT * FROM s WHERE k IN (6, 8)), pv AS (SELECT mention, t, arg_max(unit, place) AS unit FROM nm GROUP BY mention, t),
  rf AS (SELECT mention, min(t) AS id, min(place) AS fp, arg_min(unit, place) AS unit FROM nm WHERE m IN ('the tower', 'the old tower') AND t < 3 GROUP BY mention HAVING min(t) = max(t)),
  ro AS (SELECT * FROM rf WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.mention = rf.mention AND k = 7 AND s.place > rf.fp)),
  co AS (SELECT mention, min(t) AS id, arg_max(unit, place) AS unit FROM nm GROUP BY mention HAVING min(t) = max(t)),
  gg AS (SELECT mention, arg_min(unit, place) AS unit FROM s WHERE m IN ('guards', 'the spire guards') AND k IN (0, 1) GROUP BY mention HAVING bool_or(unit = mention)),
  be AS (SELECT mention, arg_max(unit, place) AS unit FROM s WHERE m = 'Bert' AND k = 2 OR m = 'Elder' AND k = 3 GROUP BY mention)
  SELECT mn.unit AS mention, CASE WHEN m IN ('Iron Tower', 'the old tower') THEN 'exact' WHEN ro.id IS NOT NULL AND m = 'the tower' THEN 'source_form' WHEN gg.unit IS NOT NULL THEN 'generic' WHEN m = 'Gold Hand' THEN 'identity' WHEN be.unit IS NOT NULL THEN 'candidate'
      WHEN m IN ('villagers', 'guards') THEN 'generic' WHEN m IN ('they', 'the tower', 'the spire guards') AND co.id IS NOT NULL THEN 'coreference' ELSE 'unresolved' END AS kind,
    CASE WHEN m = 'Iron Tower' THEN 1 WHEN m = 'the old tower' THEN 2 WHEN m = 'the tower' THEN coalesce(ro.id, co.id) WHEN m = 'Gold Hand' THEN 3 WHEN m IN ('they', 'the spire guards') AND gg.unit IS NULL THEN co.id END AS id,
    CASE WHEN be.unit IS NOT NULL THEN 'candidate:' || lower(m) END AS candidate,
    CASE WHEN m = 'Iron Tower' THEN p1.unit WHEN m = 'the old tower' THEN p2.unit WHEN m = 'the tower' THEN coalesce(ro.unit, co.unit) WHEN m = 'Gold Hand' THEN p3.unit WHEN m IN ('they', 'the spire guards') THEN coalesce(gg.unit, co.unit) ELSE coalesce(gg.unit, be.unit) END AS evidence
  FROM mn LEFT JOIN ro ON ro.mention = mn.unit LEFT JOIN co ON co.mention = mn.unit LEFT JOIN gg ON gg.mention = mn.unit LEFT JOIN be ON be.mention = mn.unit
  LEFT JOIN pv p1 ON p1.mention = mn.unit AND p1.t = 1 LEFT JOIN pv p2 ON p2.mention = mn.unit AND p2.t = 2 LEFT JOIN pv p3 ON p3.mention = mn.unit AND p3.t = 3""")
def staged_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims' participants by eight stages, over the lines that claims cite and their scopes."""
    own = materialize(units(spark, sf_dir), "units")
    name = F.element_at(F.array(*[F.lit(x) for x in NAMED]), ((F.col("doc") * 2 + F.col("place")) % len(NAMED) + 1).cast("int"))
    mentions = own.select(F.col("unit").alias("mention"), F.col("unit").alias("claim"), name.alias("text"))
    same = spark.createDataFrame([("gold hand", 3)], "name string, id long")
    return P.resolve_in_source(mentions, own.select(F.col("unit").alias("claim"), "doc", "unit"), own.drop("asks"), towers(spark), same)

"""Unicode normalisers, keys, repeated titles, and scans whose predicates or fields may be missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.plans.base import PAGES, pages, registrar, table

QUERIES: dict = {}
register = registrar(QUERIES)

#: What is planted into texts, and what it stands for: ligatures, full-width letters, a decomposed accent, a Roman numeral.
PLANTED = (("fi", "\ufb01"), ("A", "\uff21"), ("z", "\uff5a"), ("\u00ea", "e\u0302"), ("IV", "\u2163"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in which some letters stand in another compatibility form."""
    said = F.concat(F.lit("Afiz êIV’s "), "text")
    return pages(spark, sf_dir).select("document_id", "page", reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), PLANTED, said).alias("said"))


_PLAIN = f"{PAGES}, pl AS (SELECT document_id, page, 'Afiz êIV’s ' || text AS said FROM pg)"


@register(f"WITH {_PLAIN} SELECT document_id, page, " + r"trim(regexp_replace(lower(said), '[^\p{L}\p{N}]+', ' ', 'g')) AS name FROM pl")
def composed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose compatibility forms differ meet under one key."""
    return planted(spark, sf_dir).select("document_id", "page", T.normalize_name(T.compatible(F.col("said"))).alias("name"))


@register(f"WITH {_PLAIN} SELECT document_id, page, " + r"""regexp_replace(trim(regexp_replace(replace(lower(said), '’', ''''), '[^\p{L}\p{N}''+-]+', ' ', 'g')), '^(?:a|an)\s+', '') AS content FROM pl""")
def composed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("document_id", "page", T.normalize_fact(T.compatible(F.col("said"))).alias("content"))


@register(f"WITH {_PLAIN} SELECT document_id, page, " + r"trim(regexp_replace(regexp_replace(lower(strip_accents(said)), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g')) AS evidence FROM pl")
def evidence_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes without accents, punctuation and signs."""
    return planted(spark, sf_dir).select("document_id", "page", T.normalize_evidence(F.col("said")).alias("evidence"))


@register(r"SELECT doc_id, regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+', '_', 'g'), '^_|_$', '') AS key FROM documents")
def snake_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    # only one end is trimmed of a key that has a sign at both, as the rule's first match is replaced
    key = F.regexp_replace(F.lower(first), r"[^\p{L}\p{N}]+", "_")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(key.startswith("_"), F.substr(key, F.lit(2))).otherwise(F.regexp_replace(key, "_$", "")).alias("key"))


@register("""WITH t AS (SELECT p_partkey, string_split(trim(repeat(p_name || ' ', CAST(1 + p_size % 4 AS INTEGER))), ' ') AS t FROM part),
  w AS (SELECT *, list_filter(range(2, len(t) // 2 + 1), lambda w: len(t) % w = 0 AND t[1:len(t) - w] = t[w + 1:len(t)]) AS w FROM t)
  SELECT p_partkey, array_to_string(CASE WHEN len(w) > 0 THEN t[1:w[1]] ELSE t END, ' ') AS title FROM w""")
def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running titles that say the same words again and again, once."""
    said = F.trim(F.repeat(F.concat("p_name", F.lit(" ")), (1 + F.col("p_size") % 4).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.once(F.split(said, " ")), " ").alias("title"))


def scan_where(df: DataFrame, **wanted: object) -> DataFrame:
    """df filtered by the arguments that are given; those that are None filter nothing, and all reach the scan."""
    given = [F.col(name) == value for name, value in wanted.items() if value is not None]
    every: Column | None = reduce(lambda a, b: a & b, given) if given else None
    return df if every is None else df.where(every)


@register("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'click'")
def conditional_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two predicates one is given."""
    return scan_where(table(spark, sf_dir, "events"), event_type="click", user_id=None).select("event_id", "event_type", "user_id")


@register("""SELECT d.doc_id, '{' || array_to_string(list_filter(['"doc_id":' || d.doc_id, '"lang":"' || lang || '"', '"quality":' || quality, '"toxic":' || toxic], lambda x: x IS NOT NULL), ',') || '}' AS fields
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def defined_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as objects without their undefined fields."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return own.select("doc_id", F.to_json(F.struct("doc_id", "lang", "quality", "toxic")).alias("fields"))

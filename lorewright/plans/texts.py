"""Scalar text operators and line recurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.plans.base import LINES, PAGES, lines, pages, registrar, table

QUERIES: dict = {}
register = registrar(QUERIES)

NAME_SQL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
COMPACT_SQL = r"trim(regexp_replace({0}, '[\t ]+', ' ', 'g'))"
KEY_SQL = r"regexp_replace(regexp_replace(lower(" + COMPACT_SQL + r"), '\b\d+\b', '#', 'g'), '\s+', ' ', 'g')"
ORNAMENT_SQL = r"regexp_matches(" + COMPACT_SQL + r", '(?i)^(?:[-–—•·*]\s*)?(?:page\s*)?\d{{1,4}}(?:\s*(?:of|/|\|)\s*\d{{1,4}})?(?:\s*[-–—•·*])?$')"


@register(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '^\s+|\s+$', '', 'g') AS page_text FROM documents""")
def page_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_page(F.col("text")).alias("page_text"))


@register("SELECT doc_id, " + NAME_SQL.format("text") + " AS name FROM documents")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_name(F.col("text")).alias("name"))


@register(r"""SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(lower(text), '[’'']', '''', 'g'), '[^\p{L}\p{N}''+-]+', ' ', 'g')), '^(?:a|an)\s+', '') AS content
  FROM conversations""")
def fact_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_fact(F.col("text")).alias("content"))


@register(r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS said FROM conversations")
def spaces_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_spaces(F.col("text")).alias("said"))


@register(f"WITH {LINES} SELECT doc_id, line_no, " + KEY_SQL.format("line") + " AS key FROM ln")
def recurrence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", T.recurrence_key(F.col("line")).alias("key"))


@register(r"""SELECT l_orderkey, l_linenumber, l_suppkey || '|' || l_partkey || '|literal:' || trim(regexp_replace(lower('Sold-As: ' || l_returnflag || l_linestatus), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
  FROM lineitem""")
def relationship_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat(F.lit("Sold-As: "), "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.relationship_key(F.col("l_suppkey"), F.col("l_partkey"), kind).alias("key"))


@register(r"""SELECT conv_id, turn, h || upper(c) || substr(text, length(h) + length(c) + 1) AS shown FROM (SELECT *,
  regexp_extract(text, '^([^\p{L}]*)(\p{L}?)', 1) h, regexp_extract(text, '^([^\p{L}]*)(\p{L}?)', 2) c FROM (SELECT conv_id, turn, '- ' || lower(text) AS text FROM conversations))""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.display_name(F.concat(F.lit("- "), F.lower("text"))).alias("shown"))


@register(
    f"WITH {LINES}, c AS (SELECT doc_id, line_no, " + COMPACT_SQL.format("line") + r""" AS s FROM ln)
  SELECT doc_id, line_no, length(s) <= 180 AND NOT regexp_matches(s, '[!?]') AND regexp_matches(s,
    '(?i)\b(?:order\s*#?\s*\d+\)?\s*$|customer\s*(?:id|number|#)\s*[:#]?\s*\d+\s*$|downloaded\s+(?:by|for)|purchased\s+by|copyright|all rights reserved)') AS watermark,
  length(s) BETWEEN 8 AND 100 AND len(regexp_split_to_array(s, '\s+')) <= 10 AND NOT regexp_matches(s, '[.!?;:,()#]') AND NOT regexp_matches(s, '\d') AND regexp_matches(s, '\p{L}')
    AND NOT regexp_matches(s, '(?i)^(?:a|an|if|when|while|each|any|some|many|several)\s') AS title_like, """
    + ORNAMENT_SQL.format("s") + " AS ornament FROM c"
)
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.compact(F.col("line"))
    own = lines(spark, sf_dir).select("doc_id", "line_no", s.alias("s"))
    c = F.col("s")
    return own.select("doc_id", "line_no", T.is_watermark(c).alias("watermark"), T.is_title_like(c).alias("title_like"), T.is_page_ornament(c).alias("ornament"))


_TITLES = ", ".join(f"'{t}'" for t in T.GENERIC_TITLES)


@register(
    "WITH n AS (SELECT p_partkey, " + NAME_SQL.format("p_name") + f""" AS name FROM part), t AS (SELECT p_partkey, name, string_split(name, ' ') AS tokens FROM n)
  SELECT p_partkey, CASE WHEN name = '' THEN false WHEN len(tokens) = 1 THEN length(tokens[1]) >= 4 AND tokens[1] NOT IN ({_TITLES})
    ELSE len(list_filter(tokens, lambda x: length(x) >= 3 AND NOT list_contains([{_TITLES}], x) AND x <> 'the')) > 0 END AS safe FROM t"""
)
def safe_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.is_safe_mention(F.col("p_name")).alias("safe"))


@register(r"""SELECT event_id, event_type || ':' || substr(sha256(event_type || chr(0) || regexp_replace(trim(regexp_replace(regexp_replace(lower(props), '[’'']', '''', 'g'),
  '[^\p{L}\p{N}''+-]+', ' ', 'g')), '^(?:a|an)\s+', '')), 1, 24) AS stable_key FROM events""")
def fact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.fact_key(F.col("event_type"), F.col("props")).alias("stable_key"))


@register(f"""WITH {LINES}, k AS (SELECT DISTINCT source, doc_id, {KEY_SQL.format('line')} AS key FROM ln JOIN documents USING (doc_id)),
  n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source), c AS (SELECT source, key, count(*) AS pages FROM k WHERE key <> '' GROUP BY ALL)
  SELECT c.source, key, pages, pages >= greatest(2, ceil(0.6 * n)) AS recurs FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE pages >= 2""")
def line_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line keys on two pages or more of a document (here a source with its documents as pages); those recur that are on 60 % of its pages."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.split("text", "\n").alias("lines"))
    # a page is one row, so its keys are made distinct before they leave it, and no exchange is needed for that
    keys = F.array_distinct(F.transform("lines", T.recurrence_key))
    keyed = docs.select("source", F.explode(keys).alias("key")).where("key <> ''")
    counts = keyed.groupBy("source", "key").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 2")
    sizes = docs.groupBy(F.col("source").alias("of")).agg(F.countDistinct("doc_id").alias("n"))
    recurs = F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") * F.lit(3) / F.lit(5)))
    return counts.join(sizes, F.col("source").eqNullSafe(F.col("of"))).select("source", "key", "pages", recurs.alias("recurs"))


@register(f"""WITH {LINES}, e AS (SELECT *, line_no < 2 AS head, line_no >= n_lines - 2 AS foot FROM ln)
  SELECT doc_id, line_no, CASE WHEN head THEN 'header' ELSE 'footer' END AS edge, {KEY_SQL.format('line')} AS key FROM e WHERE head OR foot""")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last two lines of every page; a line that is both counts as header."""
    own = lines(spark, sf_dir).withColumn("head", F.col("line_no") < 2).withColumn("foot", F.col("line_no") >= F.col("n_lines") - 2)
    edge = F.when(F.col("head"), "header").otherwise("footer")
    return own.where("head OR foot").select("doc_id", "line_no", edge.alias("edge"), T.recurrence_key(F.col("line")).alias("key"))


@register(f"""WITH {PAGES}, h AS (SELECT *, CASE WHEN role = 'user' THEN page END AS heading FROM pg)
  SELECT document_id, page, last_value(heading IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page) AS context FROM h""")
def carried_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading (here a user's turn) carried forward to every later page."""
    own = pages(spark, sf_dir).withColumn("heading", F.when(F.col("role") == "user", F.col("page")))
    return own.select("document_id", "page", F.last("heading", ignorenulls=True).over(Window.partitionBy("document_id").orderBy("page")).alias("context"))


@register("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens_4, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens_3 FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(n / 4).alias("tokens_4"), F.ceil(n / 3).alias("tokens_3"))


@register(r"""SELECT doc_id, len(regexp_extract_all(text, '[^.!?]+(?:[.!?]+|$)')) AS sentences, regexp_extract(text, '[^.!?]+(?:[.!?]+|$)') AS first_sentence FROM documents""")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"[^.!?]+(?:[.!?]+|$)"
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("sentences"), F.regexp_extract("text", pattern, 0).alias("first_sentence")
    )


@register(r"""SELECT l_orderkey, l_linenumber, CASE WHEN k >= 26 THEN chr(97 + k // 26 - 1) ELSE '' END || chr(97 + k % 26) AS letter, lpad(CAST(k AS VARCHAR), 3, '0') AS padded
  FROM (SELECT l_orderkey, l_linenumber, CAST((l_orderkey + l_linenumber) % 60 AS INTEGER) AS k FROM lineitem)""")
def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters a to z, then aa, ab; and numbers padded to three digits."""
    k = ((F.col("l_orderkey") + F.col("l_linenumber")) % 60).cast("int")
    head = F.when(k >= 26, F.char(97 + F.floor(k / 26) - 1)).otherwise("")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(head, F.char(F.lit(97) + k % 26)).alias("letter"), F.lpad(k.cast("string"), 3, "0").alias("padded")
    )


@register(f"""WITH {LINES}, o AS (SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ln)
  SELECT o.doc_id, line_no, CAST(start AS BIGINT) AS start, substr(d.text, CAST(start AS BIGINT) + 1, length(line)) = line AS exact FROM o JOIN documents d USING (doc_id)""")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset of every unit (line) in its page, and whether the raw slice there equals it."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    units = lines(spark, sf_dir).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    return units.join(raw, "doc_id").select("doc_id", "line_no", "start", (F.substr("text", (F.col("start") + 1).cast("int"), F.length("line")) == F.col("line")).alias("exact"))


@register(r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS surface FROM documents)
  SELECT trim(regexp_replace(lower(surface), '[^\p{L}\p{N}]+', ' ', 'g')) AS normalized, count(*) AS occurrences, count(DISTINCT doc_id) AS pages, min(surface) AS surface
  FROM s GROUP BY 1 HAVING count(*) >= 2""")
def candidate_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title-case spans grouped by normalised surface; single occurrences are left out."""
    spans = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))).alias("surface"))
    return (
        spans.groupBy(T.normalize_name(F.col("surface")).alias("normalized"))
        .agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("doc_id").alias("pages"), F.min("surface").alias("surface"))
        .where("occurrences >= 2")
    )


@register(r"""WITH n AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) q FROM benchmark),
  d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) p FROM documents)
  SELECT item_id, doc_id FROM n, d WHERE length(q) >= 8 AND contains(' ' || p || ' ', ' ' || q || ' ')""")
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark passages a document contains, word for word.

    A passage is keyed by its longest word; only documents that have this word meet it (an equi-join), before the
    containment is tested.
    """
    def keyed(df: DataFrame, id_: str, name: str) -> DataFrame:
        return df.select(id_, T.normalize_name(F.col("text")).alias(name)).withColumn("w", F.array_distinct(F.split(name, " ")))

    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    needles = keyed(table(spark, sf_dir, "benchmark"), "item_id", "q").where(F.length("q") >= 8).select("item_id", "q", longest.alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", T.normalize_name(F.col("text")).alias("p"))
    met = docs.select("doc_id", F.explode(F.array_distinct(F.split("p", " "))).alias("key")).join(needles, "key").select("doc_id", "item_id", "q")
    space = F.lit(" ")
    return docs.join(met, "doc_id").where(F.contains(F.concat(space, "p", space), F.concat(space, "q", space))).select("item_id", "doc_id")

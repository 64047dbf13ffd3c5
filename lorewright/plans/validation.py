"""Grounding and validation with reject reasons, and proposition (claim) rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.plans.base import EDGES, PAGES, PARTS, edges, pages, parts, registrar, table
from lorewright.storage import materialize, tasks_for

QUERIES: dict = {}
register = registrar(QUERIES)

_NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

#: Quotes of conversations: the first 60 characters of a turn, with one word swapped in every third, cited on their turn or the next.
_EVIDENCE = r"trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[\p{{P}}\p{{S}}]+', ' ', 'g'), '\s+', ' ', 'g'))"
_QUOTES = f"""{PAGES}, qt AS (SELECT document_id, page AS own, page + CASE WHEN (document_id + page) % 5 = 0 THEN 1 ELSE 0 END AS page,
  CASE (document_id + page) % 3 WHEN 0 THEN regexp_replace(substr(text, 1, 60), '^\\S+', 'zzz') WHEN 1 THEN translate(substr(text, 1, 60), 'aeo', 'áéö') ELSE substr(text, 1, 60) END AS quote FROM pg)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("document_id") + F.col("page")
    head = F.substring("text", 1, 60)
    return pages(spark, sf_dir).select(
        "document_id", F.col("page").alias("own"), (F.col("page") + F.when(k % 5 == 0, 1).otherwise(0)).alias("page"), F.when(k % 3 == 0, F.regexp_replace(head, r"^\S+", "zzz")).when(k % 3 == 1, F.translate(head, "aeo", "áéö")).otherwise(head).alias("quote")
    )


@register(f"""WITH {_QUOTES}, m AS (SELECT qt.document_id, own, {_EVIDENCE.format('qt.quote')} AS q, {_EVIDENCE.format('pg.text')} AS p, pg.page IS NULL AS gone FROM qt LEFT JOIN pg ON pg.document_id = qt.document_id AND pg.page = qt.page),
  t AS (SELECT *, list_filter(string_split(q, ' '), lambda x: length(x) > 2) AS w FROM m), r AS (SELECT *, list_distinct(w) AS d FROM t),
  s AS (SELECT *, length(q) >= 8 AND (contains(p, q) OR (len(d) >= 3 AND len(list_filter(range(1, len(w) - 1), lambda i: contains(p, array_to_string(w[i:i + 2], ' ')))) > 0 AND len(list_intersect(d, string_split(p, ' '))) >= 0.8 * len(d))) AS ok FROM r)
  SELECT document_id, own, CASE WHEN gone THEN 'page is not in this chunk' WHEN NOT ok THEN 'text does not match' ELSE 'accepted' END AS outcome FROM s""")
def source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cited quote: its page is missing, its text does not match, or it is accepted.  Accents, punctuation and signs do not count."""
    p = pages(spark, sf_dir).select("document_id", "page", T.normalize_evidence(F.col("text")).alias("p"))
    own = quotes(spark, sf_dir).withColumn("q", T.normalize_evidence(F.col("quote"))).join(p, ["document_id", "page"], "left")
    ok = T.quote_matches(F.col("q"), F.col("p"))
    return own.select("document_id", "own", F.when(F.col("p").isNull(), "page is not in this chunk").when(~ok, "text does not match").otherwise("accepted").alias("outcome"))


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The first rule of the list that a row breaks; null: none."""
    chain = reduce(lambda c, r: F.when(r[1], r[0]) if c is None else c.when(r[1], r[0]), rules, None)
    return chain


@register(f"""WITH {EDGES}, {PARTS}, n AS (SELECT name, count(*) AS n, min(id) AS id FROM pt WHERE size > 8 GROUP BY name), o AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
  SELECT ord, CASE WHEN o_orderkey IS NULL THEN 'page' WHEN quantity < 2 THEN 'quote' WHEN n.n IS NULL THEN 'unknown' WHEN n.n > 6 THEN 'ambiguous' WHEN n.id = source_id THEN 'self' ELSE 'accepted' END AS outcome
  FROM ed JOIN pt ON pt.id = target_id LEFT JOIN n ON n.name = pt.name LEFT JOIN o ON o_orderkey = page""")
def graph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing rule wins: page, quote, unknown, ambiguous, self."""
    p = parts(spark, sf_dir)
    names = p.where("size > 8").groupBy(F.col("name").alias("n_name")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("n_id"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k")).distinct()
    own = edges(spark, sf_dir).join(p.select(F.col("id").alias("target_id"), "name"), "target_id").join(names, F.col("name") == F.col("n_name"), "left").join(o, F.col("page") == F.col("k"), "left")
    rules = [("page", F.col("k").isNull()), ("quote", F.col("quantity") < 2), ("unknown", F.col("n").isNull()), ("ambiguous", F.col("n") > 6), ("self", F.col("n_id") == F.col("source_id"))]
    return own.select("ord", first_failure(rules).otherwise("accepted").alias("outcome"))


@register(f"WITH {PARTS}, d AS (SELECT l_partkey AS id, count(*) AS facts FROM lineitem WHERE l_discount = 0.1 GROUP BY 1) SELECT pt.id, coalesce(facts, 0) AS facts, coalesce(brand, 'none') AS detail FROM pt LEFT JOIN d USING (id)")
def left_join_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inventory row stays; missing detail gets its default."""
    d = table(spark, sf_dir, "lineitem").where("l_discount = 0.1").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("facts"))
    return parts(spark, sf_dir).join(d, "id", "left").select("id", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("brand", F.lit("none")).alias("detail"))


@register(f"WITH {EDGES}, u AS (SELECT source_id, target_id, min(ord) AS ord FROM ed GROUP BY ALL) SELECT u.ord FROM u WHERE source_id <> target_id AND target_id IN (SELECT p_partkey FROM part WHERE p_size > 2) AND source_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids go, endpoints must survive, self edges are rejected."""
    first = edges(spark, sf_dir).groupBy("source_id", "target_id").agg(F.min("ord").alias("ord")).where("source_id <> target_id")
    p = parts(spark, sf_dir).where("size > 2").select(F.col("id").alias("target_id"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source_id"))
    return first.join(p, "target_id", "left_semi").join(s, "source_id", "left_semi").select("ord")


@register("""WITH u AS (SELECT l_orderkey AS unit, list(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY 1) SELECT a.l_orderkey, a.l_linenumber, list_contains(ids, a.l_partkey + 1) OR list_contains(ids, a.l_suppkey) AS second_in_unit FROM lineitem a JOIN u ON unit = a.l_orderkey""")
def span_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an endpoint is among the unit's entities."""
    item = table(spark, sf_dir, "lineitem")
    u = item.groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_set("l_partkey").alias("ids"))
    joined = item.join(u, F.col("l_orderkey") == F.col("unit"))
    return joined.select("l_orderkey", "l_linenumber", (F.expr("array_contains(ids, l_partkey + 1)") | F.expr("array_contains(ids, l_suppkey)")).alias("second_in_unit"))


@register("SELECT l_orderkey, count(*) AS units, count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS exactly_once FROM lineitem GROUP BY l_orderkey")
def exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every request accounted for once, without gaps."""
    n, k = F.count(F.lit(1)), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n.alias("units"), ((F.countDistinct(k) == n) & (F.min(k) == 1) & (F.max(k) == n)).alias("exactly_once"))


@register(f"WITH {EDGES}, f AS (SELECT DISTINCT source_id, target_id FROM ed WHERE quantity < 30) SELECT ord, CASE WHEN quantity > 45 THEN 'rejected' WHEN f.source_id IS NULL THEN 'NOVEL' ELSE 'DUPLICATE_OF_FIRST_PASS' END AS class FROM ed LEFT JOIN f USING (source_id, target_id) WHERE quantity >= 30")
def sweep_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    first = e.where("quantity < 30").select("source_id", "target_id", F.lit(True).alias("seen")).distinct()
    own = e.where("quantity >= 30").join(first, ["source_id", "target_id"], "left")
    return own.select("ord", F.when(F.col("quantity") > 45, "rejected").when(F.col("seen").isNull(), "NOVEL").otherwise("DUPLICATE_OF_FIRST_PASS").alias("class"))


@register(f"WITH {EDGES}, t AS (SELECT p_partkey AS id FROM part WHERE p_size > 40) SELECT DISTINCT ord FROM ed WHERE source_id IN (SELECT id FROM t) OR target_id IN (SELECT id FROM t)")
def rescue_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which an end is a target: the ends are exploded, so it is a semi join."""
    t = parts(spark, sf_dir).where("size > 40").select(F.col("id").alias("end"))
    ends = edges(spark, sf_dir).select("ord", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("end"))
    return ends.join(t, "end", "left_semi").select("ord").distinct()


@register(f"WITH {EDGES} SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, lower(type) AS k, min(ord) AS ord, count(*) - 1 AS dropped FROM ed WHERE source_id <> target_id GROUP BY ALL")
def reverse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact edges: of both directions the first stays."""
    e = edges(spark, sf_dir).where("source_id <> target_id")
    return e.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), F.lower("type").alias("k")).agg(F.min("ord").alias("ord"), (F.count(F.lit(1)) - 1).alias("dropped"))


@register("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linenumber + CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END AS unit, lag(l_linenumber + CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END) OVER w AS before, lag(l_returnflag) OVER w AS context FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 'heading' WHEN context <> l_returnflag THEN 'other context' WHEN before IS NOT NULL AND unit - before > 1 THEN 'not adjacent' WHEN l_partkey % 50 = 0 THEN 'unknown participant' ELSE 'valid' END AS outcome FROM c""")
def claim_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited units: no headings, one context, adjacent; participants known.  A claim cites its line as a unit, the one after it for quantities from 40."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    cited = table(spark, sf_dir, "lineitem").withColumn("unit", F.col("l_linenumber") + F.when(F.col("l_quantity") >= 40, 1).otherwise(0))
    own = cited.select("*", F.lag("unit").over(w).alias("before"), F.lag("l_returnflag").over(w).alias("context"))
    rules = [
        ("heading", (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1)), ("other context", F.col("context") != F.col("l_returnflag")),
        ("not adjacent", F.col("before").isNotNull() & (F.col("unit") - F.col("before") > 1)), ("unknown participant", F.col("l_partkey") % 50 == 0),
    ]
    return own.select("l_orderkey", "l_linenumber", first_failure(rules).otherwise("valid").alias("outcome"))


@register("""WITH RECURSIVE item AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 40 <> 0 THEN (c_custkey * 7 + 3) % 1400 END AS parent FROM customer WHERE c_acctbal > -500), ok AS (SELECT k FROM item WHERE parent IS NULL UNION SELECT item.k FROM item JOIN ok ON item.parent = ok.k)
  SELECT k FROM ok""")
def grounding_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose chain of parents ends at a root; missing parents, self-parents and cycles fall with all that hangs on them.

    Pointer jumping: a chain of any length is followed in a number of rounds that grows with its logarithm.
    """
    parent = F.when(F.col("c_custkey") % 40 != 0, (F.col("c_custkey") * 7 + 3) % 1400)
    item = table(spark, sf_dir, "customer").where("c_acctbal > -500").select(F.col("c_custkey").alias("k"), parent.alias("up"))
    state = materialize(item.withColumn("ok", F.col("up").isNull()), "chain")
    for _ in range(40):
        above = state.select(F.col("k").alias("a_k"), F.col("up").alias("a_up"), F.col("ok").alias("a_ok"))
        joined = state.join(above, F.col("up") == F.col("a_k"), "left")
        ok = F.col("ok") | F.coalesce("a_ok", F.lit(False))
        new = materialize(joined.select("k", F.when(~ok, F.coalesce("a_up", F.col("up"))).alias("up"), ok.alias("ok"), (ok & ~F.col("ok")).alias("new")), "chain")
        state = new.drop("new")
        if new.where("new").isEmpty():
            return state.where("ok").select("k")
    raise RuntimeError("chains did not settle")


@register("SELECT doc_id, CASE WHEN label.doc_id IS NULL THEN 'unlabelled' WHEN n_chars < 100 THEN 'short' ELSE 'mapped' END AS outcome FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) label USING (doc_id)".replace("label.doc_id IS NULL", "l.k IS NULL").replace("(SELECT DISTINCT doc_id FROM labels) label USING (doc_id)", "(SELECT DISTINCT doc_id AS k FROM labels) l ON l.k = documents.doc_id"))
def classifier_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier output must map to a harvested row."""
    k = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")).distinct()
    own = table(spark, sf_dir, "documents").join(k, F.col("doc_id") == F.col("k"), "left")
    return own.select("doc_id", F.when(F.col("k").isNull(), "unlabelled").when(F.col("n_chars") < 100, "short").otherwise("mapped").alias("outcome"))


# claims

#: The wording of each source status, in order of precedence.
STATUS_RULES = (
    ("gm_instruction", r"(?i)\b(?:gm|game master|you should|have the players|award the players|read aloud)\b"),
    ("plan", r"(?i)\b(?:plans? to|intends? to|intention of|seeks? to|hopes? to|aims? to)\b"),
    ("scheduled", r"(?i)\b(?:day [1-9])\b"),
    ("rumor", r"(?i)\b(?:rumou?red?|is said to|reportedly|some say|believed to|residents report)\b"),
    ("conditional", r"(?i)\b(?:if|unless|would|could|might|should|when the heroes|on a successful|on a failed)\b"),
)


def source_status(text: Column) -> Column:
    return first_failure([(name, text.rlike(pattern)) for name, pattern in STATUS_RULES]).otherwise("established")


_STATUS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(said, '{p}') THEN '{n}'" for n, p in STATUS_RULES) + " ELSE 'established' END"
_SAID = "s AS (SELECT event_id, ['The baron plans to ', 'It is said to ', 'On day 3 they ', 'If asked they ', 'Read aloud: ', 'They ', 'They aim to, if day 2 comes, ', 'Some say they would '][CAST(event_id % 8 AS INTEGER) + 1] || event_type AS said FROM events)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.lit(x) for x in ("The baron plans to ", "It is said to ", "On day 3 they ", "If asked they ", "Read aloud: ", "They ", "They aim to, if day 2 comes, ", "Some say they would ")])
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.element_at(heads, (F.col("event_id") % 8 + 1).cast("int")), "event_type").alias("said"))


@register(f"WITH {_SAID} SELECT event_id, {_STATUS_SQL} AS status FROM s")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("event_id", source_status(F.col("said")).alias("status"))


#: Words that say nothing of a claim's support, the least length of those that do, and the share that a claim needs.
COMMON_WORDS = (
    "that", "this", "with", "from", "have", "their", "they", "them", "when", "where", "will", "would", "could", "into", "about", "there", "which", "were", "been", "because",
    "after", "before", "heroes", "party",
)
TERM_LENGTH, SUPPORTED = 4, 0.32


def terms(text: Column) -> Column:
    """The distinct words of TERM_LENGTH letters or more that are not common."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}]{{{TERM_LENGTH},}}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*COMMON_WORDS)))


_COMMON = "(" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + ")"


@register(rf"""WITH w AS (SELECT conv_id AS document_id, turn + 1 AS page, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]{{{TERM_LENGTH},}}'), lambda x: x NOT IN {_COMMON})) AS w FROM conversations),
  l AS (SELECT *, lag(w) OVER (PARTITION BY document_id ORDER BY page) AS v FROM w), s AS (SELECT document_id, page, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, v)) / len(w) END AS share FROM l WHERE v IS NOT NULL)
  SELECT document_id, page, round(share, 6) AS share, share < {SUPPORTED} AS unverified FROM s""")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a turn's telling words that the turn before has too, and whether that is too little to support it."""
    own = pages(spark, sf_dir).select("document_id", "page", terms(F.col("text")).alias("w"))
    own = own.withColumn("v", F.lag("w").over(Window.partitionBy("document_id").orderBy("page"))).where("v IS NOT NULL")
    share = F.when(F.size("w") == 0, 0.0).otherwise(F.size(F.array_intersect("w", "v")) / F.size("w"))
    return own.select("document_id", "page", F.round(share, 6).alias("share"), (share < SUPPORTED).alias("unverified"))


#: Claims of a task.
CLAIMS = 100_000


def reviewed_additions(additions: DataFrame, claims: DataFrame, tasks: int | None = None) -> DataFrame:
    """claim, same, shared of additions: the claims that say the same, and those that cite one of its units, in order.

    Both sides: claim, statement, context, entities, units.  Two say the same if their statements are equal but for case and
    white space, and so are their contexts and their entities as sets with repeats.  Sides meet by the whole key and by units.
    tasks: among how many each exchange deals them (None: as the session says).
    """
    key = [T.normalize_spaces(F.col("statement")).alias("said"), F.coalesce("context", F.lit("")).alias("context"), F.array_join(F.sort_array("entities"), ",").alias("ids")]
    whole = ["said", "context", "ids"]
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    units = dealt(additions.select("claim", F.explode(F.array_distinct("units")).alias("unit")), "unit")
    # the claims of a unit are listed once, and so are those of a key: no pair of claims is a row, exchanged or stored
    cited = dealt(claims.select(F.col("claim").alias("prior"), F.explode(F.array_distinct("units")).alias("unit")), "unit").groupBy("unit").agg(F.collect_set("prior").alias("priors"))
    listed = dealt(units.join(cited.hint("merge"), "unit"), "claim").groupBy("claim").agg(F.collect_list("priors").alias("priors"))
    shared = listed.select("claim", F.sort_array(F.array_distinct(F.flatten("priors"))).alias("shared"))
    none = F.array().cast(claims.select(F.array("claim")).dtypes[0][1])
    new = dealt(additions.select("claim", *key), "claim").join(shared.hint("merge"), "claim", "left").withColumn("shared", F.coalesce("shared", none))
    # the lists of keys, the longest, meet the additions last; tasks are not put together by the bytes that they read, as they give more
    old = dealt(claims.select(F.col("claim").alias("prior"), *key), *whole).groupBy(*whole).agg(F.sort_array(F.collect_set("prior")).alias("same"))
    return dealt(new, *whole).join(old.hint("merge"), whole, "left").select("claim", F.coalesce("same", none).alias("same"), "shared")


@register("""WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS claim, l_linenumber AS n, min(l_quantity) AS q, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS ctx, min(l_orderkey) AS o FROM lineitem GROUP BY l_orderkey, l_linenumber),
  k AS (SELECT claim, n, 'it was sold ' || p % 40 AS said, ctx, list_sort([s % 7, p % 5]) AS ids, [o // 4, o // 4 + p % 2] AS units FROM i),
  sm AS (SELECT a.claim, list_sort(list(DISTINCT b.claim)) AS same FROM k a JOIN k b USING (said, ctx, ids) WHERE a.n = 1 AND b.n > 1 GROUP BY a.claim),
  un AS (SELECT claim, n, unnest(units) AS u FROM k), sh AS (SELECT a.claim, list_sort(list(DISTINCT b.claim)) AS shared FROM un a JOIN un b USING (u) WHERE a.n = 1 AND b.n > 1 GROUP BY a.claim)
  SELECT k.claim, coalesce(same, []) AS same, coalesce(shared, []) AS shared FROM k LEFT JOIN sm USING (claim) LEFT JOIN sh USING (claim) WHERE n = 1""")
def addition_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added claims (the first line of an order) against those there were (all other lines): equal ones, and ones that share evidence."""
    low = lambda c: F.min(c).alias(c)
    item = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(low("l_quantity"), low("l_partkey"), low("l_suppkey"), low("l_returnflag"))
    p, o = F.col("l_partkey"), F.floor(F.col("l_orderkey") / 4)
    statement = F.concat(F.when(F.col("l_quantity") > 25, " It  was SOLD ").otherwise("it was sold "), (p % 40).cast("string"))
    own = item.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), "l_linenumber", statement.alias("statement"), F.col("l_returnflag").alias("context"),
        F.array(F.col("l_suppkey") % 7, p % 5).alias("entities"), F.array(o, o + p % 2).alias("units"),
    )
    own = materialize(own, "claims")  # read four times
    return reviewed_additions(own.where("l_linenumber = 1"), own.where("l_linenumber > 1"), tasks_for(own, CLAIMS))


@register(f"WITH {_SAID}, q AS (SELECT event_id % 50 AS k, said, event_id, CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS quality FROM s) SELECT k, said, arg_max(event_id, (quality, -event_id)) AS best, count(*) AS n FROM q GROUP BY k, said")
def claim_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal claims the best by quality, then the first."""
    k, q = F.col("event_id") % 50, F.when(F.col("event_id") % 3 == 0, 4).when(F.col("event_id") % 3 == 1, 2).otherwise(1)
    own = statements(spark, sf_dir).select(k.alias("k"), "said", F.struct(q.alias("quality"), (-F.col("event_id")).alias("first")).alias("b"))
    return own.groupBy("k", "said").agg((-F.max("b").getField("first")).alias("best"), F.count(F.lit(1)).alias("n"))


@register("""WITH d AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END AS day FROM events) SELECT event_id, CAST(last_value(day IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR) AS timeline FROM d""")
def claim_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day named, carried forward."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    day = F.when(F.col("event_type") == "purchase", F.to_date("ts"))
    return table(spark, sf_dir, "events").withColumn("day", day).select("event_id", F.last("day", ignorenulls=True).over(w).cast("string").alias("timeline"))


@register("""WITH l AS (SELECT event_id, user_id, ts, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 14400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM l)
  SELECT user_id, batch, count(*) AS n, min(event_id) AS first_event FROM b GROUP BY ALL""")
def gap_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows closer than a limit share a batch (sessions by distance)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (ms - F.lag(ms).over(w)).alias("gap"))
    batch = F.sum(F.when(F.col("gap").isNull() | (F.col("gap") >= 14_400_000), 1).otherwise(0)).over(w)
    return own.withColumn("batch", batch).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@register("SELECT turn, count(*) AS units, count(DISTINCT conv_id) AS requests, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS headings FROM conversations GROUP BY turn")
def preflight_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("turn").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("conv_id").alias("requests"), F.count_if(F.col("role") == "user").alias("headings"))


@register("SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN l_discount > 0.07 THEN 'review' WHEN l_tax > 0.06 THEN 'generic' ELSE 'resolved' END AS disposition FROM lineitem) GROUP BY disposition")
def claim_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("l_discount") > 0.07, "review").when(F.col("l_tax") > 0.06, "generic").otherwise("resolved")
    return table(spark, sf_dir, "lineitem").groupBy(d.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT l.l_orderkey, l.l_linenumber, o_orderpriority = '1-URGENT' AS wanted, l_returnflag = 'R' AS found FROM lineitem l JOIN orders ON o_orderkey = l_orderkey")
def slice_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    own = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return own.select("l_orderkey", "l_linenumber", (F.col("o_orderpriority") == "1-URGENT").alias("wanted"), (F.col("l_returnflag") == "R").alias("found"))


@register("""WITH t AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(?:hit points|saving throw|the)\\b')) AS hits, len(list_filter(string_split(text, '.'), lambda s: length(trim(s)) > 0)) AS clauses FROM documents) SELECT doc_id, clauses, hits >= clauses AND clauses > 0 AS mechanical FROM t""")
def mechanical_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose every clause could be a rule: hits against clauses."""
    hits = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:hit points|saving throw|the)\b"), F.lit(0)))
    clauses = F.size(F.filter(F.split("text", r"\."), lambda s: F.length(F.trim(s)) > 0))
    return table(spark, sf_dir, "documents").select("doc_id", clauses.alias("clauses"), ((hits >= clauses) & (clauses > 0)).alias("mechanical"))



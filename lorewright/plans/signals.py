"""All signals that two entities may be one: names, pages, excerpts that hold both, and explicit statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.functions.text import normalize_name
from lorewright.operators.bins import greedy_bins
from lorewright.operators.components import connected_components
from lorewright.operators.mentions import name_spans
from lorewright.operators.similarity import overlapping_sets
from lorewright.plans.base import PARTS, parts, registrar, table
from lorewright.plans.resolution import _BLOCKED, ENTITIES, PAIRS, blocked_pairs, features, with_ends
from lorewright.storage import in_tasks, materialize, tasks_for

QUERIES: dict = {}
register = registrar(QUERIES)

NAMES = (
    "exact_name", "article_variant", "token_reorder", "conservative_subset", "npc_title_variant", "polity_formal_variant", "name_contains_distinctive",
    "organization_qualifier_variant", "shared_distinctive_stem",
)
OTHERS = ("source_page_overlap", "contextual_coreference", "explicit_alias", "explicit_identity")
#: Members of sets in a task.
MEMBERS = 100_000


def coreferences(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """left_id, right_id of entities (id, name: normalised) whose names both stand in an excerpt (id, text) of one of them."""
    excerpts = sources.select("id", normalize_name(F.col("text")).alias("text")).where("text <> ''").distinct()
    excerpts = materialize(excerpts.withColumn("excerpt", F.xxhash64("id", "text")), "excerpts")
    named = name_spans(excerpts.select("excerpt", F.col("id").alias("owner"), "text"), ["excerpt", "owner"], entities.select("id", "name").where("name <> ''"))
    named = materialize(named.select("excerpt", "owner", "id").distinct(), "named")
    own = named.where("owner = id").select("excerpt", "owner")
    met = named.where("owner <> id").join(own, ["excerpt", "owner"], "left_semi")
    return met.select(F.least("owner", "id").alias("left_id"), F.greatest("owner", "id").alias("right_id")).distinct()


def pair_signals(entities: DataFrame, sources: DataFrame, statements: DataFrame) -> DataFrame:
    """left_id, right_id and a column for each of the thirteen signals, of pairs with one at least.

    entities: id, type, name (normalised); sources: id, page, text; statements: kind (alias or identity), left_id, right_id.
    Pairs meet by the block keys of names, by overlapping pages, by excerpts and by statements; names are compared for all.
    """
    own = materialize(entities.withColumn("tokens", F.split("name", " ")), "entities")
    ordered = statements.where("left_id <> right_id").select("kind", F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    spark = own.sparkSession
    with in_tasks(spark, tasks_for(own, ENTITIES)):
        tasks = max(tasks_for(own, ENTITIES), tasks_for(sources, MEMBERS))
    with in_tasks(spark, tasks):
        marks = (
            overlapping_sets(sources.select("id", F.col("page").alias("item")), tasks=tasks).select("left_id", "right_id", F.lit(OTHERS[0]).alias("mark"))
            .unionByName(coreferences(own, sources).withColumn("mark", F.lit(OTHERS[1])))
            .unionByName(ordered.where("kind IN ('alias', 'identity')").select("left_id", "right_id", F.concat(F.lit("explicit_"), "kind").alias("mark")))
            .unionByName(blocked_pairs(entities).select("left_id", "right_id", F.lit("").alias("mark")))
        )
        marks = materialize(marks, "marks")
    tasks = tasks_for(marks, PAIRS)
    pairs = marks.repartition(tasks, "left_id").groupBy("left_id", "right_id").agg(F.collect_set("mark").alias("marks"))
    pairs = with_ends(pairs, own, tasks)
    told = pairs.withColumn("reasons", features(pairs))
    return told.select(
        "left_id", "right_id", *[F.array_contains("reasons", n).alias(n) for n in NAMES], *[F.array_contains("marks", n).alias(n) for n in OTHERS]
    )


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, sources, statements) of parts: each is on four pages from its own on (two for every seventh), and its excerpt
    names it, and for every fifth also the third after it; every ninth states an alias or an identity with another."""
    p = parts(spark, sf_dir)
    own = p.select("id", "type", normalize_name(F.concat_ws(" ", "brand", F.lit("of the"), "name", F.concat(F.lit("no"), F.col("id").cast("string")))).alias("name"))
    pages = F.explode(F.sequence(F.col("id"), F.col("id") + F.when(F.col("id") % 7 == 0, 1).otherwise(3)))
    third = own.select((F.col("id") - 3).alias("id"), F.col("name").alias("other"))
    told = own.join(third, "id", "left")
    text = F.when(F.col("id") % 5 == 0, F.concat_ws(", then ", F.upper("name"), "other")).otherwise(F.col("name"))
    sources = told.select("id", pages.alias("page"), text.alias("text"))
    said = p.where("id % 9 = 0 AND id >= 18").select(F.when(F.col("id") % 2 == 0, "alias").otherwise("identity").alias("kind"), F.col("id").alias("left_id"), (F.col("id") - 14).alias("right_id"))
    return own, sources, said


_SIGNED = _BLOCKED.replace("brand || ' of the ' || name", "brand || ' of the ' || name || ' no' || id").replace("ids AS (SELECT x.id AS left_id", "bids AS (SELECT x.id AS left_id").replace(
    "\n  pw AS (SELECT left_id",
    """
  pg AS (SELECT id, unnest(range(id, id + CASE WHEN id % 7 = 0 THEN 2 ELSE 4 END)) AS page FROM pt), pn AS (SELECT id, count(*) AS n FROM pg GROUP BY id),
  ov AS (SELECT x.id AS left_id, y.id AS right_id FROM pg x JOIN pg y ON x.page = y.page AND x.id < y.id JOIN pn a ON a.id = x.id JOIN pn b ON b.id = y.id GROUP BY x.id, y.id, a.n, b.n HAVING count(*) >= 2 AND count(*) / least(a.n, b.n) >= 0.75),
  co AS (SELECT id AS left_id, id + 3 AS right_id FROM pt WHERE id % 5 = 0 AND id + 3 IN (SELECT id FROM pt)),
  sm AS (SELECT id - 14 AS left_id, id AS right_id, id % 2 = 0 AS alias FROM pt WHERE id % 9 = 0 AND id >= 18),
  ids AS (SELECT * FROM bids UNION SELECT left_id, right_id FROM ov UNION SELECT left_id, right_id FROM co UNION SELECT left_id, right_id FROM sm),
  pw AS (SELECT left_id""",
)


@register(f"""WITH {PARTS}, {_SIGNED} SELECT left_id, right_id, exact AS exact_name, article AS article_variant, reorder AS token_reorder, subset AS conservative_subset, false AS npc_title_variant, false AS polity_formal_variant,
  contained AS name_contains_distinctive, core AS organization_qualifier_variant, stems AND NOT exact AND NOT reorder AS shared_distinctive_stem, (left_id, right_id) IN (SELECT (left_id, right_id) FROM ov) AS source_page_overlap,
  (left_id, right_id) IN (SELECT (left_id, right_id) FROM co) AS contextual_coreference, (left_id, right_id) IN (SELECT (left_id, right_id) FROM sm WHERE alias) AS explicit_alias, (left_id, right_id) IN (SELECT (left_id, right_id) FROM sm WHERE NOT alias) AS explicit_identity
  FROM fe WHERE exact OR article OR reorder OR subset OR contained OR core OR stems OR (left_id, right_id) IN (SELECT (left_id, right_id) FROM ov UNION SELECT (left_id, right_id) FROM co UNION SELECT (left_id, right_id) FROM sm)""")
def duplicate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts with each of the thirteen signals (parts hold no titles and no polities, so two of them never stand)."""
    return pair_signals(*evidence(spark, sf_dir))


@register("""WITH m AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS item FROM lineitem), n AS (SELECT id, count(*) AS n FROM m GROUP BY id)
  SELECT x.id AS left_id, y.id AS right_id, count(*) AS overlap FROM m x JOIN m y ON x.item = y.item AND x.id < y.id JOIN n a ON a.id = x.id JOIN n b ON b.id = y.id
  GROUP BY x.id, y.id, a.n, b.n HAVING count(*) >= 2 AND count(*) / least(a.n, b.n) >= 0.75""")
def page_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share two parts and three in four of the smaller one's."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item"))
    return overlapping_sets(members, tasks=tasks_for(members, MEMBERS))


MOST_PAIRS, MOST_BYTES, PAIR_BYTES = 24, 48_000, 640


def adjudication_batches(pairs: DataFrame, most: int = MOST_PAIRS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """batch, component, left_id, right_id of pairs (left_id, right_id, bytes): whole components in order while they fit.

    A component over a bound is cut at its pairs, in order, and shares no batch with others.  Batches hold most pairs and
    most_bytes at most, unless one pair alone has more.
    """
    named = connected_components(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    own = materialize(pairs.join(named.select(F.col("node").alias("left_id"), "component"), "left_id"), "components")
    sums = own.groupBy("component").agg(F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("size"))
    fits = (F.col("count") <= most) & (F.col("size") <= most_bytes)
    sums = materialize(sums.withColumn("fits", fits), "sums")
    none = F.lit(None).cast("long")
    whole = sums.where("fits").select("component", none.alias("left_id"), none.alias("right_id"), "count", "size", F.lit(None).cast("string").alias("solo"))
    cut = own.join(sums.where("NOT fits").select("component"), "component").select(
        "component", "left_id", "right_id", F.lit(1).cast("long").alias("count"), F.col("bytes").alias("size"), F.col("component").cast("string").alias("solo")
    )
    items = greedy_bins(whole.unionByName(cut), [F.col("component"), F.col("left_id"), F.col("right_id")], most, most_bytes)
    items = materialize(items.select(F.col("bin").alias("batch"), "component", "left_id", "right_id"), "batches")
    of_whole = own.select("component", "left_id", "right_id").join(items.where("left_id IS NULL").select("component", "batch"), "component")
    return items.where("left_id IS NOT NULL").unionByName(of_whole.select("batch", "component", "left_id", "right_id"))


@register(f"""WITH RECURSIVE {PARTS}, {_BLOCKED}, e AS (SELECT left_id AS a, right_id AS b FROM pr UNION ALL SELECT right_id, left_id FROM pr), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  cp AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a), pb AS (SELECT component, left_id, right_id, {PAIR_BYTES} + 9 * (length(x.name) + length(y.name)) AS bytes FROM pr JOIN cp ON cp.id = left_id JOIN nm x ON x.id = left_id JOIN nm y ON y.id = right_id),
  sm AS (SELECT component, count(*) AS n, sum(bytes) AS s, count(*) <= {MOST_PAIRS} AND sum(bytes) <= {MOST_BYTES} AS fits FROM pb GROUP BY component),
  it AS (SELECT component, NULL::BIGINT AS l, NULL::BIGINT AS q, n, s, NULL::BIGINT AS solo FROM sm WHERE fits UNION ALL SELECT component, left_id, right_id, 1, bytes, component FROM pb JOIN sm USING (component) WHERE NOT fits),
  od AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY component, l, q) AS k FROM it),
  wk AS (SELECT k, component, l, q, solo, n, s, 1 AS batch FROM od WHERE k = 1 UNION ALL SELECT o.k, o.component, o.l, o.q, o.solo, CASE WHEN f THEN w.n + o.n ELSE o.n END, CASE WHEN f THEN w.s + o.s ELSE o.s END, CASE WHEN f THEN batch ELSE batch + 1 END
    FROM (SELECT w.*, o.k AS ok, w.solo IS NOT DISTINCT FROM o.solo AND w.n + o.n <= {MOST_PAIRS} AND w.s + o.s <= {MOST_BYTES} AS f FROM wk w JOIN od o ON o.k = w.k + 1) w JOIN od o ON o.k = w.ok)
  SELECT batch, component, left_id, right_id FROM pb JOIN (SELECT batch, component FROM wk WHERE l IS NULL) USING (component) UNION ALL SELECT batch, component, l, q FROM wk WHERE l IS NOT NULL""")
def adjudication_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate pairs in batches of 24 pairs and 48,000 bytes: whole components in order, larger ones cut at pairs."""
    own = materialize(parts(spark, sf_dir).select("id", "type", normalize_name(F.concat_ws(" of the ", "brand", "name")).alias("name")), "names")
    size = lambda end: own.select(F.col("id").alias(f"{end}_id"), F.char_length("name").alias(end))
    pairs = blocked_pairs(own).select("left_id", "right_id").join(size("left"), "left_id").join(size("right"), "right_id")
    return adjudication_batches(pairs.select("left_id", "right_id", (F.lit(PAIR_BYTES) + 9 * (F.col("left") + F.col("right"))).cast("long").alias("bytes")))

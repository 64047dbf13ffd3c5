"""Deterministic replay: captured chunk output to a canonical graph, without any model call.

Input is one row per chunk (``CHUNKS``).  Every step is a DataFrame operation; ``ord`` columns carry the order that
first-wins rules need.  Rejected rows come out beside the accepted ones, with a reason.
"""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.operators.components import connected_components
from lorewright.operators.hierarchy import location_tree
from lorewright.operators.prominence import rank_within_type
from lorewright.storage import materialize

SOURCES = "array<struct<page_number: int, supporting_text: string>>"
CHUNKS = (
    "campaign_id string, chunk_id string, chunk_index int, validated_output struct<entities: array<struct<temporary_id: string, name: string, type: string, "
    f"roles: array<string>, aliases: array<string>, summary: string, sources: {SOURCES}, facts: array<struct<temporary_id: string, field_key: string, content: string, "
    f"sources: {SOURCES}>>>>, relationships: array<struct<source_temporary_id: string, target_temporary_id: string, relationship_type: string, description: string, "
    f"confidence: double, sources: {SOURCES}>>>"
)


def candidates(chunks: DataFrame) -> DataFrame:
    """One row per candidate entity with a global id chunk:temporary and its order; missing roles and facts are empty."""
    out = chunks.select("campaign_id", "chunk_id", "chunk_index", F.posexplode("validated_output.entities").alias("k", "e"))
    return out.select(
        "campaign_id", F.concat_ws(":", "chunk_id", "e.temporary_id").alias("id"), (F.col("chunk_index").cast("long") * 1_000_000 + F.col("k")).alias("ord"),
        F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce("e.roles", F.array().cast("array<string>")).alias("roles"), F.col("e.summary").alias("summary"), F.col("e.sources").alias("sources"), F.col("e.facts").alias("facts"),
    )


def groups(entities: DataFrame) -> DataFrame:
    """(id, member, canonical): candidates that share type and a normalised name or alias; canonical is the first's id."""
    named = entities.select("campaign_id", "id", "ord", "type", F.explode(F.array_union(F.array("name"), "aliases")).alias("n"))
    ids = named.select("id", "ord", F.concat_ws(":", "campaign_id", "type", T.normalize_name(F.col("n"))).alias("identity"), T.normalize_name(F.col("n")).alias("norm")).where("norm <> ''")
    first = ids.groupBy(F.col("identity").alias("f")).agg(F.min("id").alias("b"))
    joined = ids.join(first, F.col("identity") == F.col("f")).select(F.col("id").alias("a"), "b")
    parts = connected_components(joined)
    own = entities.select("campaign_id", "id", "ord").join(parts, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    lead = Window.partitionBy("campaign_id", "component").orderBy("ord")
    return own.select("campaign_id", "id", "ord", F.first("id").over(lead).alias("canonical"))


def canonical_entities(entities: DataFrame, of: DataFrame) -> DataFrame:
    """First name, longest summary (first of equals), aliases without the own name, roles and sources united."""
    own = entities.join(of.select("id", "canonical"), "id")
    longest = F.max(F.struct(F.length(F.coalesce("summary", F.lit(""))), -F.col("ord"), "summary")).getField("summary")
    merged = own.groupBy("campaign_id", F.col("canonical").alias("key")).agg(
        F.min(F.struct("ord", "name", "type")).alias("first"), longest.alias("summary"),
        F.array_distinct(F.flatten(F.collect_list(F.array_union(F.array("name"), "aliases")))).alias("names"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.count(F.lit(1)).alias("candidates"),
    )
    other = F.filter("names", lambda n: T.normalize_name(n) != T.normalize_name(F.col("first.name")))
    return merged.select("campaign_id", "key", F.col("first.ord").alias("ord"), F.col("first.name").alias("name"), F.col("first.type").alias("type"), "summary", F.sort_array(other).alias("aliases"), "roles", "sources", "candidates")


def relationships(chunks: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical edges, rejected candidates with a reason)."""
    out = chunks.select("campaign_id", "chunk_id", "chunk_index", F.posexplode("validated_output.relationships").alias("k", "r"))
    own = out.select(
        "campaign_id", (F.col("chunk_index").cast("long") * 1_000_000 + F.col("k")).alias("ord"), F.concat_ws(":", "chunk_id", "r.source_temporary_id").alias("s"),
        F.concat_ws(":", "chunk_id", "r.target_temporary_id").alias("t"), F.col("r.relationship_type").alias("type"), F.col("r.description").alias("description"),
        F.col("r.confidence").alias("confidence"), F.col("r.sources").alias("sources"),
    )
    source, target = of.select(F.col("id").alias("s"), F.col("canonical").alias("source_id")), of.select(F.col("id").alias("t"), F.col("canonical").alias("target_id"))
    joined = own.join(source, "s", "left").join(target, "t", "left")
    reason = F.when(F.col("source_id").isNull(), "unknown source").when(F.col("target_id").isNull(), "unknown target").when(F.col("source_id") == F.col("target_id"), "self edge")
    coded = joined.withColumn("reason", reason)
    longest = F.max(F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("ord"), "description")).getField("description")
    edges = coded.where("reason IS NULL").groupBy("campaign_id", "source_id", "target_id", T.normalize_name(F.col("type")).alias("semantic_type")).agg(
        F.min("ord").alias("ord"), F.min(F.struct("ord", "type")).getField("type").alias("type"), F.max("confidence").alias("confidence"), longest.alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.count(F.lit(1)).alias("candidates"),
    )
    keyed = edges.withColumn("id", T.relationship_key(F.col("source_id"), F.col("target_id"), F.col("semantic_type")))
    return keyed, coded.where("reason IS NOT NULL").select("campaign_id", "ord", "reason")


def facts(entities: DataFrame, of: DataFrame) -> DataFrame:
    """Facts by (entity, field, normalised content): evidence united by page and text, in order of first sight."""
    own = entities.join(of.select("id", "canonical"), "id").select("campaign_id", "canonical", "ord", F.posexplode("facts").alias("k", "f"))
    rows = own.select("campaign_id", "canonical", F.struct("ord", "k").alias("ord"), F.col("f.field_key").alias("field"), F.col("f.content").alias("content"), F.explode_outer("f.sources").alias("src"))
    rows = rows.withColumn("norm", T.normalize_fact(F.col("content"))).where("norm <> ''")
    merged = rows.groupBy("campaign_id", "canonical", "field", "norm").agg(
        F.min("ord").alias("ord"), F.min(F.struct("ord", "content")).getField("content").alias("content"),
        F.size(F.collect_set(F.concat_ws(":", F.col("src.page_number").cast("string"), F.trim("src.supporting_text")))).alias("evidence"),
    )
    order = F.row_number().over(Window.partitionBy("campaign_id", "canonical").orderBy("ord")) - 1
    return merged.select("campaign_id", "canonical", "field", "content", T.fact_key(F.col("field"), F.col("content")).alias("stable_key"), "evidence", order.alias("sort_order"))


def _run(width: int, k: Column) -> Column:
    return F.array_join(F.slice("t", k, width), " ")


class Graph:
    """The canonical graph of captured chunks.  A part is made when it is asked for, with the parts that it needs and no others.

    pages (campaign_id, page_number, text) are where mentions are counted.
    """

    def __init__(self, chunks: DataFrame, pages: DataFrame) -> None:
        self._given, self._pages = chunks, pages

    @cached_property
    def _chunks(self) -> DataFrame:
        return materialize(self._given, "chunks")  # made once, read for candidates and relationships

    @cached_property
    def _own(self) -> DataFrame:
        return candidates(self._chunks)

    @cached_property
    def _of(self) -> DataFrame:
        return materialize(groups(self._own), "groups")

    @cached_property
    def _canonical(self) -> DataFrame:
        return materialize(canonical_entities(self._own, self._of), "canonical")

    @cached_property
    def relationships(self) -> DataFrame:
        return materialize(relationships(self._chunks, self._of)[0], "edges")

    @cached_property
    def rejected(self) -> DataFrame:
        return relationships(self._chunks, self._of)[1]

    @cached_property
    def facts(self) -> DataFrame:
        return facts(self._own, self._of)

    @cached_property
    def _located(self) -> tuple[DataFrame, DataFrame]:
        ends = self.relationships.select("id", "source_id", "target_id", F.col("semantic_type").alias("type"), "confidence")
        return location_tree(ends, self._canonical.where("type = 'location'").select(F.col("key").alias("id")))

    @cached_property
    def tree(self) -> DataFrame:
        return self._located[0].select("child", "parent")

    @cached_property
    def tree_notes(self) -> DataFrame:
        return self._located[1]

    @cached_property
    def entities(self) -> DataFrame:
        return ranked_entities(self._canonical, self.relationships, self._pages)


def ranked_entities(entities: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """entities with their mentions on pages, relationships, score and prominence."""
    names = entities.select("campaign_id", "key", F.explode(F.array_union(F.array("name"), "aliases")).alias("n")).where(T.is_safe_mention(F.col("n")))
    names = names.select("campaign_id", "key", T.normalize_name(F.col("n")).alias("n")).distinct().withColumn("width", F.size(F.split("n", " ")))
    widths = [r.width for r in names.select("width").distinct().collect()]  # a handful: words of a name
    tokens = pages.select("campaign_id", "page_number", T.tokens_of(F.col("text")).alias("t"))
    runs = None
    for w in widths:  # token runs as long as a name meet the names by an equi-join
        grams = F.transform(F.sequence(F.lit(1), F.size("t") - (w - 1)), partial(_run, w))
        part = tokens.where(F.size("t") >= w).select("campaign_id", "page_number", F.posexplode(grams).alias("at", "n")).withColumn("width", F.lit(w))
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        runs = tokens.select("campaign_id", "page_number", F.lit(0).alias("at"), F.lit("").alias("n"), F.lit(0).alias("width")).where(F.lit(False))
    met = runs.join(names.drop("width"), ["campaign_id", "n"])
    # a shorter name within a longer one of the same entity is no mention of its own
    longer = F.max(F.col("at") + F.col("width")).over(Window.partitionBy("campaign_id", "key", "page_number").orderBy("at", F.desc("width")).rowsBetween(Window.unboundedPreceding, -1))
    mentions = met.withColumn("taken", longer).where("taken IS NULL OR at >= taken").groupBy("campaign_id", "key").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("page_number").alias("pages"))
    ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("key")).groupBy("key").agg(F.countDistinct("id").alias("relationships"))
    scored = entities.join(mentions, ["campaign_id", "key"], "left").join(ends, "key", "left").na.fill(0, ["mentions", "pages", "relationships"])
    typed = scored.select(F.col("key").alias("entity_id"), "name", F.concat_ws(":", "campaign_id", "type").alias("type"), "pages", "mentions", "relationships")
    ranked = rank_within_type(typed).select(F.col("entity_id").alias("key"), "pages", "mentions", "relationships", "score", "prominence")
    return entities.join(ranked, "key")


def build_graph(chunks: DataFrame, pages: DataFrame) -> Graph:
    """The canonical graph of captured chunks; pages (campaign_id, page_number, text) are where mentions are counted."""
    return Graph(chunks, pages)

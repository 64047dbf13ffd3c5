"""Further operators: inventory ids, recomputation checks, coverage of propositions, section context, reading copies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.functions import grounding
from lorewright.functions import text as T
from lorewright.operators import folds as K
from lorewright.plans.base import LINES, PAGES, PARTS, lines, pages, parts, registrar, table
from lorewright.plans.resolution import blocked_pairs

QUERIES: dict = {}
register = registrar(QUERIES)


@register(f"""WITH {PARTS}, d AS (SELECT DISTINCT type, lower(name) AS n, size AS page FROM pt), h AS (SELECT *, substr(sha256(type || chr(31) || n || chr(31) || page), 1, 32) AS id FROM d)
  SELECT id, type, n, page, count(*) OVER (PARTITION BY id) > 1 AS collides FROM h""")
def inventory_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows once by (type, name, page), with hashed ids and whether an id is met twice."""
    d = parts(spark, sf_dir).select("type", F.lower("name").alias("n"), F.col("size").alias("page")).distinct()
    h = d.withColumn("id", F.substring(F.sha2(F.concat_ws("\x1f", "type", "n", F.col("page").cast("string")), 256), 1, 32))
    return h.select("id", "type", "n", "page", (F.count(F.lit(1)).over(Window.partitionBy("id")) > 1).alias("collides"))


@register("""WITH stored AS (SELECT l_partkey AS k, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1),
  fresh AS (SELECT l_partkey AS k, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1)
  SELECT coalesce(s.k, f.k) AS k, s.n AS stored, f.n AS fresh, CASE WHEN s.k IS NULL THEN 'missing' WHEN f.k IS NULL THEN 'stale' WHEN s.n <> f.n OR s.total <> f.total THEN 'differs' ELSE 'same' END AS state
  FROM stored s FULL JOIN fresh f ON s.k = f.k""")
def recomputation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory stored at a date against its recomputation, by key: same, differing, missing or stale."""
    item = table(spark, sf_dir, "lineitem")
    count = lambda df, n, total: df.groupBy(F.col("l_partkey")).agg(F.count(F.lit(1)).alias(n), F.sum("l_linenumber").alias(total))
    stored = count(item.where("l_shipdate < timestamp_ntz'1998-01-01'"), "stored", "s").withColumnRenamed("l_partkey", "s_key")
    fresh = count(item, "fresh", "f").withColumnRenamed("l_partkey", "f_key")
    state = (
        F.when(F.col("s_key").isNull(), "missing").when(F.col("f_key").isNull(), "stale")
        .when((F.col("stored") != F.col("fresh")) | (F.col("s") != F.col("f")), "differs").otherwise("same")
    )
    return stored.join(fresh, F.col("s_key") == F.col("f_key"), "full").select(F.coalesce("s_key", "f_key").alias("k"), "stored", "fresh", state.alias("state"))


_WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: length(x) >= 4))"


@register(f"""WITH {PAGES}, w AS (SELECT document_id, page, {_WORDS.format('text')} AS w FROM pg), j AS (SELECT a.document_id, a.page, a.w, b.w AS v FROM w a JOIN w b ON a.document_id = b.document_id AND abs(a.page - b.page) = 1),
  s AS (SELECT *, CASE WHEN len(w) = 0 OR len(v) = 0 THEN 0 ELSE len(list_intersect(w, v)) * 1.0 / least(len(w), len(v)) END AS sim FROM j)
  SELECT document_id, page, round(max(sim), 6) AS best, count_if(sim >= 0.45) AS matches, round(len(list_intersect(any_value(w), list_distinct(flatten(list(v) FILTER (sim >= 0.05))))) * 1.0 / greatest(1, len(any_value(w))), 6) AS covered FROM s GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY document_id, page"))
def proposition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far neighbouring statements cover a statement: best similarity, matches, share of words covered jointly."""
    w = pages(spark, sf_dir).select("document_id", "page", F.array_distinct(F.filter(T.tokens_of(F.col("text")), lambda x: F.length(x) >= 4)).alias("w"))
    near = w.select("document_id", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page"), F.col("w").alias("v"))
    sim = F.when((F.size("w") == 0) | (F.size("v") == 0), 0.0).otherwise(F.size(F.array_intersect("w", "v")) / F.least(F.size("w"), F.size("v")))
    s = w.join(near, ["document_id", "page"]).withColumn("sim", sim)
    g = s.groupBy("document_id", "page").agg(F.max("sim").alias("best"), F.count_if(F.col("sim") >= 0.45).alias("matches"), F.first("w").alias("w"), F.flatten(F.collect_list(F.when(F.col("sim") >= 0.05, F.col("v")))).alias("u"))
    covered = F.size(F.array_intersect("w", F.array_distinct("u"))) / F.greatest(F.lit(1), F.size("w"))
    return g.select("document_id", "page", F.round("best", 6).alias("best"), "matches", F.round(covered, 6).alias("covered"))


@register(f"""WITH {LINES}, k AS (SELECT DISTINCT source, doc_id, trim(line) AS s FROM ln JOIN documents USING (doc_id)), r AS (SELECT source, s FROM k WHERE s <> '' GROUP BY ALL HAVING count(*) >= 3)
  SELECT l.doc_id, count(*) AS kept, CAST(coalesce(sum(length(line)), 0) AS BIGINT) AS characters FROM ln l JOIN documents d USING (doc_id) LEFT JOIN r ON r.source = d.source AND r.s = trim(line) WHERE r.s IS NULL GROUP BY l.doc_id""")
def reading_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the running lines of their document (lines on three pages or more)."""
    own = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).withColumn("s", F.trim("line"))
    running = own.where("s <> ''").select("source", "doc_id", "s").distinct().groupBy("source", "s").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("source", "s")
    kept = own.join(running, ["source", "s"], "left_anti")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.length("line")), F.lit(0)).cast("long").alias("characters"))


@register(f"""WITH {PARTS}, t AS (SELECT id, string_split(name, ' ')[1] AS title, string_split(name, ' ')[2] AS noun, size FROM pt), u AS (SELECT title, size, min(id) AS id FROM t GROUP BY title, size HAVING count(*) = 1) SELECT title, size, id FROM u""")
def unique_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that name exactly one entity of a context, so that the bare title stands for it."""
    t = parts(spark, sf_dir).select("id", F.split("name", " ")[0].alias("title"), "size")
    return t.groupBy("title", "size").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("title", "size", "id")


@register(f"""WITH {LINES}, s AS (SELECT doc_id, line_no, length(line) < 40 AS heading FROM ln), c AS (SELECT *, count_if(heading) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM s) SELECT doc_id, section, count(*) AS n_lines, min(line_no) AS first_line FROM c GROUP BY ALL""")
def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that short lines open; a line belongs to the last one opened."""
    s = lines(spark, sf_dir).withColumn("heading", (F.length("line") < 40).cast("int"))
    c = s.withColumn("section", F.sum("heading").over(Window.partitionBy("doc_id").orderBy("line_no")))
    return c.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


@register("""WITH g AS (SELECT l_suppkey AS s, l_partkey AS t, count(DISTINCT l_returnflag) AS flags FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), f AS (SELECT l_suppkey AS s, l_partkey AS t, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
  SELECT CASE WHEN f.n IS NULL THEN 'missed' WHEN flags > 1 THEN 'found in part' ELSE 'found' END AS verdict, count(*) AS gold FROM g LEFT JOIN f USING (s, t) GROUP BY 1""")
def gold_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    g = item.where("l_linestatus = 'F'").groupBy("l_suppkey", "l_partkey").agg(F.countDistinct("l_returnflag").alias("flags"))
    f = item.where("l_linestatus = 'O'").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("n").isNull(), "missed").when(F.col("flags") > 1, "found in part").otherwise("found")
    return g.join(f, ["l_suppkey", "l_partkey"], "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("gold"))


@register(f"""WITH {PARTS}, n AS (SELECT id, type, lower(regexp_replace('the ' || name, '^the ', '')) AS bare, 'the ' || lower(name) AS full_name, brand, size FROM pt) SELECT bare, brand, count(*) AS members, arg_min(id, (-size, id)) AS stays FROM n GROUP BY bare, brand HAVING count(*) > 1""")
def inventory_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows that are one name but for "the": the best of them stays."""
    bare = F.lower(F.regexp_replace(F.concat(F.lit("the "), "name"), "^the ", ""))
    g = parts(spark, sf_dir).groupBy(bare.alias("bare"), "brand").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(-F.col("size"), "id")).getField("id").alias("stays"))
    return g.where("members > 1")


@register(None)
def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of up to 900 characters with offsets and labels 1a, 1b, ... of every page."""
    def label(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(97 + r) + out
        return out

    def run(batches):
        for pdf in batches:
            rows = [(d, p, f"{p}{label(k)}", a, b) for d, p, t in zip(pdf["document_id"], pdf["page"], pdf["text"], strict=True) for k, (a, b) in enumerate(K.sentence_spans(t or "", 900, 200))]
            yield pd.DataFrame(rows, columns=["document_id", "page", "segment", "start", "stop"])

    return pages(spark, sf_dir).select("document_id", "page", "text").mapInPandas(run, "document_id long, page long, segment string, start long, stop long")


@register(None)
def identity_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (the third to fifth word of a turn) grounded on their page and on the page after."""
    own = pages(spark, sf_dir).select("document_id", "page", "text", F.lead("text").over(Window.partitionBy("document_id").orderBy("page")).alias("after"))

    def run(batches):
        for pdf in batches:
            rows = []
            for d, p, t, a in zip(pdf["document_id"], pdf["page"], pdf["text"], pdf["after"], strict=True):
                name = " ".join((t or "").split()[2:5])
                here, there = grounding.ground(name, "event", t or ""), grounding.ground(name, "event", a or "")
                rows.append((d, p, here[0], here[1], there[0]))
            yield pd.DataFrame(rows, columns=["document_id", "page", "here", "start", "there"])

    return own.mapInPandas(run, "document_id long, page long, here string, start long, there string")


@register(None)
def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate candidates in arrival order under caps of 500 a campaign (here a type) and 16 an entity.

    The caps are the operator's own and depend on order; the uncapped set is duplicate_pairs.
    """
    own = parts(spark, sf_dir).select("id", "type", T.normalize_name(F.concat_ws(" of the ", "brand", "name")).alias("name"))
    pairs = blocked_pairs(own).select(F.col("l.type").alias("type"), "left_id", "right_id")

    def fold(pdf: pd.DataFrame):
        held: dict[int, int] = {}
        taken = 0
        for a, b in zip(pdf["left_id"], pdf["right_id"], strict=True):
            if taken < 500 and held.get(a, 0) < 16 and held.get(b, 0) < 16:
                taken += 1
                held[a], held[b] = held.get(a, 0) + 1, held.get(b, 0) + 1
                yield a, b

    return K.per_group(pairs, ["type"], ["left_id", "right_id"], fold, "type string, left_id long, right_id long")

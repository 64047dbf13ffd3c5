"""Queries over order-dependent folds; SQL cannot state them, tests compare them with brute force."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.functions import text as T
from lorewright.operators import folds as K
from lorewright.plans.base import pages, parts, registrar, table

QUERIES: dict = {}
register = registrar(QUERIES)


@register(None)
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages of a document in chunks of up to 2,000 characters with one page of overlap."""
    own = pages(spark, sf_dir).select("document_id", "page", F.length("text").alias("n"))

    def fold(pdf: pd.DataFrame):
        page = pdf["page"].tolist()
        for k, (a, b) in enumerate(K.whole_item_chunks(pdf["n"].tolist(), 2000, 1), 1):
            yield k, page[a], page[b - 1], int(pdf["n"].iloc[a:b].sum())

    return K.per_group(own, ["document_id"], ["page"], fold, "document_id long, chunk long, first_page long, last_page long, characters long")


@register(None)
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence spans of every page with offsets and an order."""
    schema = "document_id long, page long, ord long, start long, stop long"

    def run(batches):
        for pdf in batches:
            rows = [(d, p, k, a, b) for d, p, t in zip(pdf["document_id"], pdf["page"], pdf["text"], strict=True) for k, (a, b) in enumerate(K.sentence_spans(t or ""))]
            yield pd.DataFrame(rows, columns=["document_id", "page", "ord", "start", "stop"])

    return pages(spark, sf_dir).select("document_id", "page", "text").mapInPandas(run, schema)


@register(None)
def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in units of up to 900 characters and 15 names, with backward overlap; a name is a title-case word."""
    schema = "document_id long, page long, unit long, first_span long, last_span long, names long"

    def run(batches):
        for pdf in batches:
            rows = []
            for d, p, t in zip(pdf["document_id"], pdf["page"], pdf["text"], strict=True):
                spans = [(b - a, frozenset(re.findall(r"\b[A-Z]\w+", t[a:b]))) for a, b in K.sentence_spans(t or "")]
                for k, (a, b) in enumerate(K.dense_groups(spans, 900, 15)):
                    rows.append((d, p, k, a, b - 1, len(frozenset().union(*(i for _, i in spans[a:b])))))
            yield pd.DataFrame(rows, columns=["document_id", "page", "unit", "first_span", "last_span", "names"])

    return pages(spark, sf_dir).select("document_id", "page", "text").mapInPandas(run, schema)


@register(None)
def packed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document packed into requests of at most 3 pages and 1,500 estimated tokens."""
    own = pages(spark, sf_dir).select("document_id", "page", F.ceil(F.length("text") / 4).alias("tokens"))

    def fold(pdf: pd.DataFrame):
        cost, page = pdf["tokens"].tolist(), pdf["page"].tolist()
        fits = lambda g: len(g) <= 3 and sum(cost[i] for i in g) <= 1500
        for k, group in enumerate(K.bounded_groups(range(len(cost)), fits), 1):
            yield k, page[group[0]], page[group[-1]], sum(cost[i] for i in group)

    return K.per_group(own, ["document_id"], ["page"], fold, "document_id long, request long, first_page long, last_page long, tokens long")


@register(None)
def focused_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent pages that name two entities or more (here capitalised words of four letters and more) in windows of at most 3 pages and 4,000 characters."""
    named = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\p{Lu}\p{L}{3,})\b"))))
    own = pages(spark, sf_dir).where(named >= 2).select("document_id", "page", F.length("text").alias("n"))

    def fold(pdf: pd.DataFrame):
        rows = list(zip(pdf["page"], pdf["n"], strict=True))
        fits = lambda g: len(g) <= 3 and sum(n for _, n in g) <= 4000
        for group in K.bounded_groups(rows, fits, lambda a, b: b[0] == a[0] + 1):
            yield group[0][0], group[-1][0], sum(n for _, n in group)

    return K.per_group(own, ["document_id"], ["page"], fold, "document_id long, first_page long, last_page long, characters long")


@register(None)
def verbatim_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw slice that a normalised quote stands for."""
    def run(batches):
        for pdf in batches:
            found = [K.map_to_raw(t or "", " ".join((t or "").split())[20:70]) for t in pdf["text"]]
            yield pd.DataFrame({"document_id": pdf["document_id"], "page": pdf["page"], "start": [f[0] if f else -1 for f in found], "stop": [f[1] if f else -1 for f in found]})

    return pages(spark, sf_dir).select("document_id", "page", "text").mapInPandas(run, "document_id long, page long, start long, stop long")


@register(None)
def applied_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge proposals of each campaign (here a supplier) applied in order against its groups."""
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_discount")

    def fold(pdf: pd.DataFrame):
        groups = set((pdf["l_partkey"] % 40).tolist())
        proposals = [(f"p{o % 50}", [int(p % 40), int((p * 3) % 40)], d > 0.03) for o, p, d in zip(pdf["l_orderkey"], pdf["l_partkey"], pdf["l_discount"], strict=True)]
        good, bad = K.accept_proposals(groups, proposals)
        yield len(groups), len(good), len(bad)

    return K.per_group(item, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_discount"], fold, "l_suppkey long, n_groups long, accepted long, rejected long")


@register(None)
def segment_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice of at most 12 pages (orders) that cover a supplier's weighted parts."""
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity")

    def fold(pdf: pd.DataFrame):
        weights = {int(k): int(v) for k, v in pdf.groupby("l_partkey")["l_quantity"].max().items()}
        sets = {int(k): set(map(int, g)) for k, g in pdf.groupby("l_orderkey")["l_partkey"]}
        chosen = K.greedy_cover(sets, weights, 12)
        yield len(chosen), len(set().union(*(sets[k] for k in chosen))) if chosen else 0, len(weights)

    return K.per_group(item, ["l_suppkey"], ["l_orderkey", "l_partkey"], fold, "l_suppkey long, chosen long, covered long, targets long")


@register(None)
def page_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence diffs of each turn with the turn before, as counts."""
    own = pages(spark, sf_dir).withColumn("before", F.lag("text").over(Window.partitionBy("document_id").orderBy("page"))).where("before IS NOT NULL")

    def run(batches):
        for pdf in batches:
            rows = []
            for d, p, t, b in zip(pdf["document_id"], pdf["page"], pdf["text"], pdf["before"], strict=True):
                kinds = [k for k, _ in K.common_subsequence(K.SENTENCE.findall(b or ""), K.SENTENCE.findall(t or ""))]
                rows.append((d, p, kinds.count("same"), kinds.count("added"), kinds.count("removed")))
            yield pd.DataFrame(rows, columns=["document_id", "page", "same", "added", "removed"])

    return own.select("document_id", "page", "text", "before").mapInPandas(run, "document_id long, page long, same long, added long, removed long")

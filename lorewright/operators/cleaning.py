"""Removal of page furniture: running titles, watermarks, bare page numbers, overlays; raw text stays beside.

Lines are rows.  What recurs is counted over a document's pages at their edges; what a line's neighbours are is
read by windows within the page; a removed line becomes a paragraph break, so nothing is glued across it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions import text as T

#: Lines at an edge, pages that a running line must be on at least, and the share of a document's pages.
EDGE_LINES, LEAST_PAGES, SHARE = 2, 2, 0.6
OVERLAY_SPAN, OVERLAY_LENGTH = 8, 12
RUNNING_WORDS = r"\b(?:guide|handbook|manual|chapter|volume|edition|publisher)\b"


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_id, page, line_no, n_lines, line, key, edge) of pages (document_id, page, text)."""
    parts = pages.select("document_id", "page", F.split("text", r"\r?\n").alias("parts"))
    lines = parts.select("document_id", "page", F.size("parts").alias("n_lines"), F.posexplode("parts").alias("line_no", "line"))
    edge = F.when(F.col("line_no") < EDGE_LINES, "header").when(F.col("line_no") >= F.col("n_lines") - EDGE_LINES, "footer")
    return lines.select("*", T.recurrence_key(F.col("line")).alias("key"), edge.alias("edge"))


def running_titles(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, key) of title-like edge lines on enough pages, proven by a name word or by both edges of two pages."""
    counts = pages.groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    need = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") * F.lit(SHARE)))
    edge = lines.where("edge IS NOT NULL AND key <> ''").where(~T.is_page_ornament(F.col("line"))).select("document_id", "page", "key", "edge").distinct()
    both = edge.groupBy("document_id", "page", "key").agg(F.count(F.lit(1)).alias("edges")).groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("on"), F.count_if(F.col("edges") == 2).alias("paired"))
    proven = T.is_title_like(F.col("key")) & ((F.col("paired") >= 2) | F.col("key").rlike(RUNNING_WORDS))
    return both.join(counts, "document_id").where((F.col("on") >= need) & proven).select("document_id", "key")


def marked_lines(pages: DataFrame) -> DataFrame:
    """Every line with the reason why it goes, or null."""
    lines = page_lines(pages)
    titles = running_titles(lines, pages).withColumn("title", F.lit(True))
    marks = lines.where(T.is_watermark(T.compact(F.col("line")))).select("document_id", "page", F.regexp_replace("key", "#+", "#").alias("mark")).distinct()
    marks = marks.groupBy("document_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("document_id", "mark", F.lit(True).alias("marked"))
    own = lines.withColumn("mark", F.regexp_replace("key", "#+", "#")).join(titles, ["document_id", "key"], "left").join(marks, ["document_id", "mark"], "left")
    water = F.col("marked") & T.is_watermark(T.compact(F.col("line")))
    title = F.when(F.col("edge") == "header", "recurring_header").when(F.col("edge") == "footer", "recurring_footer").otherwise("recurring_furniture")
    first = own.withColumn("reason", F.when(water, "watermark").when(F.col("title"), title))
    near = Window.partitionBy("document_id", "page").orderBy("line_no").rowsBetween(-2, 2)
    beside = F.max(F.col("reason").isNotNull().cast("int")).over(near) == 1
    dashed = F.col("edge").isNotNull() & F.col("line").rlike(r"(?i)^\s*[-–—•·*]|^\s*page\s+\d")
    ornament = F.col("reason").isNull() & T.is_page_ornament(F.col("line")) & (beside | dashed)
    return first.withColumn("reason", F.when(ornament, "page_ornament").otherwise(F.col("reason"))).select("document_id", "page", "line_no", "line", "key", "edge", "reason")


def overlaid_lines(marked: DataFrame) -> DataFrame:
    """(document_id, page, line_no, reason) of the lines that a second layer printed between two removed lines.

    The removed lines are at most OVERLAY_SPAN apart.  Page numbers between them go as page_ornament.  Lines of
    OVERLAY_LENGTH characters and two words or more go as duplicate_overlay if the page holds them outside the two; of
    copies that support each other the last one stays, since stretches are taken in page order.  A page is one row.
    """
    own = marked.select("document_id", "page", F.struct("line_no", T.compact(F.col("line")).alias("s"), F.col("reason").isNotNull().alias("gone")).alias("l"))
    page = own.groupBy("document_id", "page").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    fences = F.transform(F.filter("ls", lambda x: x["gone"]), lambda x: x["line_no"])
    page = page.withColumn("fences", fences)
    pairs = F.arrays_zip(F.slice("fences", F.lit(1), F.greatest(F.size("fences") - 1, F.lit(0))).alias("a"), F.slice("fences", F.lit(2), F.greatest(F.size("fences") - 1, F.lit(0))).alias("b"))
    page = page.where(F.size("fences") >= 2).select("document_id", "page", "ls", F.filter(pairs, lambda f: (f["b"] - f["a"] >= 2) & (f["b"] - f["a"] <= OVERLAY_SPAN)).alias("pairs")).where(F.size("pairs") > 0)

    def between(acc: Column, f: Column) -> Column:
        outside = F.filter("ls", lambda x: ((x["line_no"] < f["a"]) | (x["line_no"] > f["b"])) & ~x["gone"] & ~F.array_contains(acc, x["line_no"]))
        held = F.concat(F.lit(" "), F.array_join(F.transform(outside, lambda x: x["s"]), " "), F.lit(" "))
        said = lambda x: (F.length(x["s"]) >= OVERLAY_LENGTH) & F.contains(x["s"], F.lit(" ")) & F.contains(held, F.concat(F.lit(" "), x["s"], F.lit(" ")))
        found = F.filter("ls", lambda x: (x["line_no"] > f["a"]) & (x["line_no"] < f["b"]) & (T.is_page_ornament(x["s"]) | said(x)))
        return F.array_union(acc, F.transform(found, lambda x: x["line_no"]))

    gone = F.aggregate("pairs", F.array().cast("array<int>"), between)
    lines = page.select("document_id", "page", F.explode(F.filter("ls", lambda x: F.array_contains(gone, x["line_no"]))).alias("l"))
    reason = F.when(T.is_page_ornament(F.col("l.s")), "page_ornament").otherwise("duplicate_overlay")
    return lines.select("document_id", "page", "l.line_no", reason.alias("reason"))


def joined_paragraphs(text: Column) -> Column:
    """Lines joined to paragraphs: wrapped hyphens closed, single line ends to spaces, blank lines to one break."""
    lines = F.array_join(F.transform(F.split(text, r"\r?\n"), T.compact), "\n")
    closed = F.regexp_replace(lines, r"(?<=\p{L})-\n(?=\p{Ll})", "")
    flowed = F.regexp_replace(closed, r"(?<!\n)\n(?!\n)", " ")
    return F.regexp_replace(F.regexp_replace(flowed, r"\n{2,}", "\n\n"), r"^\s+|\s+$", "")


def clean_pages(pages: DataFrame, layers: bool = False) -> DataFrame:
    """(document_id, page, model_text, removed). A null or empty page has an empty model text.

    layers: lines that a second layer printed between removed lines go, too (overlaid_lines).
    """
    marked = marked_lines(pages.select("document_id", "page", F.coalesce("text", F.lit("")).alias("text")))
    if layers:
        over = overlaid_lines(marked).select("document_id", "page", "line_no", F.col("reason").alias("layer"))
        marked = marked.join(over, ["document_id", "page", "line_no"], "left").withColumn("reason", F.coalesce("reason", "layer"))
    kept = F.when(F.col("reason").isNull(), F.col("line")).otherwise("")
    grouped = marked.groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", kept.alias("kept")))).alias("ls"), F.count("reason").alias("removed"))
    return grouped.select("document_id", "page", joined_paragraphs(F.array_join(F.transform("ls", lambda x: x["kept"]), "\n")).alias("model_text"), "removed")

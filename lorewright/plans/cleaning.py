"""Furniture removal over pages that carry a running title, a page number and a purchaser's mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import cleaning
from lorewright.plans.base import PAGES, pages, registrar

QUERIES: dict = {}
register = registrar(QUERIES)


def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, foot = F.lit("The Adventure Guide\n"), F.concat(F.lit("\n- "), F.col("page").cast("string"), F.lit(" -\nPurchased by reader, order #"), F.col("document_id").cast("string"))
    return pages(spark, sf_dir).select("document_id", "page", F.concat(title, "text", foot).alias("text"))



@register(f"""WITH {PAGES}, n AS (SELECT document_id, count(*) AS n FROM pg GROUP BY 1), x AS (SELECT document_id, page, CASE WHEN n >= 2 THEN text ELSE 'The Adventure Guide' || chr(10) || text || chr(10) || '- ' || page || ' -' || chr(10) || 'Purchased by reader, order #' || document_id END AS t, n FROM pg JOIN n USING (document_id))
  SELECT document_id, page, CASE WHEN n >= 2 THEN 3 ELSE 1 END AS removed, length(regexp_replace(t, '\\s', '', 'g')) > 0 AS has_text FROM x""")
def furniture_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every page, and whether text is left."""
    got = cleaning.clean_pages(printed_pages(spark, sf_dir))
    return got.select("document_id", "page", "removed", (F.length("model_text") > 0).alias("has_text"))


@register(f"WITH {PAGES}, n AS (SELECT document_id, count(*) AS n FROM pg GROUP BY 1) SELECT reason, count(*) AS lines FROM (SELECT unnest(CASE WHEN n >= 2 THEN ['recurring_header', 'page_ornament', 'watermark'] ELSE ['page_ornament'] END) AS reason FROM pg JOIN n USING (document_id)) GROUP BY reason")
def removal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.marked_lines(printed_pages(spark, sf_dir)).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))

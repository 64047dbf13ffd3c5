"""Points in ranges of (page, offset), in lexicographic order.

A range is cut at the bounds of buckets of pages: whole buckets inside it hold all their points, and only the points of its
first and last buckets are compared with its ends.  Points meet ranges by document and bucket, so no point is compared with
a range that does not touch its bucket; the bucket's width follows from the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], pages: int | None = None) -> DataFrame:
    """points (keys, page, start, ...) with the columns of each of ranges (keys, page, start, to_page, to_start, ...) that holds them.

    A range holds what stands from (page, start) on and before (to_page, to_start); one that ends where it starts or before
    holds nothing, and so do null bounds.  Names other than keys, page and start must differ.  pages: pages of a bucket; if
    not given, a range is cut in about eight on average.  Repeated points and ranges meet each time.
    """
    order = lambda page, start: F.struct(F.col(page).cast("long"), F.col(start).cast("long"))
    whole = ranges.where(" AND ".join(f"{c} IS NOT NULL" for c in ("page", "start", "to_page", "to_start")))
    whole = whole.where(order("page", "start") < order("to_page", "to_start"))
    if pages is None:
        mean = whole.agg(F.avg(F.col("to_page") - F.col("page"))).first()[0] or 0.0
        pages = max(1, round(mean / 8))
    bucket = lambda page: F.floor(F.col(page) / pages)
    named = whole.withColumnRenamed("page", "__page").withColumnRenamed("start", "__start")
    cut = named.withColumn("__bucket", F.explode(F.sequence(bucket("__page"), bucket("to_page"))))
    edge = (F.col("__bucket") == bucket("__page")) | (F.col("__bucket") == bucket("to_page"))
    at = order("page", "start")
    inside = ~edge | (at >= order("__page", "__start")) & (at < order("to_page", "to_start"))
    met = points.withColumn("__bucket", bucket("page")).join(cut, [*keys, "__bucket"])
    return met.where(inside).drop("__bucket", "__page", "__start")

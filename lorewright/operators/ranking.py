"""Ranks within groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.storage import materialize

#: Rows of a group up to which one task ranks it by a plain window.
HEAVY = 5_000_000


def rank_in_groups(df: DataFrame, group: str, order: list[Column], name: str = "rank", heavy: int = HEAVY, most: int | None = None) -> DataFrame:
    """df with each row's place (from 1) in its group by order, which must tell all rows apart.

    Groups are counted first (most: the rows of the largest, if the caller knows).  If all are light, a window ranks them.  Otherwise rows are dealt by ranges of
    (group, order), ranked within their range, and moved on by the rows of the group in the ranges before; a task
    then holds a range, never a group.  Both ways give the same ranks.  Null groups are one group.
    """
    if most is None:
        most = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= heavy:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    dealt = df.repartitionByRange(F.col(group), *order).withColumn("__range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    sizes = dealt.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__group").orderBy("__r")) - F.col("__n")  # a row per group and range
    offsets = materialize(sizes.select("__group", "__r", before.alias("__before")), "offsets")
    local = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order))
    ranked = dealt.withColumn("__local", local).join(offsets, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__r")))
    return ranked.withColumn(name, (F.col("__before") + F.col("__local")).cast("int")).drop("__range", "__group", "__r", "__before", "__local")


def running_sum(df: DataFrame, group: str, order: list[Column], value: str, name: str, heavy: int = HEAVY) -> DataFrame:
    """df with the sum of value over the rows before each in its group by order, which must tell all rows apart.

    As in rank_in_groups a task holds a range of a large group, never the group.  Null groups are one group.
    """
    most = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if most <= heavy:
        return df.withColumn(name, before(Window.partitionBy(group).orderBy(*order)))
    dealt = materialize(df.repartitionByRange(F.col(group), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__r")).agg(F.sum(value).alias("__sum"))
    along = Window.partitionBy("__group").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row per group and range
    offsets = materialize(sums.select("__group", "__r", F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__before")), "offsets")
    own = dealt.withColumn("__own", before(Window.partitionBy(group, "__range").orderBy(*order)))
    met = own.join(offsets, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__r")))
    return met.withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__group", "__r", "__before", "__own")

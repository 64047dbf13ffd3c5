"""Greedy bins in order, without a task that walks all items.

An item opens a bin if the bin before it is full.  Where the bin that an item would open ends depends on the next few items
alone, so every item's successor (the item that would open the next bin) is found where its neighbours meet.  Successors are a
forest of pointers: which items open bins follows from the first one by doubling pointers, in as many rounds as the logarithm
of the number of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.operators.ranking import HEAVY, rank_in_groups, running_sum
from lorewright.storage import materialize, release

#: Items that one task compares with their neighbours.
BLOCK = 8_192


def _successors(items: DataFrame, most: int, most_size: int, block: int) -> DataFrame:
    """pos, next: where the bin that an item opens ends.  items: pos (from 0), count (1 or more), size, solo."""
    home = F.floor(F.col("pos") / block)
    # a bin has most items at most, so the first ones of a block are also told to the block before
    near = items.withColumn("block", F.explode(F.array_distinct(F.array(home, F.greatest(F.lit(0), F.floor((F.col("pos") - most) / block))))))
    ahead = Window.partitionBy("block").orderBy("pos").rowsBetween(0, most)
    seen = near.withColumn("ahead", F.collect_list(F.struct("pos", "count", "size", F.coalesce("solo", F.lit("")).alias("solo"))).over(ahead)).where(F.col("block") == home)
    first = F.col("ahead")[0]
    start = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("full"), (first["pos"] - 1).alias("last"))

    def add(s: Column, x: Column) -> Column:
        count, size = s["count"] + x["count"], s["size"] + x["size"]
        fits = (s["last"] < first["pos"]) | (x["solo"] == first["solo"]) & (count <= most) & (size <= most_size)
        more = F.struct(count.cast("long").alias("count"), size.cast("long").alias("size"), F.lit(False).alias("full"), x["pos"].alias("last"))
        stop = F.struct(s["count"].alias("count"), s["size"].alias("size"), F.lit(True).alias("full"), s["last"].alias("last"))
        return F.when(~s["full"] & fits, more).otherwise(stop)

    return seen.select("pos", (F.aggregate("ahead", start, add)["last"] + 1).alias("next"))


def greedy_bins(items: DataFrame, order: list[Column], most: int, most_size: int, block: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """items (count: 1 or more, size, solo, ...) with their bin, from 1, in order, which must tell all items apart.

    A bin takes items while their counts are most together, their sizes most_size, and their solo is one (null: any item
    without solo).  An item over a bound has a bin of its own.  The result is that of walking the items in order.
    """
    block = max(block, most + 1)
    placed = rank_in_groups(items.withColumn("__all", F.lit(0)), "__all", order, "pos", heavy).withColumn("pos", F.col("pos").cast("long") - 1).drop("__all")
    placed = materialize(placed, "placed")
    jump = materialize(_successors(placed.select("pos", "count", "size", "solo"), most, most_size, block), "jumps")
    opens, n = materialize(placed.where("pos = 0").select("pos"), "opens"), placed.count()
    while True:
        further = opens.join(jump, "pos").where(F.col("next") < n).select(F.col("next").alias("pos"))
        new = materialize(opens.unionByName(further).distinct(), "opens")
        twice = jump.join(jump.select(F.col("pos").alias("next"), F.col("next").alias("then")), "next").select("pos", F.col("then").alias("next"))
        twice = materialize(twice, "jumps")
        release(opens, jump)
        opens, jump = new, twice
        if jump.isEmpty():  # every pointer has left at the end
            break
    flagged = placed.join(opens.withColumn("open", F.lit(1)), "pos", "left").withColumn("open", F.coalesce("open", F.lit(0))).withColumn("__all", F.lit(0))
    found = running_sum(flagged, "__all", [F.col("pos")], "open", "before", heavy)
    return found.withColumn("bin", F.col("before") + F.col("open")).drop("__all", "before", "open", "pos")

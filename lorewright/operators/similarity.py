"""Sets that overlap, found by their rarest items: a join of prefixes, never of all sets that share an item."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.storage import materialize


def overlapping_sets(members: DataFrame, least: int = 2, share: float = 0.75, tasks: int | None = None) -> DataFrame:
    """left_id, right_id, overlap of sets of members (id, item) that share least items and share of the smaller one's items.

    left_id < right_id.  Items are ordered from the rarest on.  Of n items a smaller set can miss n - t, where t is what it
    must share, so one of its first n - t + 1 items is in the other set: these prefixes meet the items of sets at least as
    large.  Where they first meet bounds what can still be shared, and pairs that fall short are out (positional bound);
    the others are counted exactly on the sets.  Repeated members count once, null ids and items are none.
    tasks: among how many members and pairs are dealt, so that a task's memory does not grow with them (None: as the session says).
    """
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    own = dealt(members.where("id IS NOT NULL AND item IS NOT NULL").select("id", "item"), "item").distinct()
    rarity = own.groupBy("item").agg(F.count(F.lit(1)).alias("sets"))
    of_set = Window.partitionBy("id")
    placed = dealt(own.join(rarity, "item"), "id").withColumn("n", F.count(F.lit(1)).over(of_set)).where(F.col("n") >= least)
    placed = placed.withColumn("place", F.row_number().over(of_set.orderBy("sets", "item"))).drop("sets")  # items of one set
    placed = materialize(placed, "placed")
    need = F.greatest(F.lit(least), F.ceil(F.col("n") * share - 1e-9))
    small = placed.withColumn("need", need).where(F.col("place") <= F.col("n") - F.col("need") + 1)
    small = small.select("item", F.col("id").alias("s"), F.col("n").alias("s_n"), F.col("place").alias("s_place"), "need")
    large = placed.select("item", F.col("id").alias("l"), F.col("n").alias("l_n"), F.col("place").alias("l_place"))
    met = dealt(small, "item").join(large, "item").where("s <> l AND (s_n < l_n OR s_n = l_n AND s < l)")
    # items before the first meeting are not shared, so what is left on both sides bounds the overlap
    first = dealt(met, "s", "l").groupBy("s", "l", "s_n", "l_n", "need").agg(F.min(F.struct("s_place", "l_place")).alias("p"))
    left = F.least(F.col("s_n") - F.col("p.s_place"), F.col("l_n") - F.col("p.l_place")) + 1
    pairs = materialize(first.where(left >= F.col("need")).select("s", "l", "need"), "candidates")
    sets = dealt(placed, "id").groupBy("id").agg(F.collect_list("item").alias("items"))
    both = dealt(pairs, "s").join(sets.select(F.col("id").alias("s"), F.col("items").alias("a")), "s").join(sets.select(F.col("id").alias("l"), F.col("items").alias("b")), "l")
    found = both.withColumn("overlap", F.size(F.array_intersect("a", "b"))).where(F.col("overlap") >= F.col("need"))
    return found.select(F.least("s", "l").alias("left_id"), F.greatest("s", "l").alias("right_id"), "overlap")

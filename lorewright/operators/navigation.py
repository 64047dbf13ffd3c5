"""Navigation of a containment forest: depth, root, pre-order places and sizes of subtrees, without paths.

Pointers are doubled: after k rounds a node has the sums over 2^k steps towards the root, or over what hangs less than 2^k
steps below it, so rounds grow with the logarithm of the depth and a round exchanges a row a node.  The descendants of a
node are the places after its own, as many as its subtree has nodes beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.operators.ranking import HEAVY, running_sum
from lorewright.storage import materialize, release

ROUNDS = 64


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """id, size of nodes (id, parent: null at roots): the nodes of a subtree, its top included."""
    state = materialize(nodes.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), "sizes")
    for _ in range(ROUNDS):
        linked = state.where("up IS NOT NULL")
        if linked.isEmpty():
            return state.select("id", "size")
        below = linked.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        above = linked.select(F.col("id").alias("up"), F.col("up").alias("next"))
        moved = linked.select("id", "up").join(above, "up").select("id", "next")
        new = state.join(below, "id", "left").join(moved, "id", "left")
        new = materialize(new.select("id", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        release(state)
        state = new
    raise RuntimeError("the forest has a cycle")


def sums_to_root(nodes: DataFrame, value: str) -> DataFrame:
    """id, root, depth, total of nodes (id, parent, value): the value summed from a node to its root, both included."""
    state = materialize(nodes.select("id", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.col(value).alias("total")), "roots")
    state = state.withColumns({"depth": F.col("up").isNotNull().cast("int"), "at": F.coalesce("up", "id")})
    for _ in range(ROUNDS):
        if state.where("up IS NOT NULL").isEmpty():
            return state.select("id", F.col("at").alias("root"), "depth", "total")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("at").alias("to"), F.col("depth").alias("d"), F.col("total").alias("t"))
        met = state.join(above, "up", "left")
        new = met.select(
            "id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("t", F.lit(0))).alias("total"),
            F.coalesce("to", "at").alias("at"),
        )
        state = materialize(new, "roots")
    raise RuntimeError("the forest has a cycle")


def navigation(locations: DataFrame, edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """id, parent, root, depth, place, size, children of every location (id, name).

    edges (child, parent) give a child one parent and have no cycle; parents that are no locations make a child a root.
    place is the pre-order number in the root's tree, from 0, children by name, then id; null names last.  The descendants
    of a node have the places from its own + 1 to its own + size - 1, in that order.
    """
    known = locations.select(F.col("id").alias("parent"))
    up = edges.select(F.col("child").alias("id"), "parent").join(known, "parent", "left_semi")
    nodes = materialize(locations.select("id", "name").join(up, "id", "left"), "nodes")
    sizes = materialize(subtree_sizes(nodes), "sizes")
    sized = nodes.join(sizes, "id")
    order = [F.asc_nulls_last("name"), F.col("id")]
    # a child stands one after its parent and after the subtrees of its elder siblings
    inner = running_sum(sized.where("parent IS NOT NULL"), "parent", order, "size", "elder", heavy).select("id", (F.col("elder") + 1).alias("step"))
    stepped = materialize(nodes.select("id", "parent").join(inner, "id", "left").withColumn("step", F.coalesce("step", F.lit(0).cast("long"))), "steps")
    placed = sums_to_root(stepped, "step")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return (
        nodes.select("id", "parent").join(placed, "id").join(sizes, "id").join(children, "id", "left")
        .select("id", "parent", "root", "depth", F.col("total").alias("place"), "size", F.coalesce("children", F.lit(0).cast("long")).alias("children"))
    )


def descendants(found: DataFrame, of: DataFrame) -> DataFrame:
    """id, node, place: the descendants of the nodes in of (id), in pre-order, from navigation's rows."""
    tops = of.select("id").join(found, "id").select(F.col("id").alias("top"), "root", F.col("place").alias("first"), F.col("size").alias("many"))
    met = found.join(tops, "root").where("place > first AND place < first + many")
    return met.select(F.col("top").alias("id"), F.col("id").alias("node"), (F.col("place") - F.col("first")).alias("place"))

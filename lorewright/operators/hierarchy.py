"""Containment trees: parent choice with conflicts, cycles, and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import normalize_name
from lorewright.storage import materialize, release

#: The least confidence of a parent, of a parent among rivals, and the lead it needs.
LEAST, LEAST_AMONG_RIVALS, LEAD = 0.7, 0.8, 0.15


def containment_candidates(relationships: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, diagnostics) of relationships (id, source_id, target_id, type, confidence); locations has id.

    "located in" points from child to parent, "contains" the other way.  Self containment and unknown parents are
    diagnosed; of several edges of a pair the strongest stays, the first by id of equals.
    """
    kind = normalize_name(F.col("type"))
    child = F.when(kind == "located in", F.col("source_id")).when(kind == "contains", F.col("target_id"))
    parent = F.when(kind == "located in", F.col("target_id")).when(kind == "contains", F.col("source_id"))
    known = locations.select(F.col("id").alias("l_id")).distinct()
    own = relationships.select("id", child.alias("child"), parent.alias("parent"), "confidence").where("child IS NOT NULL AND parent IS NOT NULL")
    own = own.join(known, F.col("child") == F.col("l_id"), "left_semi").join(known, F.col("parent") == F.col("l_id"), "left")
    rank = F.row_number().over(Window.partitionBy("child", "parent").orderBy(F.desc("confidence"), "id"))
    code = F.when(F.col("child") == F.col("parent"), "self_containment").when(F.col("l_id").isNull(), "missing_parent")
    marked = own.withColumn("code", code).withColumn("rank", rank)
    marked = marked.withColumn("code", F.coalesce("code", F.when(F.col("rank") > 1, "duplicate_parent")))
    return marked.where("code IS NULL").select("id", "child", "parent", "confidence"), marked.where("code IS NOT NULL").select("id", "child", "parent", "code")


def ancestors(edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, above) for all pairs joined by one edge (child, parent) or more; squared, so depth doubles a round."""
    closure = materialize(edges.select(F.col("child").alias("node"), F.col("parent").alias("above")).distinct(), "closure")
    size, depth = closure.count(), 1
    while depth < max_depth:
        step = closure.select(F.col("node").alias("s_node"), F.col("above").alias("s_above"))
        more = closure.join(step, F.col("above") == F.col("s_node")).select("node", F.col("s_above").alias("above"))
        closure = materialize(closure.union(more).distinct(), "closure")
        depth, before, size = 2 * depth, size, closure.count()
        if size == before:
            return closure
    raise RuntimeError(f"ancestry is deeper than {max_depth}")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) of the nodes that lie on cycles of edges (child, parent) with one parent a child; cycle: its least node.

    Pointers are doubled, so rounds grow with the logarithm of the depth and no pairs of a node and its ancestors are
    made.  A node whose pointer has left at a root drops out.  Once the pointers' targets are no fewer than a round before,
    they are the nodes on cycles.
    """
    first = edges.select(F.col("child").alias("node"), F.col("parent").alias("at"))
    hop = materialize(first, "hops")
    left = hop.select("at").distinct().count()
    while left:
        further = hop.join(hop.select(F.col("node").alias("b_node"), F.col("at").alias("b_at")), F.col("at") == F.col("b_node"))
        further = materialize(further.select("node", F.col("b_at").alias("at")), "hops")
        release(hop)
        hop, before = further, left
        left = hop.select("at").distinct().count()
        if left == before:
            break
    on = first.join(hop.select(F.col("at").alias("c_node")).distinct(), F.col("node") == F.col("c_node"), "left_semi")
    named = materialize(on.select("node", "at", F.least("node", "at").alias("cycle")), "cycles")
    release(hop)
    while True:  # the least of a stretch of the cycle, which doubles, too
        other = named.select(F.col("node").alias("b_node"), F.col("at").alias("b_at"), F.col("cycle").alias("b_cycle"))
        met = named.join(other, F.col("at") == F.col("b_node")).select("node", F.col("b_at").alias("at"), F.least("cycle", "b_cycle").alias("cycle"), (F.col("b_cycle") < F.col("cycle")).alias("moved"))
        met = materialize(met, "cycles")
        release(named)
        named = met.drop("moved")
        named._scratch = met._scratch
        if met.where("moved").isEmpty():
            return named.select("node", "cycle")


def choose_parents(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposed, diagnostics): at most one parent a child.

    A parent that another candidate of the child reaches over supported edges is less specific and goes.  The
    strongest of the rest must be supported, and among rivals lead clearly.
    """
    reach = ancestors(candidates.where(F.col("confidence") >= LEAST))
    other = candidates.select(F.col("child").alias("o_child"), F.col("parent").alias("o_parent"))
    less = candidates.join(other, (F.col("child") == F.col("o_child")) & (F.col("parent") != F.col("o_parent")))
    less = less.join(reach, (F.col("o_parent") == F.col("node")) & (F.col("parent") == F.col("above")), "left_semi").select(F.col("id").alias("less_id")).distinct()
    marked = candidates.join(less, F.col("id") == F.col("less_id"), "left")
    ranked = Window.partitionBy("child", F.col("less_id").isNull()).orderBy(F.desc("confidence"), "id")
    group = Window.partitionBy("child", F.col("less_id").isNull())
    marked = marked.select("*", F.row_number().over(ranked).alias("rank"), F.max("confidence").over(group).alias("best"), F.lead("confidence").over(ranked).alias("next"))
    marked = marked.withColumn("runner_up", F.max(F.when(F.col("rank") == 1, F.col("next"))).over(group))
    clear = F.col("runner_up").isNull() | (F.col("best") >= LEAST_AMONG_RIVALS) & (F.col("best") - F.col("runner_up") >= LEAD)
    code = (
        F.when(F.col("less_id").isNotNull(), "less_specific_parent").when(F.col("best") < LEAST, "low_confidence")
        .when(~clear, "ambiguous_parent").when(F.col("rank") > 1, "ambiguous_parent")
    )
    coded = marked.withColumn("code", code)
    return coded.where("code IS NULL").select("id", "child", "parent", "confidence"), coded.where("code IS NOT NULL").select("id", "child", "parent", "code")


def drop_cycles(proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, diagnostics): edges enter by confidence, then id, unless they close a cycle.

    Every child has one parent, so a cycle loses exactly its last edge in that order; edges off cycles all stay.
    """
    last = proposed.join(cycles(proposed), F.col("child") == F.col("node")).withColumn("r", F.row_number().over(Window.partitionBy("cycle").orderBy("confidence", F.desc("id")))).where("r = 1")
    gone = last.select("id", "child", "parent", F.lit("cycle").alias("code"))
    return proposed.join(gone.select("id"), "id", "left_anti"), gone


def location_tree(relationships: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges child-parent, diagnostics) of the whole containment rule."""
    candidates, first = containment_candidates(relationships, locations)
    proposed, second = choose_parents(materialize(candidates, "candidates"))
    selected, third = drop_cycles(materialize(proposed, "proposed"))
    return selected, first.unionByName(second).unionByName(third)

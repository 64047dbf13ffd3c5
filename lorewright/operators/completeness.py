"""Which segments to read again: entities with too few relationships, and a greedy weighted cover of where they occur.

Every step of the greedy choice is made for all documents at once: the open targets' weights are summed by segment, the best
segment of each document is taken, and the targets it holds are closed.  There are at most as many steps as a document may
have segments, and a step exchanges rows of open targets only, so documents of any number and size go through together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewright.storage import in_tasks, materialize, release

#: Bounds of a plan, and what the signals weigh.
TARGETS, SEGMENTS = 24, 12
ZERO, LOW, UNCOVERED, PER_UNCOVERED, CHARACTERS = 10_000, 3_000, 1_000, 20, 100


def targets(occurrences: DataFrame, relationships: DataFrame, most: int = TARGETS, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(targets, places): doc, entity, degree, signals, weight of entities worth another look; doc, entity, segment not covered yet.

    occurrences: doc, segment, entity; relationships: doc, segment, source, target.  Segments of one entity tell nothing.
    An entity needs a signal: zero_degree; repeated_low_degree (one relationship at most, two segments at least);
    uncovered_occurrences (two segments and half of all without a relationship of its).  Of a document the heaviest most
    entities are targets, the smaller entity first among equals.
    tasks: among how many rows are dealt, so that a task's memory does not grow with them (None: as the session says).
    """
    with in_tasks(occurrences.sparkSession, tasks):
        return _targets(occurrences, relationships, most)


def _targets(occurrences: DataFrame, relationships: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    held = occurrences.select("doc", "segment", "entity").distinct()
    useful = held.groupBy("doc", "segment").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    useful = materialize(held.join(useful, ["doc", "segment"], "left_semi"), "useful")
    ends = relationships.select("doc", "segment", F.explode(F.array("source", "target")).alias("entity"))
    degree = ends.groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("degree"))
    shown = ends.select("doc", "segment", "entity").distinct().withColumn("shown", F.lit(1))
    places = materialize(useful.join(shown, ["doc", "segment", "entity"], "left"), "places")
    own = places.groupBy("doc", "entity").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("shown").isNull()).alias("open"))
    own = own.join(degree, ["doc", "entity"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).where("open > 0")
    zero, low = F.col("degree") == 0, (F.col("degree") <= 1) & (F.col("all") >= 2)
    wide = (F.col("open") >= 2) & (F.col("open") / F.col("all") >= 0.5)
    signals = F.array_compact(F.array(F.when(zero, "zero_degree"), F.when(low, "repeated_low_degree"), F.when(wide, "uncovered_occurrences")))
    part = lambda cond, weight: F.when(cond, weight).otherwise(0)
    weight = part(zero, ZERO) + part(low, LOW) + part(wide, UNCOVERED) + F.col("open") * PER_UNCOVERED + F.col("all")
    marked = own.select("doc", "entity", "degree", signals.alias("signals"), weight.cast("long").alias("weight")).where(F.size("signals") > 0)
    best = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("weight"), "entity"))
    found = materialize(marked.withColumn("rank", best).where(F.col("rank") <= most).drop("rank"), "targets")
    return found, places.where("shown IS NULL").select("doc", "entity", "segment").join(found.select("doc", "entity"), ["doc", "entity"], "left_semi")


def cover(found: DataFrame, places: DataFrame, segments: DataFrame, most: int = SEGMENTS, tasks: int | None = None) -> DataFrame:
    """doc, segment, step, kind of the segments (doc, segment, characters) to read again, most of a document.

    A segment scores the weight of the open targets it holds, less a point for every CHARACTERS of it; the best one is taken
    (of equals the smaller), its targets are closed.  When all are closed, segments that score above zero with all targets
    fill up the rest.  tasks: as for targets().
    """
    with in_tasks(found.sparkSession, tasks):
        return _cover(found, places, segments, most)


def _cover(found: DataFrame, places: DataFrame, segments: DataFrame, most: int) -> DataFrame:
    long = segments.select("doc", "segment", (F.col("characters") / CHARACTERS).alias("cost"))
    held = materialize(places.join(found.select("doc", "entity", "weight"), ["doc", "entity"]).join(long, ["doc", "segment"]), "held")
    best = F.min(F.struct((-F.col("score")).alias("score"), "segment"))["segment"]
    open_, chosen = held, None
    for step in range(1, most + 1):
        scores = open_.groupBy("doc", "segment", "cost").agg((F.sum("weight") - F.col("cost")).alias("score"))
        taken = materialize(scores.groupBy("doc").agg(best.alias("segment")).withColumn("step", F.lit(step)), "taken")
        if taken.isEmpty():
            break
        chosen = taken if chosen is None else chosen.unionByName(taken)
        closed = open_.join(taken.select("doc", "segment"), ["doc", "segment"], "left_semi").select("doc", "entity").distinct()
        left = materialize(open_.join(closed, ["doc", "entity"], "left_anti"), "open")
        if open_ is not held:
            release(open_)
        open_ = left
    if chosen is None:
        return segments.limit(0).select("doc", "segment", F.lit(0).alias("step"), F.lit("").alias("kind"))
    chosen = materialize(chosen, "chosen")
    room = chosen.groupBy("doc").agg(F.max("step").alias("used"))
    rest = held.join(chosen.select("doc", "segment"), ["doc", "segment"], "left_anti").groupBy("doc", "segment", "cost").agg((F.sum("weight") - F.col("cost")).alias("score"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "segment"))
    more = rest.where("score > 0").withColumn("place", place).join(room, "doc").withColumn("step", F.col("used") + F.col("place")).where(F.col("step") <= most)
    cut = lambda df, kind: df.select("doc", "segment", "step", F.lit(kind).alias("kind"))
    return cut(chosen, "cover").unionByName(materialize(cut(more, "supplement"), "more"))

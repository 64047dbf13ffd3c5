"""Identity statements that wait for one another: alias components enabled to a fixpoint.

A statement says that a subject is also called something, and cites the subject under the name that its source uses.  It
counts once the source's name and the claimed name are known to be one: they are equal, they name the same entity, or
statements that already count connect them in a component that holds one entity at most.  Counting adds a link, which may
let others count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.operators.components import connected_components
from lorewright.storage import in_tasks, materialize, release


def _mapped(df: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """column replaced by the label that moved (node, component) gives it, where it gives one."""
    to = moved.select(F.col("node").alias(column), F.col("component").alias("__to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("__to", F.col(column))).drop("__to")


def _anchored(anchors: DataFrame) -> DataFrame:
    """(label, low, high): the least and greatest entity of a label."""
    return anchors.groupBy("label").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def enabled_statements(statements: DataFrame, anchors: DataFrame, max_rounds: int = 10_000, tasks: int | None = None) -> DataFrame:
    """statement, enabled_at (null: never) of statements (statement, kind, source_name, claimed_name, other_name).

    anchors (name, id) are names that name one entity.  kind is "alias", which links claimed_name and other_name once
    enabled, or anything else, which links nothing.  Names are normalised by the caller; null names are never one with any.

    Semi-naive: labels stand in the waiting statements themselves, a round links only what the round before has enabled,
    and only the labels that this moves are replaced.  Rounds are as many as the longest chain of statements that wait.
    No side of a join is brought to the driver, since every round would bring its own.  tasks: among how many rows are dealt
    (None: as the session says).
    """
    with in_tasks(statements.sparkSession, tasks, broadcast=False):
        return _enabled_statements(statements, anchors, max_rounds)


def _enabled_statements(statements: DataFrame, anchors: DataFrame, max_rounds: int) -> DataFrame:
    own = anchors.select("name", "id").distinct()
    single = own.groupBy("name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    source, claimed = (single.select(F.col("name").alias(f"{c}_name"), F.col("id").alias(f"{c}_id")) for c in ("source", "claimed"))
    first = statements.join(source, "source_name", "left").join(claimed, "claimed_name", "left")
    now = (F.col("source_name") == F.col("claimed_name")) | (F.col("source_id") == F.col("claimed_id"))
    first = materialize(first.withColumn("now", F.coalesce(now, F.lit(False))), "statements")
    done = [first.where("now").select("statement", F.lit(0).alias("enabled_at"))]
    fresh = first.where("now AND kind = 'alias'").select(F.col("claimed_name").alias("a"), F.col("other_name").alias("b"))
    waiting = first.where("NOT now").select("statement", "kind", F.col("source_name").alias("s"), F.col("claimed_name").alias("c"), F.col("other_name").alias("o"))
    labels = own.select(F.col("name").alias("label"), F.col("id").alias("low"), F.col("id").alias("high"))
    labels = materialize(_anchored(labels), "anchors")
    held: list[DataFrame] = []
    for round_ in range(1, max_rounds + 1):
        links = fresh.where("a <> b")
        if links.isEmpty():
            break
        moved = materialize(connected_components(links).where("node <> component"), "moved")
        labels_new = materialize(_anchored(_mapped(labels, "label", moved)), "anchors")
        placed = _mapped(_mapped(_mapped(waiting, "s", moved), "c", moved), "o", moved)
        at = placed.join(labels_new.select(F.col("label").alias("s"), "low", "high"), "s", "left")
        one = (F.col("s") == F.col("c")) & (F.col("low").isNull() | (F.col("low") == F.col("high")))
        marked = materialize(at.withColumn("now", F.coalesce(one, F.lit(False))).drop("low", "high"), "waiting")
        release(moved, labels, *held)
        labels, held = labels_new, []
        done.append(marked.where("now").select("statement", F.lit(round_).alias("enabled_at")))
        fresh = marked.where("now AND kind = 'alias'").select(F.col("c").alias("a"), F.col("o").alias("b"))
        waiting = marked.where("NOT now").drop("now")
    else:
        raise RuntimeError(f"statements did not settle in {max_rounds} rounds")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return statements.select("statement").join(found.hint("merge"), "statement", "left")


def enabled_components(statements: DataFrame, anchors: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(statements, names): enabled_statements, and name, component, entity, ambiguous of every name that is linked.

    entity is the one that a component holds; a component with several is ambiguous and has none.
    """
    with in_tasks(statements.sparkSession, tasks, broadcast=False):
        return _enabled_components(statements, anchors, tasks)


def _enabled_components(statements: DataFrame, anchors: DataFrame, tasks: int | None) -> tuple[DataFrame, DataFrame]:
    enabled = materialize(enabled_statements(statements, anchors, tasks=tasks), "enabled")
    links = statements.where("kind = 'alias'").join(enabled.where("enabled_at IS NOT NULL"), "statement", "left_semi")
    nodes = materialize(connected_components(links.select(F.col("claimed_name").alias("a"), F.col("other_name").alias("b"))), "components")
    held = nodes.join(anchors.select(F.col("name").alias("node"), "id").distinct(), "node").groupBy("component")
    held = materialize(held.agg(F.min("id").alias("low"), F.max("id").alias("high")), "held").hint("merge")
    names = nodes.join(held, "component", "left").select(
        F.col("node").alias("name"), "component", F.when(F.col("low") == F.col("high"), F.col("low")).alias("entity"),
        F.coalesce(F.col("low") < F.col("high"), F.lit(False)).alias("ambiguous"),
    )
    return enabled, names

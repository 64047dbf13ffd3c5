"""Connected components of an edge table, iterated over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.storage import materialize, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round points every node to the smallest label among its neighbours and then to its label's label
    (pointer jumping), so the rounds grow with the logarithm of the diameter.  Each round is written to the
    shared folder and replaces the one before.  Repeated edges, self-loops and null ends (ignored) are allowed; no edges give no rows.
    Only whether a label changed reaches the driver.
    """
    given = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "given")  # made once, used twice
    both = materialize(given.unionByName(given.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    release(given)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    written = labels
    for _ in range(max_rounds):
        # the smallest label of the neighbours
        near = (
            both.join(labels.withColumnRenamed("node", "n_node"), F.col("b") == F.col("n_node"))
            .groupBy(F.col("a").alias("m_node")).agg(F.min("label").alias("m_label"))
        )
        hooked = labels.join(near, F.col("node") == F.col("m_node")).select("node", "label", F.least("label", "m_label").alias("next"))
        # a root takes the smallest label that its members have found
        roots = hooked.groupBy(F.col("label").alias("r_node")).agg(F.min("next").alias("r_label"))
        joined = hooked.join(roots, F.col("label") == F.col("r_node"))
        moved = materialize(joined.select("node", "label", F.least("next", "r_label").alias("next")), "labels")
        jump = moved.select(F.col("node").alias("j_node"), F.col("next").alias("j_next"))
        onward = F.least("next", F.coalesce("j_next", "next"))
        new = materialize(moved.join(jump, F.col("next") == F.col("j_node"), "left").select("node", F.col("label").alias("old"), onward.alias("label")), "labels")
        settled = new.where("label <> old").isEmpty()
        release(moved, written)
        labels, written = new.select("node", "label"), new
        if settled:
            release(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

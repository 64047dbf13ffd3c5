"""Tables written in versions and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.plans.base import registrar, table
from lorewright.sources.snapshots import read_snapshot, replace_keys, write_snapshot
from lorewright.storage import scratch_path

QUERIES: dict = {}
register = registrar(QUERIES)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("document"), F.col("p_name").alias("name"), F.lit(1).alias("version"))


@register("SELECT p_partkey AS id, p_brand AS document, p_name AS name, 1 AS version FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50) UNION ALL SELECT p_partkey + 1000000, p_brand, upper(p_name), 2 FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)")
def replaced_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of documents (brands) that are read again stand for those read before; other documents' stay."""
    path = scratch_path(spark, "snapshot")
    own = _entities(spark, sf_dir)
    write_snapshot(own, path, "once")
    again = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_brand").alias("document")).distinct()
    rows = own.join(again, "document").select((F.col("id") + 1_000_000).alias("id"), "document", F.upper("name").alias("name"), F.lit(2).alias("version"))
    replace_keys(rows, path, ["document"])
    return read_snapshot(spark, path)


@register("SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS pass FROM events")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of two appended passes over the events."""
    path = scratch_path(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    click = F.coalesce(F.col("event_type") == "click", F.lit(False))
    write_snapshot(e.where(~click).withColumn("pass", F.lit(1)), path)
    write_snapshot(e.where(click).withColumn("pass", F.lit(2)), path)
    return read_snapshot(spark, path)

"""Durable artifacts: written once, read only when they are what the manifest says; JSON campaigns; append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAMPAIGN_SCHEMA = "title string, pages array<string>, expectedEntities array<string>, expectedRelationships array<array<string>>"


def read_campaign(spark: SparkSession, path: str) -> DataFrame:
    """(title, page, text) of a campaign in one JSON document; a broken document gives no pages."""
    raw = spark.read.schema(CAMPAIGN_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return raw.select("title", F.posexplode("pages").alias("page", "text")).withColumn("page", F.col("page") + 1)


def write_once(df: DataFrame, path: str) -> None:
    """Fails if the artifact exists."""
    df.write.mode("errorifexists").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def verified_files(spark: SparkSession, folder: str, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of a folder's files against manifest (name, bytes, sha256).

    A name that leaves the folder, or that the manifest has twice, is rejected whatever the file holds.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("f_name"), "length", F.sha2("content", 256).alias("hash"), "content")
    twice = manifest.groupBy(F.col("name").alias("d_name")).agg(F.count(F.lit(1)).alias("n"))
    joined = manifest.join(twice, F.col("name") == F.col("d_name")).join(files, F.col("name") == F.col("f_name"), "left")
    reason = (
        F.when(F.contains("name", F.lit("..")) | F.contains("name", F.lit("/")), "path leaves the folder").when(F.col("n") > 1, "named twice")
        .when(F.col("f_name").isNull(), "missing").when(F.col("length") != F.col("bytes"), "wrong length").when(F.col("hash") != F.col("sha256"), "wrong hash")
    )
    coded = joined.withColumn("reason", reason)
    return coded.where("reason IS NULL").select("name", "content"), coded.where("reason IS NOT NULL").select("name", "reason").distinct()

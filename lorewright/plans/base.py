"""Registration of queries with their reference SQL, and the driver tables read as domain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def registrar(into: dict[str, tuple[Query, str | None]]):
    """A decorator that files a query under its function name with its SQL (None where SQL cannot state it)."""

    def register(sql: str | None):
        def wrap(f: Query) -> Query:
            into[f.__name__] = (f, sql)
            return f

        return wrap

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of pages: document_id, page (from 1), text, role."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("page"), "text", "role"
    )


PAGES = "pg AS (SELECT conv_id AS document_id, turn + 1 AS page, text, role FROM conversations)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document: doc_id, line_no (from 0), line, n_lines."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("parts"))
    return parts.select("doc_id", F.size("parts").alias("n_lines"), F.posexplode("parts").alias("line_no", "line"))


LINES = (
    "ln AS (SELECT doc_id, len(parts) AS n_lines, unnest(range(len(parts))) AS line_no, unnest(parts) AS line "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as relationship candidates: ord, source_id, target_id, type, confidence, page, quantity."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"),
        F.concat_ws(" ", F.lit("Sold As"), "l_returnflag").alias("type"), F.round(F.lit(1.0) - F.col("l_discount"), 2).alias("confidence"),
        F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("quantity"),
    )


EDGES = (
    "ed AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_suppkey AS source_id, l_partkey AS target_id, 'Sold As ' || l_returnflag AS type, "
    "round(1.0 - l_discount, 2) AS confidence, l_orderkey AS page, l_quantity AS quantity FROM lineitem)"
)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities: id, name, type, brand, size, visible (every third is known to players)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"), (F.col("p_partkey") % 3 == 0).alias("visible"),
    )


PARTS = "pt AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand AS brand, p_size AS size, p_partkey % 3 = 0 AS visible FROM part)"


def rank_of(partition: list[str], order: list) -> Window:
    return Window.partitionBy(*partition).orderBy(*order)

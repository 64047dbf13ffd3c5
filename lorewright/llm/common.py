"""What the operators share: words, texts, row fingerprints and row-exact filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.storage import drop_scratch, materialize, release, scratch_path, shared_dir

__all__ = ["drop_scratch", "joined_few", "materialize", "release", "rows_kept", "row_print", "scratch_path", "shared_dir", "table", "text_or_empty", "word_count"]

#: The white space of every contract: \x20 and \x09 to \x0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_print(docs: DataFrame) -> Column:
    """A fingerprint of the whole row, to tell rows with one doc_id apart."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def rows_kept(docs: DataFrame, decisions: DataFrame, extra: list[str] = []) -> DataFrame:
    """The rows of docs that decisions (doc_id, row_print, each pair once) name; of identical rows one.

    The join and the window share one exchange by (doc_id, row_print).
    """
    keys = decisions.select(F.col("doc_id").alias("__id"), F.col("row_print").alias("__print"), *extra)
    marked = docs.withColumn("__row", row_print(docs))
    joined = marked.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__print")))
    first = F.row_number().over(Window.partitionBy("__row", "doc_id").orderBy("__row"))
    return joined.withColumn("__n", first).where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns], *extra)


#: Keys of joined_few that may be heavy; any other key has less than this part of the rows.  Keys of so few rows are light.
HEAVY_KEYS, HEAVY_ROWS = 1_000, 100


def joined_few(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """rows joined with found, which has a row per key at most, where a key may hold any share of rows.

    Keys are counted first.  The thousand most frequent ones get their rows of found by a broadcast of a thousand rows at
    most, so that none of them is exchanged to one task; any other key has a thousandth of the rows at most, and these
    join as Spark finds best.  Null keys meet nothing.  found is read twice.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > heavy_rows)
    most = counts.orderBy(F.desc("__n"), *keys).select(*keys).limit(HEAVY_KEYS).collect()  # a thousand keys at most
    if not most:
        return rows.join(found, keys, how)
    named = [F.struct(*[F.lit(r[k]).cast(f.dataType).alias(k) for k, f in zip(keys, counts.select(*keys).schema, strict=True)]) for r in most]
    heavy = F.broadcast(rows.sparkSession.range(1).select(F.inline(F.array(*named))))
    light = rows.join(heavy, keys, "left_anti").join(found, keys, how)
    few = F.broadcast(found.join(heavy, keys, "left_semi"))
    return light.unionByName(rows.join(heavy, keys, "left_semi").join(few, keys, how))

"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only.

Every text is normalised (white space deleted) and hashed to a 64-bit key.  The directory looks at the leading bits:
buckets over capacity are split by one more bit (directory doubling) until each fits or holds a single key, which no
further bit can split.  A bucket's page lists its keys with the size of their group and the row that stays.  Rows are
routed through the directory's slots and written with the address of their page; address and key together name their entry.
A slot or an entry that more than a thousandth of the rows ask for is brought to them, so no task gets the rows of one group.

That a key stands for one text is proved by bytes: copies are combined under (key, normalised bytes) before the
exchange, so a group with a third of all rows sends one row a task, and a key with two byte strings is a collision.
Entries of such a key are chained by their bytes, and its rows follow the chain by comparing bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm.common import WHITE_SPACE, joined_few, materialize, row_print, rows_kept, table, text_or_empty

CAPACITY = 65_536


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE_SPACE, "")


def _slot(key: Column, depth: int) -> Column:
    """The leading depth bits of a key."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(local_depth, slot, entries, single) of every bucket after doubling; keys has one column, key.

    A level counts entries by slot only, so a task sends a row per slot.  Level after level the buckets that
    fit settle; doubling stops when none is overfull with more than one key.
    """
    total, depth, settled, rest = keys.count(), 0, None, keys
    while total > capacity << depth and depth < 63:
        depth += 1
    while True:
        level = materialize(
            rest.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(
                F.count(F.lit(1)).alias("entries"), F.min("key").alias("low"), F.max("key").alias("high")
            ),
            "directory",
        ).withColumn("single", F.col("low") == F.col("high"))
        done = (F.col("entries") <= capacity) | F.col("single") | F.lit(depth == 64)
        pages = level.where(done).select(F.lit(depth).alias("local_depth"), "slot", "entries", "single")
        settled = pages if settled is None else settled.unionByName(pages)
        over = level.where(~done).select(F.col("slot").alias("__over"))
        if over.isEmpty():
            return settled
        rest = rest.join(over, _slot(F.col("key"), depth) == F.col("__over"), "left_semi")
        depth += 1


def routed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (with key) with their bucket (local_depth, slot): the directory has exactly one for every key in it."""
    depths = sorted(r["local_depth"] for r in buckets.select("local_depth").distinct().collect())  # 1 to 3 in practice, 64 at most
    if not depths:
        return rows.limit(0).withColumns({"local_depth": F.lit(0), "slot": F.lit(0).cast("long")})
    slot = F.when(F.col("local_depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(key, 64 - local_depth)"))
    asked = rows.withColumn("local_depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("slot", slot)
    return joined_few(asked, buckets.select("local_depth", "slot"), ["local_depth", "slot"]).select(*rows.columns, "local_depth", "slot")


def _page(entries: DataFrame, by: list[str]) -> DataFrame:
    """An entry of a page for each group of by: its size, the row that stays and that row's fingerprint."""
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row_print").alias("print")))
    return entries.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).select(
        *by, "group_size", F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.print").alias("keep_print")
    )


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_of: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain, row_print.

    Of equal normalised texts the row with most code points stays, then the smallest doc_id (null last), then
    the smallest row fingerprint; of wholly identical rows one is marked kept.  Null texts count as empty and
    form one group with texts of white space only.  Very long texts are compared whole; only one of a task's copies
    travels.  An empty table gives no rows.  Of docs doc_id and text are read, and all columns for the fingerprint.
    """
    base = docs.select(F.col("doc_id"), row_print(docs).alias("row_print"), text_or_empty().alias("t"))
    base = base.select("doc_id", "row_print", F.length("t").alias("points"), normalised(F.col("t")).alias("norm"))
    keyed = base.withColumn("key", key_of("norm").cast("long"))
    rows = keyed.select("doc_id", "row_print", "points", "key", F.sha2("norm", 256).alias("text_sha256"))
    entries = materialize(rows, "entries")
    texts = keyed.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    keys = materialize(texts, "keys")
    buckets = materialize(directory(keys.select("key"), capacity), "buckets")
    collided = keys.where("texts > 1").select("key")
    single = routed(keys.where("texts = 1").select("key"), buckets)
    pages = materialize(single.join(_page(entries, ["key"]), "key").withColumn("chain", F.lit(1)), "index")
    at = ["local_depth", "slot", "key"]
    placed = materialize(routed(entries, buckets), "placed")
    found = joined_few(placed, pages, at)
    if not collided.isEmpty():
        chained = keyed.join(collided, "key", "left_semi")
        chain = F.row_number().over(Window.partitionBy("key").orderBy("norm"))
        chains = routed(_page(chained, ["key", "norm"]).withColumn("chain", chain), buckets)
        chained = routed(chained.withColumn("text_sha256", F.sha2("norm", 256)), buckets)
        found = found.unionByName(chained.join(chains, [*at, "norm"]).drop("norm"))
    best_row = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_print") == F.col("keep_print"))
    n = F.row_number().over(Window.partitionBy("doc_id", "row_print").orderBy("key"))
    return found.withColumn("n", n).select(
        "doc_id", "keep_id", "group_size", (best_row & (F.col("n") == 1)).alias("kept"), "text_sha256",
        F.concat_ws(":", "local_depth", F.hex("slot")).alias("bucket"), "chain", "row_print",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without exact copies, all columns, whatever their names; ties, nulls and repeated rows as in exact_dedup."""
    return rows_kept(docs, exact_dedup(docs).where("kept").select("doc_id", "row_print"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) points,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm FROM documents),
r AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) group_size,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) keep_id,
  row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) pos FROM n)
SELECT doc_id, keep_id, group_size, pos = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

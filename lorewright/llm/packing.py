"""Packing into optimal length buckets.

The global histogram of lengths has a row per distinct length (D of them need D * (D + 1) / 2 tokens at least, so
it grows slower than the square root of the corpus; a million distinct lengths take the driver
about 23 seconds and 0.5 GB).  Dynamic programming over it chooses the bucket bounds with
the least padding, exactly: padding is a sum of lines in the bound's length, so a lower envelope gives each layer
in one pass.  Inside a bucket, batches take as many documents as the token budget holds at the bucket's length.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm.common import materialize, row_print, table, text_or_empty, word_count

BUCKETS, BUDGET = 16, 16_384
SLICES, SLICE_ROWS = 64, 2_000_000


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds (lengths that occur, the last the greatest) of at most that many buckets with least padding.

    histogram: (length, count) ascending.  Of equal plans the one with the fewest buckets.
    """
    lengths = [x for x, _ in histogram]
    rows, tokens = [0], [0]
    for x, n in histogram:
        rows.append(rows[-1] + n)
        tokens.append(tokens[-1] + x * n)
    size = len(lengths)
    best = [0] + [None] * size  # best[j]: padding of the first j lengths with the layer's number of buckets
    back: list[array] = []  # 8 bytes a length and bucket
    answer = None
    for k in range(1, min(buckets, size) + 1):
        now, prev = [None] * (size + 1), array("q", bytes(8 * (size + 1)))
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i), slopes falling
        head = 0
        for j in range(1, size + 1):
            i = j - 1
            if best[i] is not None:
                m, c = -rows[i], best[i] + tokens[i]
                while len(hull) - head >= 2:
                    (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                    if (c - c1) * (m1 - m2) <= (c2 - c1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append((m, c, i))
            if len(hull) == head:
                continue
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            m, c, i = hull[head]
            now[j], prev[j] = m * x + c + x * rows[j] - tokens[j], i
        back.append(prev)
        best = now
        if now[size] is not None and (answer is None or now[size] < answer[0]):
            answer = (now[size], k)
    bounds, j = [], size
    for prev in reversed(back[: answer[1]] if answer else []):
        bounds.append(lengths[j - 1])
        j = prev[j]
    return bounds[::-1]


def token_length(text: Column) -> Column:
    """Words and one end of text."""
    return word_count(text) + 1


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, bucket, bucket_length, batch_id, position, batch_rows, padding.

    Length is words plus one, 1 for null and empty texts.  A batch holds at most budget tokens at its bucket's
    length; a document longer than the budget is a batch of its own, whole.  Batches of a bucket are full but for
    the last; batch ids are gapless over all buckets.  Documents go to batches by a hash of their rows; repeated
    rows are packed each, ties of the hash go by doc_id.  Very long texts are counted whole.  An empty table gives no
    rows.  Columns other than doc_id and text only enter the hash.
    """
    slim = docs.select("doc_id", F.xxhash64("doc_id", row_print(docs)).alias("hash"), token_length(text_or_empty()).alias("n_tokens"))
    rows = materialize(slim, "lengths")
    histogram = sorted((r.n_tokens, r.n) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = optimal_bounds(histogram, buckets) or [1]
    slices = max(SLICES, sum(n for _, n in histogram) // SLICE_ROWS)
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("n_tokens"))).cast("int")
    held, at = [0] * len(bounds), 0
    for x, n in histogram:
        while x > bounds[at]:
            at += 1
        held[at] += n
    room = [max(1, budget // b) for b in bounds]
    first = [sum(-(-held[j] // room[j]) for j in range(i)) for i in range(len(bounds))]

    def of(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)

    sliced = rows.withColumn("bucket", bucket).withColumn("slice", F.pmod("hash", F.lit(slices)))
    counts = sliced.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.select("bucket", "slice", before.alias("before")), "offsets")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("hash", "doc_id")) - 1
    ranked = sliced.join(offsets, ["bucket", "slice"]).withColumn("rank", rank)
    batch = F.floor(F.col("rank") / of(room)).cast("long")
    return ranked.select(
        "doc_id", "n_tokens", "bucket", of(bounds).alias("bucket_length"), (of(first) + batch).alias("batch_id"),
        (F.col("rank") - batch * of(room)).cast("int").alias("position"),
        F.least(of(room), of(held) - batch * of(room)).cast("int").alias("batch_rows"), (of(bounds) - F.col("n_tokens")).alias("padding"),
    )


def op3_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))

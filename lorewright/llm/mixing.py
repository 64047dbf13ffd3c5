"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Of all rates 0 <= r <= max_repeat of a source's documents that meet its token constraint, sum(r * size) = target, entropy
balancing takes those nearest to 1 in relative entropy, sum(r * ln r - r + 1).  The convex dual has one multiplier a
source, and the rates are the exponential tilt min(max_repeat, exp(b * size / mean)): a source that shall give more
than it has repeats its long documents first, one that shall give less drops them first.  Newton's method, kept
inside a bracket, solves all sources at once: an iteration is one aggregation over the (source, size) histogram, whose
rows are bounded by the distinct lengths.  The rates then become whole copies: cumulative rounding along sizes, then
corrections that close what is left of the token target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm.common import materialize, release, row_print, rows_kept, table, text_or_empty, word_count
from lorewright.operators.ranking import rank_in_groups

WEIGHTS, MAX_REPEAT, TOLERANCE = (5.0, 2.0, 1.0), 3, 1e-9
#: Rounds after which a loop is taken to be stuck and raises.
ROUNDS, CORRECTIONS, LEVELS = 200, 1_000, 1_000
#: Ranks within a (source, size) are made in at least so many slices; more for more rows.
SLICES, SLICE_ROWS = 64, 2_000_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(src, source_size, target) from (src, source, source_size), a row per source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes by weight; none
    gets over max_repeat times its size, and the others share the excess.  The common level (words a weight) rises until
    no further source exceeds its limit; a round is one aggregation, and ranks are made by ranges where sources are many.
    """
    order = [F.col("source").isNull(), F.col("source"), F.col("src")]
    ranked = rank_in_groups(sizes.withColumn("all", F.lit(0)), "all", order, "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    base = ranked.select("src", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_repeat))).alias("limit"))
    base = materialize(base, "sources")
    level, free = 0.0, -1
    for _ in range(LEVELS):
        held = F.col("limit") < F.lit(level) * F.col("weight")
        got = base.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(held, F.col("limit"))).alias("held"),
            F.sum(F.when(~held, F.col("weight"))).alias("weight"), F.count_if(~held).alias("free"),
        ).first()
        if not got.free or got.free == free:
            break
        free, level = got.free, (got.total - (got.held or 0.0)) / got.weight
    else:
        raise RuntimeError(f"targets did not settle in {LEVELS} rounds")
    return base.select("src", "source_size", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def tilted_rates(cells: DataFrame, targets: DataFrame, max_repeat: int = MAX_REPEAT, tolerance: float = TOLERANCE) -> DataFrame:
    """(src, b, mean) with rates min(max_repeat, exp(b * size / mean)); cells is (src, size > 0, n).

    The words that a multiplier takes rise with it, so a bracket (low, high) holds the solution: at high every rate is
    max_repeat.  A Newton step that would leave the bracket halves it instead.
    """
    start = cells.groupBy("src").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    most, share = F.lit(math.log(max_repeat)), F.col("target") / F.col("source_size")
    state = materialize(
        start.join(targets, "src").where("target > 0").select(
            "src", "mean", (F.col("target") / F.col("mean")).alias("want"), F.log(share).alias("b"),
            F.lit(None).cast("double").alias("low"), (most * F.col("mean") / F.col("least")).alias("high"),
        ),
        "dual",
    )
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("mean")
        inside = F.col("b") * x < most
        taken = F.col("n") * x * F.when(inside, F.exp(F.least(F.col("b") * x, most))).otherwise(float(max_repeat))
        moments = cells.join(state, "src").groupBy("src", "mean", "want", "b", "low", "high").agg(
            F.sum(taken).alias("words"), F.sum(F.when(inside, taken * x).otherwise(0.0)).alias("slope")
        )
        over = F.col("words") - F.col("want")
        low = F.when(over < 0, F.col("b")).otherwise(F.col("low"))
        high = F.when(over > 0, F.least("b", "high")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("b") - over / F.col("slope"))
        moved = moments.select("src", "mean", "want", (F.abs(over) / F.col("want")).alias("gap"), "b", low.alias("low"), high.alias("high"), newton.alias("newton"))
        half = F.coalesce((F.col("low") + F.col("high")) / 2, F.least(F.col("high"), F.lit(0.0)) * 2 - 1)  # no low yet: further down
        good = F.col("newton").isNotNull() & (F.col("newton") <= F.col("high")) & (F.col("low").isNull() | (F.col("newton") > F.col("low"))) & (F.abs(F.col("newton")) < 1e6 * F.abs("high"))
        settled = (F.col("gap") <= tolerance) | (F.col("high") - F.col("low") <= F.lit(1e-15) * F.abs("high"))
        b = F.when(settled, F.col("b")).when(good, F.col("newton")).otherwise(half)
        new = materialize(moved.select("src", "mean", "want", b.alias("b"), "low", "high", settled.alias("settled")), "dual")
        release(state)
        state = new
        if state.where(~F.coalesce("settled", F.lit(False))).isEmpty():
            return state.select("src", "b", "mean")
        state = state.drop("settled")
        state._scratch = new._scratch
    raise RuntimeError(f"rates did not settle in {ROUNDS} rounds")


def whole_copies(cells: DataFrame, rates: DataFrame, targets: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(src, size, n, copies): copies for all n documents of a cell together, 0 to max_repeat * n."""
    limit = F.col("n") * F.lit(max_repeat)
    # the rates are rounded, so that sums in another order give the same copies
    rate = F.round(F.least(F.lit(float(max_repeat)), F.exp(F.least(F.lit(50.0), F.col("b") * F.col("size") / F.col("mean")))), 6)
    along = Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.floor(F.sum(F.round(F.col("rate") * F.col("n"), 6)).over(along) + F.lit(0.5))
    placed = cells.join(rates, "src").withColumn("rate", rate).withColumn("upto", upto)
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("src").orderBy(F.desc("size"))), F.lit(0))
    copies = F.greatest(F.lit(0), F.least(limit, F.col("upto") - before)).cast("long")
    state = materialize(placed.select("src", "size", "n", copies.alias("copies")), "copies")
    for _ in range(CORRECTIONS):
        taken = state.groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        miss = taken.join(targets, "src").select("src", F.round(F.col("target") - F.col("taken")).cast("long").alias("miss"))
        room = F.when(F.col("miss") > 0, limit - F.col("copies")).otherwise(F.col("copies"))
        # a size up to twice what is missing brings the words nearer
        k = F.least(room, F.greatest(F.lit(1).cast("long"), F.floor(F.abs("miss") / F.col("size")).cast("long")))
        open_ = state.join(miss, "src").where((F.col("miss") != 0) & (room > 0) & (F.col("size") < 2 * F.abs("miss")))
        fit = F.struct((F.col("size") <= F.abs("miss")).alias("whole"), F.when(F.col("size") <= F.abs("miss"), F.col("size")).otherwise(-F.col("size")).alias("rank"), "size", (k * F.signum("miss").cast("long")).alias("add"))
        change = materialize(open_.groupBy("src").agg(F.max(fit).alias("fit")).select("src", "fit.size", "fit.add"), "change")
        if change.isEmpty():
            return state
        before = state
        state = materialize(
            state.join(change, ["src", "size"], "left").select("src", "size", "n", (F.col("copies") + F.coalesce("add", F.lit(0))).cast("long").alias("copies")), "copies"
        )
        release(before, change)
    raise RuntimeError(f"copies did not settle in {CORRECTIONS} rounds")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken, row_print, rate.

    Size is the number of words; a document without words (null texts too) has rate 1 and takes 0 words.  A null
    source is a source of its own.  taken = copies * size <= max_repeat * size.  Reruns agree: documents of a
    cell are told apart by hashes of their rows; wholly identical rows may swap their equal results.  Very long texts are
    counted whole.  An empty table gives no rows.  Columns other than doc_id, text and source only enter the fingerprint.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    slim = docs.select("doc_id", row_print(docs).alias("row_print"), F.col("source").cast("string").alias("source"), key.alias("src"), word_count(text_or_empty()).alias("size"))
    rows = materialize(slim, "sizes")
    slices = max(SLICES, rows.count() // SLICE_ROWS)
    cells = materialize(rows.groupBy("src", "source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = cells.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, max_repeat), "targets")
    worded = cells.where("size > 0").select("src", "size", "n")
    rates = tilted_rates(worded, targets, max_repeat)
    copies = whole_copies(worded, rates, targets, max_repeat)
    known = cells.select("src", "size", "n").join(copies.select("src", "size", "copies"), ["src", "size"], "left").join(targets, "src")
    rate = F.least(F.lit(float(max_repeat)), F.exp(F.least(F.lit(50.0), F.col("b") * F.col("size") / F.col("mean"))))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.coalesce(rate, F.lit(0.0)))
    known = known.join(rates, "src", "left").select("src", "size", "n", "source_size", "target", rate.alias("rate"), F.when(F.col("size") == 0, F.col("n")).otherwise(F.coalesce("copies", F.lit(0))).alias("copies"))
    # the documents of a cell in hash order: ranks within slices, after the rows of the slices before
    sliced = rows.withColumn("hash", F.xxhash64("doc_id", "row_print")).withColumn("slice", F.pmod("hash", F.lit(slices)))
    counts = sliced.groupBy("src", "size", "slice").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("src", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("rows").join(known, ["src", "size"]), "offsets")
    at = F.col("before") + F.row_number().over(Window.partitionBy("src", "size", "slice").orderBy("hash", "doc_id")) - 1
    own = F.floor(F.col("copies") / F.col("n")) + F.when(at < F.col("copies") % F.col("n"), 1).otherwise(0)
    found = sliced.join(offsets, ["src", "size", "slice"]).withColumn("own", own.cast("long"))
    return found.select("doc_id", "size", "source_size", "target", F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken"), "row_print", "rate")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as the mix takes it, all columns, whatever their names; wholly identical rows count together."""
    plan = mix(docs, **how).groupBy("doc_id", "row_print").agg(F.sum("copies").alias("__copies")).where("__copies > 0")
    once = rows_kept(docs, plan, ["__copies"])
    again: Column = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return once.withColumn("__copy", again).drop("__copy", "__copies")


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")

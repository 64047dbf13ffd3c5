import random

import pytest
from pyspark.sql import functions as F

from lorewright.operators.bins import greedy_bins


def walk(rows, most, most_size):
    out, bin_, count, size, solo = {}, 0, 0, 0, None
    for k, c, s, so in sorted(rows):
        if not bin_ or so != solo or count + c > most or size + s > most_size:
            bin_, count, size, solo = bin_ + 1, 0, 0, so
        count, size = count + c, size + s
        out[k] = bin_
    return out


@pytest.mark.parametrize(("block", "heavy"), [(8, 10), (1_000, 1_000)])
def test_bins_equal_a_walk(spark, block, heavy):
    rng = random.Random(block)
    rows, solo = [], None
    for k in range(150):
        solo = rng.choice([None, solo, f"s{k % 4}"]) if rng.random() < 0.3 else solo
        rows.append((k * 3, rng.choice([1, 1, 2, 7]), rng.choice([0, 10, 30, 120]), solo))
    df = spark.createDataFrame(rows, "k long, count long, size long, solo string")
    got = {r.k: r.bin for r in greedy_bins(df, [F.col("k")], 6, 100, block, heavy).collect()}
    assert got == walk(rows, 6, 100)
    assert greedy_bins(df.where("false"), [F.col("k")], 6, 100).count() == 0


def test_a_bin_is_full_of_ones_and_one_item_is_too_large(spark):
    rows = [(k, 1, 1, None) for k in range(50)] + [(50, 99, 1, None), (51, 1, 999, None), (52, 1, 1, None)]
    df = spark.createDataFrame(rows, "k long, count long, size long, solo string")
    assert {r.k: r.bin for r in greedy_bins(df, [F.col("k")], 24, 100, 16).collect()} == walk(rows, 24, 100)

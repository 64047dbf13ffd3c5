import zlib

import numpy as np
from pyspark.sql import functions as F

from lorewright.llm import sharding


def check(rows, shards, spark, slack_rows=1.0):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, key long")
    got = sharding.shard_by_bytes(docs, shards).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    sizes = np.zeros(shards, np.int64)
    slots = {}
    for r in got:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max((r["size"] for r in got), default=0)
    assert abs(sizes - sizes.mean()).max() <= slack_rows * largest + 0.01 * sizes.mean() + 1
    return got


def test_even_bytes_with_skew_copies_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.pareto(1.5) * 50), "s", i) for i in range(3000)]
    rows += [(10_000 + i, "a hot copy " * 5, None, None) for i in range(1500)] + [(None, None, None, 1), (5, None, None, 1), (6, "", "q", None)]
    check(rows, 8, spark)


def test_probing_down_to_single_keys(spark, monkeypatch):
    rows = [(i, f"text {i}" * (1 + i % 7), "s", i) for i in range(400)]
    monkeypatch.setattr(sharding, "EXACT_ROWS", 0)
    sized = sharding.sized_rows(spark.createDataFrame(rows, "doc_id long, text string, shard string, key long")).cache()
    got = sharding.splitters(sized, 8, tolerance=0.0, exact_rows=0)
    keys = sorted((r.key, r["size"]) for r in sized.collect())
    total = sum(s for _, s in keys)
    for i, cut in enumerate(got, 1):
        below = sum(s for k, s in keys if k < cut)
        assert abs(below - total * i / 8) <= max(s for _, s in keys)


def test_copies_share_a_shard_when_light(spark):
    rows = [(i, f"text {i % 200} " * 20, "s", i) for i in range(4000)]
    got = check(rows, 4, spark, slack_rows=30)
    by = {}
    for r in got:
        by.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) <= 3


def test_empty_and_tiny(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r.shard in range(40), r.slot) for r in sharding.shard_by_bytes(docs).collect()] == [(True, 0)]
    assert sharding.shard_by_bytes(docs.where(F.lit(False))).count() == 0

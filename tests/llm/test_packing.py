import itertools
import random

from pyspark.sql import functions as F

from lorewright.llm import packing


def padding(histogram, bounds):
    return sum((min(b for b in bounds if b >= x) - x) * n for x, n in histogram)


def test_bounds_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        histogram = sorted({rng.randint(1, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}.items())
        lengths = [x for x, _ in histogram]
        for k in (1, 2, 3, 5):
            best = min(padding(histogram, [*c, lengths[-1]]) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
            got = packing.optimal_bounds(histogram, k)
            assert len(got) <= k and padding(histogram, got) == best
    assert packing.optimal_bounds([], 4) == []


def test_batches_hold_every_row_once_and_keep_the_budget(spark):
    rng = random.Random(2)
    data = [(i, "w " * int(rng.paretovariate(1.1) * 5), "x") for i in range(2000)]
    data += [(5000 + i, "hot copy", None) for i in range(1500)] + [(None, None, None), (1, "", None), (9, "t " * 900, "z"), (9, "t " * 900, "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, bucket string")
    got = packing.pack(docs, buckets=6, budget=256).collect()
    want = sorted((str(i), len((t or "").split()) + 1) for i, t, _ in data)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    batches = {}
    for r in got:
        assert r.bucket_length - r.n_tokens == r.padding >= 0
        batches.setdefault(r.batch_id, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    short = {}
    for rows in batches.values():
        assert len({r.bucket for r in rows}) == 1 and sorted(r.position for r in rows) == list(range(rows[0].batch_rows)) and len(rows) == rows[0].batch_rows
        assert len(rows) == 1 or len(rows) * rows[0].bucket_length <= 256
        if len(rows) < max(1, 256 // rows[0].bucket_length):
            short[rows[0].bucket] = short.get(rows[0].bucket, 0) + 1
    assert all(n == 1 for n in short.values())
    histogram = sorted({n: sum(m == n for _, m in want) for _, n in want}.items())
    assert sum(r.padding for r in got) == padding(histogram, packing.optimal_bounds(histogram, 6))
    assert packing.pack(docs.where(F.lit(False))).count() == 0

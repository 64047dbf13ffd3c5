import math
import re

from pyspark.sql import functions as F

from lorewright.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(3 * sizes[s] for s in held)) / max(1e-300, sum(weight[s] for s in free)) if free else 0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in held else level * weight[s] for s in order}
        held |= over


def rows(seed=1):
    import random

    rng = random.Random(seed)
    out = []
    for i in range(3000):
        source = rng.choice(["b", "a", "a", "a", "c", "é", None, "tiny"]) if i % 3 else "a"
        if source == "tiny" and rng.random() < 0.8:
            source = "c"
        out.append((i, "w " * int(rng.paretovariate(1.2) * 8), source))
    return [*out, (3001, None, "a"), (3002, " \t", None), (None, "x y", "a"), (7, "same row", "b"), (7, "same row", "b"), *[(9000 + i, "hot copy of a text", "a") for i in range(900)]]


def test_targets_and_taken_words(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = brute_targets(sizes)
    assert math.isclose(sum(want.values()), sum(sizes.values()))
    source_of = {}
    for i, t, s in data:
        source_of.setdefault((i, words(t)), s)
    taken = {}
    for r in got:
        s = source_of[(r.doc_id, r["size"])]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r["size"] and (r.taken == r.copies * r["size"])
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.001 * t), (s, taken[s], t)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def direct(cells, target):
    """b of one source by halving; cells is [(size, n)]."""
    mean = sum(s * n for s, n in cells) / sum(n for _, n in cells)
    taken = lambda b: sum(s * n * math.exp(min(math.log(3), b * s / mean)) for s, n in cells)
    low, high = -1e4, 1e4
    for _ in range(200):
        half = (low + high) / 2
        low, high = (half, high) if taken(half) < target else (low, half)
    return half, mean


def entropy(rates):
    """Relative entropy to 1 of [(rate, n)]."""
    return sum(n * ((r * math.log(r) if r > 0 else 0) - r + 1) for r, n in rates)


def test_dual_matches_a_direct_solution(spark):
    sources = {s: [(size, 3 + size % 4) for size in range(1, 60)] + [(5000, 2)] for s in ("0.05", "0.4", "0.97", "1.0", "1.6", "2.9", "3.0")}
    cells = spark.createDataFrame([(s, *c) for s, cs in sources.items() for c in cs], "src string, size long, n long")
    total = sum(s * n for s, n in sources["0.4"])
    targets = spark.createDataFrame([(s, total, total * float(s)) for s in sources], "src string, source_size long, target double")
    got = {r.src: r for r in mixing.tilted_rates(cells, targets).collect()}
    assert set(got) == set(sources)
    for s, cs in sources.items():
        share, (b, mean) = float(s), direct(cs, total * float(s))
        rates = [(min(3.0, math.exp(min(9.0, got[s].b * size / mean))), n) for size, n in cs]
        assert math.isclose(sum(r * size * n for (r, n), (size, _) in zip(rates, cs)), share * total, rel_tol=1e-6)
        if share not in (1.0, 3.0):
            assert math.isclose(got[s].b, b, rel_tol=1e-5) and (got[s].b < 0) == (share < 1)
            assert entropy(rates) < entropy([(share, n) for _, n in cs])


def test_the_registered_query_tilts(spark):
    """Rates of a source differ by length, and are nearer to 1 than the uniform rate of the same words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    groups = {}
    for r in mixing.op4_entropy_mixing(spark, "/root/testdata/sf0.01").where("size > 0").collect():
        groups.setdefault(source[r.doc_id], []).append(r)
    tilted = 0
    for rows_ in groups.values():
        share = rows_[0].target / rows_[0].source_size
        rates = [(r.rate, 1) for r in rows_]
        assert math.isclose(sum(r.rate * r["size"] for r in rows_), rows_[0].target, rel_tol=1e-6)
        assert abs(sum(r.taken for r in rows_) - rows_[0].target) <= 0.005 * rows_[0].target  # half of a short text
        if abs(share - 1) > 1e-6 and share < 3 - 1e-6:
            tilted += len({r.rate for r in rows_}) > 1
            assert entropy(rates) < entropy([(share, 1)] * len(rows_))
    assert tilted >= len(groups) - 2


def test_many_sources_settle_like_brute_force(spark):
    import random

    rng = random.Random(3)
    sizes = {f"s{k}": int(rng.paretovariate(0.7)) for k in range(500)} | {None: 40, "zero": 0}
    table = [("n" if s is None else f"s{s}", s, n) for s, n in sizes.items()]
    got = {r.src: r.target for r in mixing.source_targets(spark.createDataFrame(table, "src string, source string, source_size long")).collect()}
    for s, t in brute_targets(sizes).items():
        assert math.isclose(got["n" if s is None else f"s{s}"], t, rel_tol=1e-9, abs_tol=1e-9)


def test_one_length_one_source_and_empty(spark):
    docs = spark.createDataFrame([(i, "a b c", "only") for i in range(10)], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix(docs).collect()) == 30
    assert mixing.mix(docs.where(F.lit(False))).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "x")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]


def test_stage_repeats_rows_as_the_mix_takes_them(spark):
    docs = spark.createDataFrame(rows(2), "doc_id long, text string, source string").withColumn("copies", F.lit("clash"))
    plan = {}
    for r in mixing.mix(docs).collect():
        plan[(str(r.doc_id), r["size"])] = plan.get((str(r.doc_id), r["size"]), 0) + r.copies
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        k = (str(r.doc_id), words(r.text))
        got[k] = got.get(k, 0) + 1
    assert got == {k: v for k, v in plan.items() if v}

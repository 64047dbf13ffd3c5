import random

import pytest
from pyspark.sql import functions as F

from lorewright.operators import intervals, navigation, ranking


def brute(names, parent):
    kids = {}
    for c, p in parent.items():
        if p in names:
            kids.setdefault(p, []).append(c)
    order = lambda x: (names[x] is None, names[x] or "", x)
    out = {}

    def walk(top):
        todo, place = [(top, 0)], 0
        while todo:
            x, depth = todo.pop()
            out[x] = [parent.get(x) if parent.get(x) in names else None, top, depth, place, 1, len(kids.get(x, []))]
            place += 1
            todo += [(c, depth + 1) for c in sorted(kids.get(x, []), key=order, reverse=True)]

    for x in names:
        if parent.get(x) not in names:
            walk(x)
    for x in sorted(out, key=lambda x: -out[x][2]):
        if out[x][0] is not None:
            out[out[x][0]][4] += out[x][4]
    return {x: tuple(v) for x, v in out.items()}


@pytest.mark.parametrize("heavy", [5, 1_000])
def test_forests_equal_a_plain_walk(spark, heavy):
    rng = random.Random(heavy)
    names = {i: rng.choice(["a", "b", "c", None]) for i in range(120)}
    parent = {i: (rng.randrange(0, i) if rng.random() < 0.5 else 0) for i in range(1, 110)} | {115: 999}
    locations = spark.createDataFrame(list(names.items()), "id long, name string")
    edges = spark.createDataFrame(list(parent.items()), "child long, parent long")
    found = navigation.navigation(locations, edges, heavy)
    rows = {r.id: (r.parent, r.root, r.depth, r.place, r["size"], r.children) for r in found.collect()}
    want = brute(names, parent)
    assert rows == want
    some = spark.createDataFrame([(0,), (5,)], "id long")
    below = {(r.id, r.node) for r in navigation.descendants(found, some).collect()}
    assert below == {(t, x) for t in (0, 5) for x in names if want[x][1] == want[t][1] and want[t][3] < want[x][3] < want[t][3] + want[t][4]}


def test_a_deep_chain_and_no_rows(spark):
    locations = spark.range(300).select("id", F.col("id").cast("string").alias("name"))
    edges = spark.range(1, 300).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    got = {r.id: (r.depth, r.place, r["size"]) for r in navigation.navigation(locations, edges).collect()}
    assert got == {i: (i, i, 300 - i) for i in range(300)}
    assert navigation.navigation(locations.where("false"), edges).count() == 0


def test_running_sums_of_split_groups(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g long, v long")
    for heavy in (3, 1_000):
        got = {r.i: r.s for r in ranking.running_sum(df, "g", [F.col("i")], "v", "s", heavy).collect()}
        assert got == {i: sum(w for j, h, w in rows if h == g and j < i) for i, g, _ in rows}


@pytest.mark.parametrize("pages", [None, 1, 3])
def test_points_in_ranges_equal_all_comparisons(spark, pages):
    rng = random.Random(6)
    n = lambda top: rng.choice([None, *range(top)] if rng.random() < 0.1 else [*range(top)])
    points = [(k, rng.choice("ab"), n(20), n(50)) for k in range(200)]
    ranges = [(k, rng.choice("ab"), n(20), n(50), n(20), n(50)) for k in range(60)]
    p = spark.createDataFrame(points, "item long, doc string, page int, start int")
    r = spark.createDataFrame(ranges, "section long, doc string, page int, start int, to_page int, to_start int")
    got = sorted((x.item, x.section) for x in intervals.points_in_ranges(p, r, ["doc"], pages).collect())
    want = sorted(
        (i, s) for i, d, a, b in points for s, e, c, f, g, h in ranges
        if d == e and None not in (a, b, c, f, g, h) and (c, f) <= (a, b) < (g, h)
    )
    assert got == want and got

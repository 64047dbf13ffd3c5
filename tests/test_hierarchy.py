from lorewright.operators.components import connected_components
from lorewright.operators.hierarchy import cycles, location_tree


def tree(spark, edges, names="abcdefg"):
    places = spark.createDataFrame([(c,) for c in names], "id string")
    rows = [(f"r{k}", s, t, kind, c) for k, (s, t, kind, c) in enumerate(edges)]
    e = spark.createDataFrame(rows, "id string, source_id string, target_id string, type string, confidence double")
    selected, notes = location_tree(e, places)
    return {(r.child, r.parent) for r in selected.collect()}, sorted((r.id, r.code) for r in notes.collect())


def test_directions_self_missing_and_duplicates(spark):
    got, notes = tree(spark, [("a", "b", "Located in", 0.9), ("b", "c", "contains", 0.9), ("a", "a", "located in", 1.0), ("d", "x", "located in", 1.0), ("a", "b", "located-in", 0.95), ("a", "e", "near", 1.0)])
    assert got == {("a", "b"), ("c", "b")}
    assert notes == [("r0", "duplicate_parent"), ("r2", "self_containment"), ("r3", "missing_parent")]


def test_specific_parent_wins_and_rivals_need_a_lead(spark):
    got, notes = tree(spark, [("a", "b", "located in", 0.8), ("b", "c", "located in", 0.9), ("a", "c", "located in", 0.99)])
    assert got == {("a", "b"), ("b", "c")} and notes == [("r2", "less_specific_parent")]
    got, notes = tree(spark, [("a", "b", "located in", 0.9), ("a", "c", "located in", 0.8)])
    assert got == set() and [c for _, c in notes] == ["ambiguous_parent"] * 2
    got, notes = tree(spark, [("a", "b", "located in", 0.95), ("a", "c", "located in", 0.7), ("d", "e", "located in", 0.6)])
    assert got == {("a", "b")} and notes == [("r1", "ambiguous_parent"), ("r2", "low_confidence")]


def test_a_cycle_loses_its_weakest_edge(spark):
    got, notes = tree(spark, [("a", "b", "located in", 0.9), ("b", "c", "located in", 0.8), ("c", "a", "located in", 0.75), ("d", "a", "located in", 0.9)])
    assert got == {("a", "b"), ("b", "c"), ("d", "a")} and notes == [("r2", "cycle")]


def test_components_of_long_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(1, 200)] + [(500, k) for k in range(501, 560)] + [(900, 900), (None, 3), (70, 20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 201), 1), **dict.fromkeys(range(500, 560), 500), 900: 900}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cycles_are_named_by_their_least_node(spark):
    loop = [(100 + k, 100 + (k + 1) % 37) for k in range(37)]
    tails = [(200, 120), (201, 200), (202, 201)]
    chain = [(k, k + 1) for k in range(300, 400)]
    pair = [(8, 9), (9, 8)]
    e = spark.createDataFrame(loop + tails + chain + pair + [(5, 5)], "child long, parent long")
    got = {r.node: r.cycle for r in cycles(e).collect()}
    assert got == {**dict.fromkeys(range(100, 137), 100), 8: 8, 9: 8, 5: 5}
    assert cycles(e.where("child BETWEEN 300 AND 399")).count() == 0 and cycles(e.limit(0)).count() == 0

import itertools
import math
import random

import pytest

from lorewright.operators.similarity import overlapping_sets
from lorewright.plans import signals


@pytest.mark.parametrize("share", [0.5, 0.75, 1.0])
def test_overlaps_equal_all_pairs(spark, share):
    rng = random.Random(share)
    sets = {i: {min(int(rng.expovariate(0.12)), 40) for _ in range(rng.randint(1, 12))} for i in range(90)}
    rows = [(i, x) for i, s in sets.items() for x in s] + [(1, x) for x in sets[1]] + [(None, 3), (4, None)]
    got = sorted((r.left_id, r.right_id, r.overlap) for r in overlapping_sets(spark.createDataFrame(rows, "id long, item long"), 2, share).collect())
    want = []
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n >= 2 and n >= math.ceil(share * min(len(sets[a]), len(sets[b])) - 1e-9):
            want.append((a, b, n))
    assert got == want and want


def test_an_item_of_all_sets_makes_no_pairs(spark):
    rows = [(i, 0) for i in range(500)] + [(i, 1000 + i * 3 + k) for i in range(500) for k in range(3)] + [(7, 1024), (7, 1025), (7, 1026)]
    got = overlapping_sets(spark.createDataFrame(rows, "id long, item long")).collect()
    assert [(r.left_id, r.right_id, r.overlap) for r in got] == [(7, 8, 4)]


def test_all_signals(spark):
    entities = [
        (1, "npc", "lord ari"), (2, "npc", "ari"), (3, "faction", "vostria"), (4, "faction", "vostrian empire"), (5, "location", "mill ford"), (6, "location", "the mill ford"),
        (7, "item", "torch"), (8, "event", "siege"), (9, "npc", "vex"), (10, "npc", "zed"),
    ]
    sources = [(7, 1, "a torch at the siege"), (7, 2, "x"), (8, 1, "y"), (8, 2, "z"), (8, 3, None), (9, 5, "vexed zed")]
    said = [("alias", 10, 9), ("identity", 9, 10), ("other", 1, 9), ("alias", 3, 3)]
    got = signals.pair_signals(
        spark.createDataFrame(entities, "id long, type string, name string"), spark.createDataFrame(sources, "id long, page long, text string"),
        spark.createDataFrame(said, "kind string, left_id long, right_id long"),
    )
    rows = {(r.left_id, r.right_id): {c for c in (*signals.NAMES, *signals.OTHERS) if r[c]} for r in got.collect()}
    assert rows[1, 2] >= {"npc_title_variant"} and rows[5, 6] >= {"article_variant"}
    assert rows[7, 8] == {"source_page_overlap", "contextual_coreference"} and rows[9, 10] == {"explicit_alias", "explicit_identity"}
    assert (1, 9) not in rows

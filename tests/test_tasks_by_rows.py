"""Tasks follow the rows of a step, not the session's number of partitions, so that a task's memory does not grow with the input."""

import re

from lorewright.operators import completeness as C
from lorewright.operators import components, identities
from lorewright.plans import completeness, relational
from lorewright.plans import resolution as R
from lorewright.plans import signals


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tasks_of_writes(spark, monkeypatch, *modules) -> dict[str, int]:
    """How many tasks the exchanges of a written table have, by its name."""
    seen = {}
    for m in modules:
        write = m.materialize
        monkeypatch.setattr(m, "materialize", lambda df, name, write=write: (seen.setdefault(name, int(spark.conf.get("spark.sql.shuffle.partitions"))), write(df, name))[1])
    return seen


def test_signals(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(R, "ENTITIES", 10)
    monkeypatch.setattr(signals, "MEMBERS", 6)
    seen = tasks_of_writes(spark, monkeypatch, R, signals)
    entities = spark.createDataFrame([(k, "T", f"brand bolt{k // 2}") for k in range(60)], "id long, type string, name string")
    sources = spark.createDataFrame([(k, k // 2 + p, f"brand bolt{k // 2} nut") for k in range(60) for p in (0, 100)], "id long, page long, text string")
    found = signals.pair_signals(entities, sources, spark.createDataFrame([("alias", 1, 2)], "kind string, left_id long, right_id long"))
    assert seen["blocks"] == seen["met"] == 6 and seen["marks"] == 20
    ends = R.with_ends(sources.selectExpr("id left_id", "page right_id"), entities.selectExpr("*", "split(name, ' ') tokens"), 7)
    assert len(re.findall(r"hashpartitioning\(\w+#\d+L, 7\), REPARTITION_BY_NUM", plan_of(ends))) == 4 and "ENSURE_REQUIREMENTS" not in plan_of(ends)
    rows = {(r.left_id, r.right_id): (r.exact_name, r.source_page_overlap, r.contextual_coreference, r.explicit_alias) for r in found.collect()}
    assert {p for p in rows if p[0] // 2 == p[1] // 2} == {(k, k + 1) for k in range(0, 60, 2)} and rows[1, 2][3]
    assert all(rows[k, k + 1] == (True, True, True, False) for k in range(0, 60, 2))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_pairs_of_pages(spark, monkeypatch):
    rows = [(i, p) for p in range(9) for i in range(p, p + 4)] * 2 + [(None, 1), (5, None), (None, None), (6, None)]
    want = {}
    for p in range(9):
        for i in range(p, p + 4):
            for j in range(i + 1, p + 4):
                want[i, j] = want.get((i, j), 0) + 1
    monkeypatch.setattr(relational, "MEMBERS", 10)
    monkeypatch.setattr(relational, "PAIRS", 9)
    found = relational.pairs_of_pages(spark.createDataFrame(rows, "id long, page long"))
    assert re.search(r"hashpartitioning\(page#\d+L, 8\), REPARTITION_BY_NUM", plan_of(found))  # 72 members, repeats included
    assert re.search(r"hashpartitioning\(left_id#\d+L, right_id#\d+L, 6\), REPARTITION_BY_NUM", plan_of(found)) and "ENSURE" not in plan_of(found)  # 54 pairs
    assert {(r.left_id, r.right_id): r.shared_pages for r in found.collect()} == {p: n for p, n in want.items() if n >= 2}
    assert relational.pairs_of_pages(spark.createDataFrame([], "id long, page long")).count() == 0


def test_completeness(spark, monkeypatch):
    monkeypatch.setattr(completeness, "OCCURRENCES", 1_000)
    seen = tasks_of_writes(spark, monkeypatch, C)
    found = completeness.completeness_segments(spark, "/root/testdata/sf0.001")
    assert set(seen) >= {"useful", "places", "targets", "held", "taken", "more"} and set(seen.values()) == {6}
    assert found.count() > 0 and spark.conf.get("spark.sql.files.maxPartitionBytes") != "8m"


def test_no_round_of_identities_brings_rows_to_the_driver(spark, monkeypatch):
    plans = []
    for m in (identities, components):
        write = m.materialize
        monkeypatch.setattr(m, "materialize", lambda df, name, write=write: (plans.append(plan_of(df)), write(df, name))[1])
    rows = [(1, "alias", "a", "a", "b"), (2, "alias", "b", "b", "c"), (3, "alias", "x", "y", "z")]
    known = spark.createDataFrame([("b", 7)], "name string, id long")
    enabled, names = identities.enabled_components(spark.createDataFrame(rows, "statement long, kind string, source_name string, claimed_name string, other_name string"), known, tasks=2)
    assert {r.statement: r.enabled_at for r in enabled.collect()} == {1: 0, 2: 0, 3: None}
    assert {(r.name, r.component, r.entity) for r in names.collect()} == {(n, "a", 7) for n in "abc"}
    assert len(plans) > 8 and not [p for p in [*plans, plan_of(names)] if "Broadcast" in p]

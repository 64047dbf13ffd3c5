"""Findings of round 05: what must be listed once, dealt once or read once."""

import re

from pyspark.sql import functions as F

from lorewright.operators import descriptors as D
from lorewright.operators import mentions as M
from lorewright.operators import source_forms as SF
from lorewright.operators import structure as S
from lorewright.plans import structure as P
from lorewright.plans.validation import reviewed_additions


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_claims_of_a_unit_are_listed_before_additions_meet_them(spark):
    schema = "claim long, statement string, context string, entities array<string>, units array<string>"
    new = spark.createDataFrame([(1, " The  KING fell", "a", ["x"], ["u1", "u2"]), (2, "the king fell", "a", ["x"], ["u1"]), (3, None, None, None, None)], schema)
    old = spark.createDataFrame([(k, "the king fell", "a", ["x"], ["u1", "u2"]) for k in (12, 10, 11)], schema)
    found = reviewed_additions(new, old, 7)
    assert {r.claim: (r.same, r.shared) for r in found.collect()} == {1: ([10, 11, 12], [10, 11, 12]), 2: ([10, 11, 12], [10, 11, 12]), 3: ([], [])}
    plan = plan_of(found)
    assert re.search(r"hashpartitioning\(said#\d+, context#\d+, ids#\d+, 7\), REPARTITION_BY_NUM", plan)  # by the tasks asked for, not by bytes read
    assert "collect_list(priors" in plan and not re.search(r"collect_set\(prior#[^\n]*\n[^\n]*\n?[^\n]*Join \[unit", plan)


def test_lines_of_a_document_are_exchanged_once(spark):
    texts = {1: ["RUMORS\nIt is told in various regions.\nThe Guide", "Day 2\nThe Guide", "The Guide\nTraits", "The Guide\n# Mill\n\nroll a d6"], None: ["RUMORS", "Traits\nTHE END"]}
    lines = [(d, p, k, t) for d, pages in texts.items() for p, text in enumerate(pages, 1) for k, t in enumerate(text.split("\n"))] + [(1, 4, 1, "# Inn"), (2, None, 0, "RUMORS"), (2, 1, 0, None)]
    df = spark.createDataFrame(lines, "document_id long, page long, line_no int, text string")
    found = S.section_contexts(df, 7)
    plan = plan_of(found)
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert {(r.document_id, r.page): (r.context, r.headings) for r in found.collect()} == {
        (1, 1): ("rumors", 1), (1, 2): ("rumors > day_2", 1), (1, 3): ("rumors > day_2", 0), (1, 4): ("mill", 2), (2, None): ("rumors", 1), (2, 1): ("rumors", 0), (None, 1): ("rumors", 1), (None, 2): ("the_end", 2),
    }
    assert sorted(map(str, S.section_lines(df, 7, whole=True).collect())) == sorted(map(str, S.section_lines(df).collect()))


def test_lines_are_written_before_sections_are_sought(spark):
    plan = plan_of(P.section_contexts(spark, "/root/testdata/sf0.001"))
    assert "o_orderkey" not in plan and "p_partkey" not in plan  # exchanges of orders and parts are gone by then


def test_repeated_texts_are_read_once(spark):
    seen = []

    def find(each, keys):
        seen.append(each.count())
        return each.select(*keys, F.length("text").alias("n"))

    rows = [(k, "guards" if k % 2 else "no guard") for k in range(12)]
    texts = spark.createDataFrame([*rows, (12, None)], "k long, text string")
    assert sorted(map(tuple, M.by_text(texts, ["k"], find).collect())) == [(k, len(t)) for k, t in rows]
    assert M.by_text(texts.where("k < 2"), ["k"], find).count() == 2 and seen == [2, 2]


def test_parents_of_the_same_names_stand_in_one_row(spark, monkeypatch):
    written = {}
    keep = D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, name: written.update({name: keep(df, name)}) or written[name])
    entities = spark.createDataFrame([(k, "Ari", None) for k in range(1, 6)] + [(6, "Vess", None), (7, "Vess", ["Ari"])], "id long, name string, aliases array<string>")
    units = spark.createDataFrame([("d", 1, 1, "a", "Vess's guards held."), ("d", 2, 2, "b", "Ari's envoys left."), ("e", 3, 1, "a", "Ari's guards held.")], "doc string, unit long, place int, context string, text string")
    one = entities.where("id <> 7")
    mentions = spark.createDataFrame([(1, 1, "the guards"), (2, 2, "the envoys"), (3, 3, "Ari's guards")], "mention long, claim long, text string")
    cited = units.select(F.col("unit").alias("claim"), "doc", "unit")
    assert [tuple(r) for r in D.resolve_descriptors(mentions, cited, units, one).collect()] == [(1, 6, "cited", 1)]
    assert written["registry"].count() == 3
    assert D.resolve_descriptors(mentions, cited, units, entities).count() == 0  # Vess has two, one of them with another name


def test_units_are_not_multiplied_by_the_runs_of_their_document(spark):
    units = spark.createDataFrame([("d", k, k, c) for k, c in enumerate(["a", "a > b", None, "a", "c"])], "doc string, unit long, place int, context string")
    found = SF.scopes(units.select("doc", "unit"), units)
    assert {(r.unit, r.place, r.first) for r in found.collect()} == {(0, 0, 0), (1, 1, 0), (2, 2, 2), (3, 3, 3), (4, 4, 4)}
    plan = plan_of(found)
    assert "collect_list(struct(last" in plan and "collect_set" not in plan and "max(CASE WHEN" not in plan

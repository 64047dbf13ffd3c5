import pytest

from lorewright.plans import rich


def test_outcomes_and_failure_of_the_whole(spark):
    src = "sources array<struct<page:int,quote:string>>"
    entities = spark.createDataFrame([(1, "npc"), (2, "item"), (3, "npc"), (3, "npc"), (9, "npc")], "id long, type string")
    facts = spark.createDataFrame(
        [(1, 1, "age", [(1, "Ari is forty years old")]), (1, 2, "age", [(2, "Ari is forty years old")]), (1, 3, "mass", None), (9, 1, "age", None), (1, 4, "age", None)], f"owner long, fact long, field string, {src}"
    )
    rel = spark.createDataFrame([(1, 2, "has", [(1, "old, they say so")]), (1, 1, "is", None), (1, 7, "is", None), (2, 1, "of", [])], f"source long, target long, type string, {src}")
    inventory = spark.createDataFrame([(1, "npc"), (2, "npc"), (3, "npc"), (4, "item")], "id long, type string")
    fields = spark.createDataFrame([("npc", "age"), ("item", "mass")], "type string, field string")
    pages = spark.createDataFrame([(1, "Ari is forty years old, they say so."), (2, None)], "page int, text string")
    found = rich.rich_outcomes(entities, facts, rel, inventory, fields, pages)
    assert {(r.kind, r.identifier): r.outcome for r in found.collect()} == {
        ("entity", "1"): "kept", ("entity", "2"): "type mismatch", ("entity", "3"): "duplicate id", ("entity", "9"): "unknown id", ("entity", "4"): rich.OMITTED,
        ("fact", "1:1"): "kept", ("fact", "1:2"): rich.NO_EVIDENCE, ("fact", "1:3"): "invalid field", ("fact", "9:1"): "unknown id", ("fact", "1:4"): rich.NO_EVIDENCE,
        ("relationship", "1:2:has"): "kept", ("relationship", "1:1:is"): "self relationship", ("relationship", "1:7:is"): "unknown endpoint", ("relationship", "2:1:of"): rich.NO_EVIDENCE,
    }
    with pytest.raises(Exception, match="must not break"):
        rich.validated(found).collect()
    fine = found.where("outcome in ('kept', 'no valid source evidence')")
    assert {r.outcome for r in rich.validated(fine).collect()} == {rich.NO_EVIDENCE}

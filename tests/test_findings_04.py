"""Findings of round 04: what must not be exchanged, broadcast or left out."""

import re

import duckdb
from pyspark.sql import functions as F

from lorewright.operators import mentions as M
from lorewright.operators import source_forms as SF
from lorewright.operators import structure as S
from lorewright.operators.similarity import overlapping_sets
from lorewright.plans import enriched as E
from lorewright.plans import resolution as R
from lorewright.plans.validation import reviewed_additions
from tests.compare import same


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_texts_are_not_broadcast(spark):
    entities = spark.createDataFrame([(8, "Murder of Korvandel", "event", None), (9, "Death of Ann-Mary", "event", ["It's"])], "id long, name string, type string, aliases array<string>")
    texts = [(1, "xmurder of Korvandel murdered"), (2, "a murder of  korvandel, the murder of Korvandels"), (3, "murder of korvandelx, murder of Korvandel"), (None, "Korvandel was murdered")]
    found = M.bounded_context(entities, spark.createDataFrame(texts, "k long, text string"), ["k"])
    assert {(r.k, r.id): r.rules for r in found.collect()} == {(1, 8): "event"}
    assert plan_of(found).count("BroadcastExchange") <= 2  # pairs of ordinal and organisation, titles: fixed tables both


def test_no_pair_of_claims_is_exchanged(spark):
    schema = "claim long, statement string, context string, entities array<string>, units array<string>"
    new = spark.createDataFrame([(1, " The  KING fell", "a", ["x"], ["u1"]), (2, "the king fell", "a", ["x"], None), (3, None, None, None, None)], schema)
    old = spark.createDataFrame([(k, "the king fell", "a", ["x"], ["u2"]) for k in (12, 10, 11)], schema)
    found = reviewed_additions(new, old)
    assert {r.claim: (r.same, r.shared) for r in found.collect()} == {1: ([10, 11, 12], []), 2: ([10, 11, 12], []), 3: ([], [])}
    assert re.search(r"Join \[(\w+)#", plan_of(found)).group(1) == "said"  # nothing comes after the claims of a key


def test_every_entity_of_a_name_is_referenced(spark, tmp_path):
    sf = str(tmp_path)
    parts = [(k, "red bolt", "Brand#1", "T", 5) for k in (1, 2, 4, 5)] + [(3, "red bolt", "Brand#1", "T", 50), (7, "nut", "B", "T", 50), (7, "nail", "B", "T", 50)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{sf}/part.parquet")
    lines = [(1, 1, 1, 9, 40.0, "O"), (2, 1, 4, 9, 40.0, "O"), (3, 1, 7, 9, 40.0, "O")]
    items = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_linestatus string")
    items.withColumn("l_discount", F.lit(0.1)).write.parquet(f"{sf}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    query, sql = E.QUERIES["consistency_diagnostics"]
    df = query(spark, sf)
    assert not same(df, con, sql)[1]
    assert sorted((r.owner, r.referenced) for r in df.where("kind LIKE '%fact%'").collect()) == [(11, 1), (11, 2), (11, 4), (11, 5), (21, 1), (21, 2), (21, 4), (21, 5), (31, 7)]


def test_equal_names_meet_as_one_row(spark, tmp_path):
    parts = [(k, "red bolt", "B", "T", 5 + 40 * (k % 2)) for k in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = R.QUERIES["title_stripped_duplicates"][0](spark, str(tmp_path))
    assert {(r.titled, r.plain) for r in found.collect()} == {(k, 1) for k in range(0, 40, 2)}
    plan = plan_of(found)
    assert re.search(r"HashAggregate\(keys=\[type#\d+, k#\d+", plan[plan.index("Join") :]) or re.search(r"HashAggregate\(keys=\[type#\d+, _groupingexpression#\d+", plan[plan.index("Join") :])


def test_frequent_words_leave_each_task_in_bounded_numbers(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(R, "materialize", lambda df, name: plans.setdefault(name, df))
    rows = [(k % 30, "T", f"brand bolt{k % 30}") for k in range(60)] + [(k, "T", "brand nut") for k in range(100, 141)]
    R.blocked_pairs(spark.createDataFrame(rows, "id long, type string, name string"))
    plan = plan_of(plans["blocks"])
    assert re.search(r"WindowGroupLimit .*\b41\b", plan)
    held = {(r.f, r.k): r.n for r in plans["blocks"].groupBy("f", "k").agg(F.count("*").alias("n")).collect()}
    assert (7, "brand") not in held and (0, "brand nut") not in held and held[0, "brand bolt3"] == 1  # 71 and 41 entities; one that stands twice


def test_lines_are_dealt_among_the_tasks_asked_for(spark):
    lines = [(1, p, k, t) for p, text in enumerate(["RUMORS\nIt is told.\nTraits", "Day 2\nThe Mill"], 1) for k, t in enumerate(text.split("\n"))]
    df = spark.createDataFrame(lines, "document_id long, page long, line_no int, text string")
    found = S.section_lines(df, 7)
    assert re.search(r"hashpartitioning\(document_id#\d+L, key#\d+, 7\), REPARTITION_BY_NUM", plan_of(found))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, S.section_lines(df).collect()))


def test_sets_are_dealt_among_the_tasks_asked_for(spark):
    members = spark.createDataFrame([(k, i) for k in range(12) for i in range(k % 4, k % 4 + 4)] + [(1, 1), (None, 1), (3, None)], "id long, item long")
    found = overlapping_sets(members, tasks=3)
    assert re.search(r"hashpartitioning\(s#\d+L, 3\), REPARTITION_BY_NUM", plan_of(found))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, overlapping_sets(members).collect())) != []


def test_no_run_of_tokens_is_exchanged_for_few_names(spark):
    texts = spark.createDataFrame([(1, "Ari met  Oak Keep, then Ari."), (2, "nobody")], "k long, text string")
    names = spark.createDataFrame([(7, "ari"), (8, "oak keep"), (9, "ari")], "id long, name string")
    found = M.name_spans(texts, ["k"], names)
    assert sorted((r.k, r.id, r.start) for r in found.collect()) == [(1, 7, 0), (1, 7, 5), (1, 8, 2), (1, 9, 0), (1, 9, 5)]
    assert "hashpartitioning(name" not in plan_of(found)


def test_texts_meet_nouns_before_they_are_cut_into_tokens(spark):
    units = spark.createDataFrame([("d", 1, 1, "Several guards stood by the guard."), ("e", 2, 1, "Guards")], "doc string, unit long, place int, text string")
    found = SF.noun_uses(units, spark.createDataFrame([("d", "guards"), ("d", "guard"), ("e", "wolf")], "doc string, noun string"))
    assert sorted((r.unit, r.noun, r.counted) for r in found.collect()) == [(1, "guard", False), (1, "guards", True)]
    assert not re.search(r"hashpartitioning\(doc#\d+, noun#\d+, \d+\), ENSURE[^\n]*\n[^\n]*Generate", plan_of(found))
    assert "hashpartitioning(doc" in plan_of(found) and not re.search(r"SortMergeJoin \[doc#\d+, noun", plan_of(found))

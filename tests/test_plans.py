"""What the physical plans must keep: pushed filters, pruned columns, no Python where none is needed."""

import re

from lorewright.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(registry.queries()["keyed_scan"](spark, SF))
    assert "PushedFilters: [Or(" in p
    assert re.search(r"ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string,p_size:int>", p)
    q = plan(registry.queries()["document_origin"](spark, SF))
    assert "IsNotNull(o_custkey)" in q and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint," in q


def test_relational_queries_run_no_python_and_no_cartesian_product(spark):
    from lorewright.plans import captured, evaluation, graph, normalisers, persistence, relational, resolution, texts, validation

    # Spark has no built-in for the compatibility forms of Unicode: these go through Arrow
    unicode = {"source_check", "composed_names", "composed_facts", "evidence_normalise"}
    for module in (relational, texts, resolution, graph, persistence, validation, evaluation, captured, normalisers):
        for name, (query, _) in module.QUERIES.items():
            p = plan(query(spark, SF))
            assert name in unicode or not re.search(r"ArrowEval|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups", p), name
            assert "CartesianProduct" not in p, name


def test_aggregations_combine_before_the_exchange(spark):
    p = plan(registry.queries()["merged_edges"](spark, SF))
    assert p.count("Aggregate") >= 2 and "partial_max" in p

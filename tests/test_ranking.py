from pyspark.sql import functions as F

from lorewright.operators.prominence import bucket_sizes, rank_within_type
from lorewright.operators.ranking import rank_in_groups


def test_both_ways_give_the_same_ranks(spark):
    rows = [(i, None if i % 7 == 0 else f"g{i % 3}" if i % 2 else "hot", (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, x long")
    order = [F.desc("x"), F.asc("id")]
    light = {r.id: r["rank"] for r in rank_in_groups(df, "g", order).collect()}
    heavy = rank_in_groups(df, "g", order, heavy=10)
    assert heavy.columns == ["id", "g", "x", "rank"] and {r.id: r["rank"] for r in heavy.collect()} == light
    assert rank_in_groups(df.limit(0), "g", order).count() == 0


def test_bucket_sizes_of_small_groups(spark):
    major, supporting = bucket_sizes(F.col("n"))
    got = {r.n: (r.a, r.b) for r in spark.createDataFrame([(n,) for n in range(13)], "n long").select("n", major.alias("a"), supporting.alias("b")).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (1, 2), 6: (1, 2), 7: (1, 2), 8: (2, 2), 9: (2, 3), 10: (2, 3), 11: (2, 3), 12: (2, 4)}


def test_ties_go_by_name_then_id_and_null_types_rank_together(spark):
    rows = [(1, "b", None, 1, 1, 0), (2, "a", None, 1, 1, 0), (3, "a", None, 1, 1, 0), (4, "z", "t", 0, 0, 0)]
    got = rank_within_type(spark.createDataFrame(rows, "entity_id long, name string, type string, pages long, mentions long, relationships long")).collect()
    assert {r.entity_id: (r["rank"], r.prominence) for r in got} == {2: (1, "major"), 3: (2, "supporting"), 1: (3, "minor"), 4: (1, "major")}

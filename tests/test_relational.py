import duckdb

from lorewright.plans import relational as R
from tests.compare import same


def test_tiers_count_distinct_ids_and_no_ids_are_collected(spark, tmp_path):
    sf = str(tmp_path)
    rows = [
        (1, "red bolt", "OLD", "Brand#1", 30), (2, "red bolt", "OLD", "Brand#1", 50), (3, "Red Bolt", "NEW", "Brand#2", 21), (4, "ring", "NEW", "Brand#2", 5),
        (5, "plate", "OLD", "Brand#3", 5), (6, "nut", "LATE", "Brand#3", 5), (7, "Brand#1", "brand#1", "Brand#1", 22),
        # keys held by several rows, names that are types or brands, null ids and names
        (2, "ring", "LATE", "Brand#2", 40), (2, "plate", "NEW", "Brand#3", 50), (4, "old", "new", "Brand#9", 33), (8, "old", "Brand#2", "plate", 9),
        (None, "nut", "LATE", "Brand#8", 50), (9, None, None, None, 30), (10, None, "x", "Brand#8", 1), (11, "y", "late", "z", 2), (None, "w", "v", "only", 60), (12, "only", "w", "v", 3),
    ]
    df = spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int")
    df.write.parquet(f"{sf}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet/*.parquet'")
    query, sql = R.QUERIES["tiered_resolution"]
    got = query(spark, sf)
    n, why = same(got, con, sql)
    assert not why and n == 11
    # an array of ids for every key that is asked grows with the square of the parts
    assert "collect_set(id" not in got._jdf.queryExecution().executedPlan().toString()


def test_terms_of_one_letter_find_nothing_in_typeahead(spark):
    from lorewright.plans.relational import search

    rows = spark.createDataFrame([(1, "Ari", ["Ax"]), (2, "Bo", None)], "id long, name string, aliases array<string>")
    assert [r.id for r in search(rows, " a ").collect()] == [1] and search(rows, " a ", least=2).count() == 0 and search(rows, "AX", least=2).count() == 1

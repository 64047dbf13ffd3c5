import pytest
from pyspark.sql import functions as F

from lorewright.sources import snapshots as S


def rows(df):
    return sorted(map(str, df.collect()))


def test_versions_append_replace_and_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, "x", [1.5]), (2, None, None)], "id long, name string, v array<double>")
    b = spark.createDataFrame([(2, "y", []), (None, "z", None)], "id long, name string, v array<double>")
    assert S.current_version(path) is None
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, path)
    S.write_snapshot(a, path, "once")
    first = S.read_snapshot(spark, path)
    assert rows(first) == rows(a)
    with pytest.raises(Exception, match="written already"):
        S.write_snapshot(b, path, "once")
    S.write_snapshot(b, path)
    assert rows(S.read_snapshot(spark, path)) == sorted(rows(a) + rows(b)) and rows(first) == rows(a)
    S.replace_keys(spark.createDataFrame([(2, "new", None), (None, "none", None)], b.schema), path, ["id"])
    assert {(r.id, r.name) for r in S.read_snapshot(spark, path).collect()} == {(1, "x"), (2, "new"), (None, "none")}
    assert S.current_version(path)["version"] == 3
    with pytest.raises(Exception, match="moved on"):
        S.write_snapshot(a, path, "replace", expected=2)
    S.write_snapshot(a.where("false"), path, "replace")
    assert S.read_snapshot(spark, path).count() == 0


def test_a_failed_task_leaves_the_version_before(spark, tmp_path):
    path = f"{tmp_path}/t"
    S.write_snapshot(spark.range(100).repartition(4), path)
    broken = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        S.write_snapshot(broken, path, "replace")
    assert S.current_version(path)["version"] == 1 and S.read_snapshot(spark, path).count() == 100

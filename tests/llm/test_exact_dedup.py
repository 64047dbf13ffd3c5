import hashlib
import random

from pyspark.sql import functions as F

from lorewright.llm import exact_dedup


def test_matches_brute_force_with_nulls_ties_and_repeated_rows(spark):
    texts = ["a b", "ab", "a\tb ", None, "", " \n", "ä b", "äb", "a b", "ab", "x" * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "ab"), (3, None), (None, "ab  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, capacity=2).collect()
    groups = {}
    for i, t in rows:
        norm = "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(t or ""), i is None, i or 0, i))
    want = sorted(
        (str(i), str(min(groups[n])[3]), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for n in groups for *_, i in groups[n]
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_colliding_keys_are_chained_and_told_apart_by_bytes(spark):
    """With a hash of 3 values nearly every key is a collision; groups stay those of the bytes."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a b", "ab", "ba", "b\ta", "abc", "c", None, "", "d", "ca b"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda norm: F.pmod(F.length(norm), F.lit(3))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = exact_dedup.exact_dedup(docs, capacity=1, key_of=weak)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, exact_dedup.exact_dedup(docs).select(columns).collect()))
    assert got.select("bucket", "chain").distinct().count() == got.select("text_sha256").distinct().count() > got.select("bucket").distinct().count()


def test_rows_are_found_through_the_directory(spark, monkeypatch):
    """A row whose bucket the directory lacks is not found: the index decides, nothing beside it."""
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    whole = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda keys, capacity: whole(keys, capacity).orderBy("slot").limit(3))
    got = exact_dedup.exact_dedup(docs, capacity=4)
    assert 0 < got.count() < 200 and got.select("bucket").distinct().count() == 3


def test_directory_splits_overfull_buckets_but_not_single_keys(spark):
    keys = spark.createDataFrame([(k,) for k in [*range(-40, 40), *[1 << 62] * 50, *[(1 << 61) + i for i in range(7)]]], "key long")
    pages = exact_dedup.directory(keys, capacity=8).collect()
    assert sum(p.entries for p in pages) == keys.count()
    assert all(p.entries <= 8 or p.single for p in pages)
    assert any(p.entries == 50 and p.single for p in pages)


def test_stage_keeps_whole_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b", 5, "s"), (1, "a b", 5, "s"), (1, "a  b", None, None), (2, "c", 1, "s"), (None, None, None, None)],
        "doc_id long, text string, group_size int, kept string",
    )
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "a  b", "c"]
    assert exact_dedup.drop_exact_copies(docs.where(F.lit(False))).count() == 0


def test_query_equals_its_sql(spark):
    from tests.compare import connect, same

    sf = "/root/testdata/sf0.01"
    n, why = same(exact_dedup.op9_exact_dedup(spark, sf), connect(sf), exact_dedup.OP9_SQL)
    assert n == 1000 and not why


def test_no_task_gets_the_rows_of_a_group(spark):
    """A third of the rows are copies; without broadcasts of Spark's own choice no join deals them to one task."""
    from lorewright.llm.common import joined_few

    rows = [(i, "one text" if i % 3 == 0 else f"text {i}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = exact_dedup.exact_dedup(docs)
        assert got.count() == 6_000 and got.where("group_size = 2000").count() == 2_000 and got.where("kept").count() == 4_001
        keyed = docs.select("doc_id", F.xxhash64("text").alias("key"))
        met = joined_few(keyed, keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), ["key"])
        most = met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert met.count() == 6_000 and most <= 0.05 * 6_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

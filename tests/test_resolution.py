from pyspark.sql import functions as F

from lorewright.plans.resolution import blocked_pairs, features


def reasons(spark, left, right):
    row = [(*left, left[1].split(), *right, right[1].split())]
    df = spark.createDataFrame(row, "lt string, ln string, ltk array<string>, rt string, rn string, rtk array<string>")
    pair = df.select(F.struct(F.col("lt").alias("type"), F.col("ln").alias("name"), F.col("ltk").alias("tokens")).alias("l"), F.struct(F.col("rt").alias("type"), F.col("rn").alias("name"), F.col("rtk").alias("tokens")).alias("r"))
    return set(pair.select(features(pair).alias("f")).first().f)


def test_pair_features(spark):
    assert "exact_name" in reasons(spark, ("npc", "harlan stone"), ("item", "harlan stone"))
    assert "article_variant" in reasons(spark, ("location", "the red keep"), ("location", "red keep"))
    assert "token_reorder" in reasons(spark, ("location", "keep of harlan"), ("location", "harlan keep"))
    assert "conservative_subset" in reasons(spark, ("npc", "harlan stone"), ("npc", "harlan grey stone"))
    assert "npc_title_variant" in reasons(spark, ("npc", "high king robert"), ("npc", "robert"))
    assert "npc_title_variant" in reasons(spark, ("npc", "king robert"), ("npc", "robert hale"))
    assert "npc_title_variant" not in reasons(spark, ("npc", "robert"), ("npc", "robert hale"))
    assert "polity_formal_variant" in reasons(spark, ("faction", "vostria"), ("faction", "vostrian empire"))
    assert "organization_qualifier_variant" in reasons(spark, ("faction", "order of silverwood"), ("faction", "silverwood guild"))
    assert "shared_distinctive_stem" in reasons(spark, ("faction", "vostrian army"), ("location", "vostria"))
    assert "name_contains_distinctive" in reasons(spark, ("item", "sword of blackwater"), ("location", "blackwater"))
    assert reasons(spark, ("npc", "anna"), ("npc", "bert")) == set()


def test_blocks_above_the_limit_make_no_pairs(spark):
    rows = [(i, "npc", "same name") for i in range(5)] + [(10, "npc", "other one"), (11, "npc", "one other")]
    df = spark.createDataFrame(rows, "id long, type string, name string")
    assert blocked_pairs(df, most=10).count() == 11
    assert [(r.left_id, r.right_id) for r in blocked_pairs(df, most=4).collect()] == [(10, 11)]


def test_all_block_families_make_candidates(spark):
    rows = [
        (1, "npc", "king robert"), (2, "npc", "robert"), (3, "npc", "harlan stone"), (4, "npc", "harlan grey stone"), (5, "faction", "vostria"), (6, "faction", "vostrian empire"),
        (7, "location", "the red keep"), (8, "location", "red keep"), (9, "faction", "order of silverwood"), (10, "faction", "silverwood guild"), (11, "item", "sword of blackwater"), (12, "location", "blackwater"),
        (13, "npc", "nobody else"),
    ]
    got = {(r.left_id, r.right_id): set(r.reasons) for r in blocked_pairs(spark.createDataFrame(rows, "id long, type string, name string")).collect()}
    assert set(got) == {(k, k + 1) for k in range(1, 13, 2)}
    assert "npc_title_variant" in got[1, 2] and "conservative_subset" in got[3, 4] and "polity_formal_variant" in got[5, 6] and "article_variant" in got[7, 8]
    assert "organization_qualifier_variant" in got[9, 10] and "name_contains_distinctive" in got[11, 12]

from lorewright.plans.validation import reviewed_additions, terms


def test_equal_claims_and_shared_evidence(spark):
    schema = "claim long, statement string, context string, entities array<string>, units array<string>"
    new = spark.createDataFrame([(1, " The  KING fell", "a", ["y", "x"], ["u1", "u1"]), (2, "other", None, [], ["u9"]), (3, None, "a", None, None)], schema)
    old = spark.createDataFrame([(10, "the king fell", "a", ["x", "y"], ["u2"]), (11, "the king fell", "b", ["x", "y"], ["u1"]), (12, "Other", "", [], ["u1", "u9"]), (13, None, "a", None, [None])], schema)
    got = {r.claim: (r.same, r.shared) for r in reviewed_additions(new, old).collect()}
    assert got == {1: ([10], [11, 12]), 2: ([12], [12]), 3: ([], [])}


def test_terms_leave_out_common_and_short_words(spark):
    row = spark.createDataFrame([("Their HEROES would find Élan-vital, élan at one2 inn",)], "t string").select(terms(terms.__globals__["F"].col("t")).alias("w")).first()
    assert sorted(row.w) == ["find", "one2", "vital", "élan"]

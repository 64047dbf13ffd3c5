from lorewright.operators import descriptors as D

ENTITIES = [(1, "Ari", None), (2, "Vostria", ["the Empire"]), (3, "Vess Keep", None)]
UNITS = [
    ("d", "u1", 1, "a", "Ari's guards stood there. The second army of Vostria marched."), ("d", "u2", 2, "a", "The guards slept."), ("d", "u3", 3, "b", "Vess Keep and its gates burned; the guards fled."),
    ("d", "u4", 4, "b", "A Vostrian envoy came. Ari guards were paid. The second army rested."), ("d", "u5", 5, "b", "Ari guards nothing. An Ari guard at the gate."), ("e", "v1", 1, "a", "Vess Keep's 2nd fleet; Ari's 2nd fleet."),
    ("e", "v2", 2, "a", "The 2nd fleet left."), ("e", "v3", 3, "a", None),
]


def frames(spark, mentions, cited):
    return (
        spark.createDataFrame(mentions, "mention long, claim long, text string"), spark.createDataFrame(cited, "claim long, doc string, unit string"),
        spark.createDataFrame(UNITS, "doc string, unit string, place int, context string, text string"), spark.createDataFrame(ENTITIES, "id long, name string, aliases array<string>"),
    )


def test_registry(spark):
    _, _, units, entities = frames(spark, [(1, 1, "x")], [(1, "d", "u1")])
    got = {(r.unit, r.id, r.role, r.ordinal) for r in D.registry(units, entities).collect()}
    assert got == {
        ("u1", 1, "guard", None), ("u1", 2, "army", "second"), ("u3", 3, "gate", None), ("u4", 2, "envoy", None), ("u4", 1, "guard", None), ("u5", 1, "guard", None),
        ("v1", 3, "fleet", "2nd"), ("v1", 1, "fleet", "2nd"),
    }


def test_mentions_resolve_by_cited_near_and_earlier_units(spark):
    mentions = [
        (1, 10, "the guards"), (2, 11, "the guards"), (3, 12, "the guards"), (4, 13, "the second army"), (5, 14, "the 2nd fleet"), (6, 11, "Vess Keep's guards"), (7, 10, "Ari's guards"),
        (8, 10, "the tower"), (9, 15, "second army of Vostria"),
    ]
    cited = [(10, "d", "u1"), (11, "d", "u2"), (12, "d", "u3"), (13, "d", "u4"), (14, "e", "v2"), (15, "d", "u4")]
    got = {r.mention: (r.id, r.how, r.unit) for r in D.resolve_descriptors(*frames(spark, mentions, cited)).collect()}
    assert got == {
        1: (1, "cited", "u1"), 2: (1, "near", "u1"), 3: (1, "near", "u4"), 4: (2, "earlier", "u1"), 7: (1, "cited", "u1"), 9: (2, "earlier", "u1"),
    }


def test_role_keys(spark):
    said = ["Second diplomatic envoys", "armies", "staff", "1st siege engines", "nobody"]
    rows = spark.createDataFrame([(x,) for x in said], "x string").select(D.role_key(D.F.col("x")).alias("k")).collect()
    assert [(r.k.role, r.k.ordinal) for r in rows] == [("envoy", "second"), ("army", None), ("staff", None), ("siege engine", "1st"), (None, None)]

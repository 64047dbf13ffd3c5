from lorewright.operators import source_forms as S

UNITS = [
    ("d", "u1", 1, "a", "Several guards stood by the Moon Spire."), ("d", "u2", 2, "a > b", "The spire hums. They fled."), ("d", "u3", 3, "c", "A wounded soldier called Bert met a priest."),
    ("d", "u4", 4, "c", "The Elder spoke to the Elders. Wolves hunt; wolves hunt at night."), ("d", "u5", 5, "c", "A rat gnaws here. The rat gnaws."), ("e", "v1", 1, "x", "The Iron Tower and the Old Tower burned."),
    ("e", "v2", 2, "x", "The tower fell."), ("f", "w1", 1, "x", "The Iron Tower stood."), ("f", "w2", 2, "x", "Then another tower rose."), ("f", "w3", 3, "x", "The tower fell."), ("f", "w4", 4, "y", "The tower shook."),
]
ENTITIES = [(1, "Moon Spire", None, "location"), (2, "Iron Tower", None, "location"), (3, "Old Tower", None, "location"), (4, "Wolves Guild", ["the Pack"], "faction")]


def frames(spark, mentions, cited):
    return (
        spark.createDataFrame(mentions, "mention long, claim long, text string"), spark.createDataFrame(cited, "claim long, doc string, unit string"),
        spark.createDataFrame(UNITS, "doc string, unit string, place int, context string, text string"),
        spark.createDataFrame(ENTITIES, "id long, name string, aliases array<string>, type string"),
    )


def test_scopes_end_where_contexts_do_not_hold(spark):
    _, cited, units, _ = frames(spark, [(1, 1, "x")], [(1, "d", u) for u in ("u1", "u2", "u3", "u5")])
    assert {(r.unit, r.first) for r in S.scopes(cited, units).collect()} == {("u1", 0), ("u2", 0), ("u3", 3), ("u5", 3)}


def test_classes_without_a_name(spark):
    mentions = [
        (1, 1, "guards"), (2, 1, "the guard"), (3, 3, "soldier"), (4, 3, "priest"), (5, 4, "elder"), (6, 4, "wolf"), (7, 4, "wolves"), (8, 5, "rat"), (9, 5, "they"), (10, 5, "Pack"), (11, 5, "priest"), (12, 1, "Moon Spire guard"),
    ]
    cited = [(1, "d", "u1"), (3, "d", "u3"), (4, "d", "u4"), (5, "d", "u5")]
    got = {r.mention: r.proof for r in S.generic_mentions(*frames(spark, mentions, cited)).collect()}
    assert got == {1: "u1", 2: "u1", 4: "u3", 8: "u5"}


def test_references_to_one_named_thing(spark):
    mentions = [(1, 1, "the spire"), (2, 2, "the tower"), (3, 3, "the tower"), (4, 4, "the tower"), (5, 5, "the tower"), (6, 1, "the guild")]
    cited = [(1, "d", "u2"), (2, "e", "v2"), (3, "f", "w3"), (4, "f", "w1"), (5, "f", "w4")]
    got = {r.mention: (r.id, r.anchor) for r in S.referred_entities(*frames(spark, mentions, cited)).collect()}
    assert got == {1: (1, "u1"), 4: (2, "w1")}

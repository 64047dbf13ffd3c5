import random

from lorewright.operators import identities

SCHEMA = "statement long, kind string, source_name string, claimed_name string, other_name string"


def brute(rows, anchors):
    at, links, rounds = {}, [], 0
    ids = {}
    for name, i in anchors:
        ids.setdefault(name, set()).add(i)
    one = {n: next(iter(v)) for n, v in ids.items() if len(v) == 1}

    def component(name):
        seen, todo = {name}, [name]
        while todo:
            x = todo.pop()
            for a, b in links:
                for y, z in ((a, b), (b, a)):
                    if y == x and z not in seen:
                        seen.add(z)
                        todo.append(z)
        return seen

    fresh = [r for r in rows if r[2] is not None and (r[2] == r[3] or r[2] in one and r[3] in one and one[r[2]] == one[r[3]])]
    while fresh:
        for s, kind, _, c, o in fresh:
            at[s] = rounds
        new = [(c, o) for _, kind, _, c, o in fresh if kind == "alias" and c is not None and o is not None and c != o]
        if not new:
            break
        links, rounds = links + new, rounds + 1
        fresh = []
        for r in rows:
            if r[0] not in at and r[2] is not None and r[3] is not None:
                held = component(r[2])
                if r[3] in held and len(set().union(*(ids.get(x, set()) for x in held))) <= 1:
                    fresh.append(r)
    return {r[0]: at.get(r[0]) for r in rows}


def check(spark, rows, anchors):
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(anchors, "name string, id long")
    got = {r.statement: r.enabled_at for r in identities.enabled_statements(df, known).collect()}
    assert got == brute(rows, anchors)
    return got


def test_random_statements_equal_brute_force(spark):
    rng = random.Random(2)
    name = lambda: rng.choice([*"abcdefghijkl", None])
    for anchors in ([("a", 1), ("b", 1), ("f", 2), ("k", 3), ("k", 4)], []):
        rows = [(i, rng.choice(["alias", "alias", "transition"]), name(), name(), name()) for i in range(14)]
        check(spark, rows, anchors or [("zz", 9)])


def test_a_chain_of_fifty(spark):
    """Statement k waits for k - 1; two entities in the component of the last ones stop it."""
    rows = [(0, "alias", "n0", "n0", "n1")] + [(k, "alias", f"n{k - 1}", f"n{k}", f"n{k + 1}") for k in range(1, 56)]
    got = check(spark, rows, [("n3", 1), ("n52", 2)])
    assert got[50] == 50 and got[51] == 51 and got[53] is None


def test_components_name_their_entity(spark):
    rows = [(1, "alias", "a", "a", "b"), (2, "alias", "c", "c", "d"), (3, "alias", "d", "d", "e"), (4, "transition", "e", "e", "a")]
    df, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("b", 7), ("c", 8), ("e", 9)], "name string, id long")
    _, names = identities.enabled_components(df, known)
    assert {r.name: (r.component, r.entity, r.ambiguous) for r in names.collect()} == {
        "a": ("a", 7, False), "b": ("a", 7, False), "c": ("c", None, True), "d": ("c", None, True), "e": ("c", None, True),
    }

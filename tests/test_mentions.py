import random
import re

import pytest

from lorewright.operators import mentions as M

E = "id long, names array<string>"


def scan(text, names):
    """Spans by patterns; earlier first, longer first at one place, none that overlaps one taken before."""
    spans = set()
    for name in names:
        body = r"\s+".join(re.escape(w) for w in name.split())
        spans |= {(m.start(), m.start() + len(m[1])) for m in re.finditer(rf"(?<![^\W_])(?=({body})(?![^\W_]))", text, re.I)}
    out = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def test_overlaps_bounds_and_separators(spark):
    text = "King Robert met king robert's son; Robertson and King  Robert Hale. King-Robert Hale, Hale Robert"
    texts = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nobody")], "k long, text string")
    entities = spark.createDataFrame([(7, ["Robert", "King Robert", "King Robert Hale"]), (8, ["hale robert", None, "!!"]), (9, None)], E)
    got = {(r.k, r.id): r.mentions for r in M.source_occurrences(entities, texts, ["k"]).collect()}
    assert got == {(1, 7): len(scan(text, ["Robert", "King Robert", "King Robert Hale"])), (1, 8): 1}


@pytest.mark.parametrize("seed", range(2))
def test_random_names_equal_plain_scan(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["anna", "Berta", "carl's", "d'Or", "anna-berta", "Émile", "x1"])
    texts = [(k, "".join(word() + rng.choice([" ", "  ", "\n", ", ", "-"]) for _ in range(40))) for k in range(30)]
    names = {i: list({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(4)}) for i in range(12)}
    tokens = lambda n: re.findall(r"[^\W_]+", n)
    safe = {i: [n for n in ns if max(map(len, tokens(n))) >= (4 if len(tokens(n)) == 1 else 3)] for i, ns in names.items()}
    found = M.source_occurrences(spark.createDataFrame(list(names.items()), E), spark.createDataFrame(texts, "k long, text string"), ["k"]).collect()
    want = {(k, i): len(scan(t, ns)) for k, t in texts for i, ns in safe.items() if scan(t, ns)}
    assert {(r.k, r.id): r.mentions for r in found} == want


def test_excerpts_show_the_first_place_of_the_longest_name(spark):
    text = "  (" + "word " * 100 + "Anna. " + "word " * 60 + "Anna Berta" + " tail" * 100
    entities = spark.createDataFrame([(1, ["Anna", "Anna Berta"])], E)
    r = M.source_occurrences(entities, spark.createDataFrame([(1, text)], "k long, text string"), ["k"]).first()
    at = text.index("Anna Berta") - 220
    assert r.mentions == 2 and r.excerpt == text[at : at + 480].strip()


def test_many_names_meet_by_runs(spark):
    """A hundred thousand names: the plan joins runs with names, and collects no names."""
    names = spark.range(100_000).selectExpr("id", "array(concat('name', id, ' of place', id % 7)) names")
    texts = spark.range(200).selectExpr("id k", "concat('here name', id * 3, ' of place', (id * 3) % 7, ' stood') text")
    assert M.source_occurrences(names, texts, ["k"]).count() == 200


def test_implied_entities(spark):
    entities = spark.createDataFrame(
        [
            (1, "Vostrians", "faction", None), (2, "Third Imperial Army", "faction", None), (3, "Second Fleet", "faction", None), (4, "Old Second Fleet", "faction", None),
            (5, "Duke Gallo", "npc", ["Gallo"]), (6, "King A", "npc", None), (7, "King B", "npc", None), (8, "Murder of Korvandel", "event", None), (9, "Death of Ann", "event", None),
        ],
        "id long, name string, type string, aliases array<string>",
    )
    texts = [
        (1, "A Vostrian patrol of the third great northern imperial army met the king"), (2, "the third one two three four army"), (3, "the second fleet and the duke"),
        (4, "Gallo was duke"), (5, "they killed Korvandel, and Ann died"), (6, "Korvandel was skilled"), (7, "Vostrians came"), (8, None),
    ]
    got = {(r.k, r.id): r.rules for r in M.bounded_context(entities, spark.createDataFrame(texts, "k long, text string"), ["k"]).collect()}
    assert got == {(1, 1): "plural", (1, 2): "organisation", (3, 5): "title", (5, 8): "event"}

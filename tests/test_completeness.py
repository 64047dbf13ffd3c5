import random

from lorewright.operators import completeness as C


def brute(occ, rel, seg):
    out, aims = [], {}
    for doc in {d for d, *_ in occ}:
        held = {}
        for d, s, e in occ:
            if d == doc:
                held.setdefault(s, set()).add(e)
        held = {s: es for s, es in held.items() if len(es) >= 2}
        ends = [(s, e) for d, s, a, b in rel if d == doc for e in (a, b)]
        found = []
        for e in {e for es in held.values() for e in es}:
            every = [s for s in held if e in held[s]]
            left = [s for s in every if (s, e) not in ends]
            degree = sum(x == e for _, x in ends)
            signals = ["zero_degree"] * (degree == 0) + ["repeated_low_degree"] * (degree <= 1 and len(every) >= 2) + ["uncovered_occurrences"] * (len(left) >= 2 and 2 * len(left) >= len(every))
            if signals and left:
                weight = sum({"zero_degree": 10_000, "repeated_low_degree": 3_000, "uncovered_occurrences": 1_000}[s] for s in signals) + 20 * len(left) + len(every)
                found.append((-weight, e, left))
        found = sorted(found)[:4]
        aims |= {(doc, e): -w for w, e, _ in found}
        long = {s: c / 100 for d, s, c in seg if d == doc}
        todo, chosen = {e for _, e, _ in found}, []
        score = lambda s, es: sum(-w for w, e, left in found if e in es and s in left) - long[s]  # noqa: E731, B023
        while len(chosen) < 3:
            fits = sorted((-score(s, todo), s) for s in long if s not in chosen and any(e in todo and s in left for _, e, left in found))
            if not fits:
                break
            chosen.append(fits[0][1])
            todo -= {e for _, e, left in found if fits[0][1] in left}
        out += [(doc, s, k, "cover") for k, s in enumerate(chosen, 1)]
        every = {e for _, e, _ in found}
        more = sorted((-score(s, every), s) for s in long if s not in chosen and score(s, every) > 0)[: 3 - len(chosen)]
        out += [(doc, s, k, "supplement") for k, (_, s) in enumerate(more, len(chosen) + 1)]
    return aims, sorted(out)


def test_plans_equal_the_plain_choice(spark):
    rng = random.Random(9)
    occ = [(rng.randrange(6), rng.randrange(12), rng.randrange(9)) for _ in range(160)]
    rel = [(rng.randrange(6), rng.randrange(12), rng.randrange(9), rng.randrange(9)) for _ in range(30)]
    seg = [(d, s, rng.choice([100, 2_000, 90_000, 3_000_000])) for d in range(6) for s in range(12)]
    found, places = C.targets(spark.createDataFrame(occ, "doc long, segment long, entity long"), spark.createDataFrame(rel, "doc long, segment long, source long, target long"), 4)
    got = C.cover(found, places, spark.createDataFrame(seg, "doc long, segment long, characters long"), 3)
    aims, want = brute(occ, rel, seg)
    assert {(r.doc, r.entity): r.weight for r in found.collect()} == aims
    assert sorted((r.doc, r.segment, r.step, r.kind) for r in got.collect()) == want and {k for *_, k in want} == {"cover", "supplement"}

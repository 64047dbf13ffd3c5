import random
import re
from collections import Counter

import corpus_pipeline as P
from lorewright.llm import packing, toxicity
from lorewright.llm.simhash import fingerprint


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def make(spark, folder):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(i, text(rng.randint(20, 300)), "en", rng.choice(["a", "b", "c", None])) for i in range(300)]
    rows += [(1000 + i, "you idiot, you stupid moron and scum " + text(15), "en", "a") for i in range(12)]
    rows += [(2000 + i, rows[i][1].replace(" ", "  "), "en", "b") for i in range(20)]
    rows += [(3000 + i, rows[30 + i][1] + " tail", "fr", "c") for i in range(20)]
    rows += [(4000, None, None, None), (4001, "", "en", "a"), (5, rows[5][1], "en", rows[5][3]), (4002, "hot " * 3000, "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000 + i, 0, 1) for i in range(12)] + [(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    make(spark, sf)
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    outs = [docs]
    for k, (name, stage) in enumerate(P.STAGES):
        outs.append(stage(spark, outs[-1], sf).cache())
        if k < 4:
            assert outs[-1].columns == columns, name
    r = [[tuple(x) for x in o.collect()] for o in outs]
    score = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    assert Counter(r[1]) == Counter(x for x in r[0] if score(x[1]) < 0.5)
    assert all(not 1000 <= x[0] < 1012 for x in r[1]) and len(r[1]) == len(r[0]) - 12
    best = {}
    for x in r[1]:
        norm = "".join((x[1] or "").split())
        if norm not in best or (-len(x[1] or ""), x[0]) < (-len(best[norm][1] or ""), best[norm][0]):
            best[norm] = x
    assert Counter(x[0] for x in r[2]) == Counter(x[0] for x in best.values())
    prints = {x[0]: fingerprint((x[1] or "").encode()) for x in r[2]}
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if comp[b] < comp[a] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    comp[a], changed = comp[b], True
    assert Counter(x[0] for x in r[3]) == Counter(i for i in comp if comp[i] == i)
    copies = Counter(r[4])
    assert set(copies) <= set(r[3]) and max(copies.values()) <= 3
    size, taken = Counter(), Counter()
    for x in r[3]:
        size[x[3]] += words(x[1])
    for x, n in copies.items():
        taken[x[3]] += n * words(x[1])
    assert abs(sum(taken.values()) - sum(size.values())) <= 0.02 * sum(size.values())
    lengths = Counter(words(x[1]) + 1 for x in r[4])
    assert Counter(p[1] for p in r[5]) == lengths and Counter(p[0] for p in r[5]) == Counter(x[0] for x in r[4])
    bounds = packing.optimal_bounds(sorted(lengths.items()), packing.BUCKETS)
    assert {p[3] for p in r[5]} == set(bounds)
    assert P.run(spark, sf).count() == len(r[5])

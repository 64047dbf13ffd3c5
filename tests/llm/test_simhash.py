import random

import xxhash
from pyspark.sql import functions as F

from lorewright.llm import simhash


def brute(texts):
    prints = {}
    for i, t in texts:
        raw = (t or "").encode()
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    ids = list(prints)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if comp[b] < comp[a] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    comp[a], changed = comp[b], True
    return {i: (f"{prints[i]:016x}", comp[i]) for i in ids}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)] + ["Ärger", "THE", "x"]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 400))] for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for w in base[:20]:
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append("\t\n ".join(v))
    texts += [None, "", " \n", "one", "one two", "ONE two", texts[3], texts[3]]
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_dense_shard_links_nothing_twice_and_loses_nothing():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = sorted({base ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(300)})
    links = simhash.local_links(values, 2)
    assert len({a for a, _ in links}) == len(links) < len(values)
    root = {v: v for v in values}
    root.update(dict(links))
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                assert root[a] == root[b]


def test_stage_keeps_one_row_of_each_component_and_all_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g", "x", 1), (2, "a b c d e f g", "y", 2), (2, "a b c d e f g", "y", 2), (3, "other words are in this", None, 3), (None, "", "z", 4)],
        "doc_id long, text string, component_id string, fp long",
    )
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert simhash.drop_near_copies(docs.where(F.lit(False))).count() == 0


def test_texts_reach_python_in_batches_of_bounded_bytes(spark, monkeypatch):
    inner = simhash._fingerprints

    def checked(batches):
        def each():
            for batch in batches:
                held = sorted(len(t.as_py()) for t in batch.column("text"))
                assert sum(held[:-1]) <= 4 << 20, sum(held)  # a batch ends with the row that passes the bound
                yield batch

        yield from inner(each())

    monkeypatch.setattr(simhash, "_fingerprints", checked)
    text = F.when(F.col("id") == 7, F.repeat(F.lit("long text "), 1_000_000)).otherwise(F.concat(F.lit("w x "), F.repeat(F.lit("y"), 100_000)))
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    assert {(r.doc_id, r.component_id) for r in simhash.near_dedup(docs).collect()} == {(k, 7 if k == 7 else 0) for k in range(300)}
    assert spark.conf.get(key) == before

import hashlib
import random
import re

import pytest

from lorewright.llm import common, decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[tuple(w[s : s + size])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append(str((doc_id, len(w), len(hit), len(found), sha, bool(hit))))
    return sorted(out)


def got(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", range(2))
def test_random_texts_of_few_words_equal_brute_force(spark, seed):
    """Few different words: windows overlap, share prefixes and repeat."""
    rng = random.Random(seed)
    pick = lambda n: " ".join(rng.choices(["a", "B", "été", "7", "É"], weights=[6, 3, 1, 1, 1], k=n))
    items = [(i, pick(rng.randrange(0, 25))) for i in range(20)] + [(3, pick(12)), (None, pick(14)), (99, "a b"), (98, None)]
    docs = [(i, pick(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100 + k, f"{pick(5)}, {text}. {pick(4)}") for k, (_, text) in enumerate(items)]
    assert got(decontamination.contamination(*frames(spark, docs, items), passes=1_000_000 if seed else 20)) == brute(docs, items)


def test_short_items_edges_and_rare_prefixes(spark):
    items = [(1, "One"), (2, "two words"), (3, "three small words"), (4, " ".join(f"w{i}" for i in range(12))), (5, " ".join(f"w{i}" for i in range(2, 12)))]
    docs = [(1, "one"), (2, "words two words"), (3, "x-three SMALL;words"), (4, " ".join(f"w{i}" for i in range(11))), (5, " ".join(f"w{i}" for i in range(9))), (6, "w1 w2")]
    assert got(decontamination.contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_nulls_repeated_rows_long_texts_extra_columns_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(1, None), (None, passage), (None, passage), (2, ""), (3, "fill " * 100_000 + passage), (3, "fill " * 100_000 + passage), (4, "clean text")]
    items = [(7, passage), (8, None)]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, n_words int, k1 string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, words int")
    assert got(decontamination.contamination(d, b)) == brute(docs, items)
    assert got(decontamination.contamination(d, b.where("false"))) == brute(docs, [])
    assert got(decontamination.contamination(d, b.where("item_id = 8"))) == brute(docs, [(8, None)])
    assert decontamination.contamination(d.where("false"), b).count() == 0


def test_a_passage_in_a_third_of_documents_and_many_items(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_KEYS", 3)
    monkeypatch.setattr(decontamination, "joined_few", lambda rows, found, keys: common.joined_few(rows, found, keys, heavy_rows=5))
    passage = "what is the answer to this very common question of all"
    docs = [(i, f"{i} {passage} {i}" if i % 3 == 0 else f"other text number {i} of many that is clean") for i in range(90)]
    items = [(i, f"{passage} item {i}") for i in range(30)]
    assert got(decontamination.contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_query_equals_its_sql(spark):
    from tests.compare import connect, same

    sf = "/root/testdata/sf0.01"
    n, why = same(decontamination.op13_decontamination(spark, sf), connect(sf), decontamination.OP13_SQL)
    assert n == 1000 and not why

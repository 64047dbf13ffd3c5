import random
import re
from collections import Counter

from lorewright.llm import source_audit as audit

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, k=10):
    groups, docs = {}, {}
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOW))
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        docs.setdefault(lang or "", Counter()).update(set(terms))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: c for (la, s), c in groups.items() if la == lang}

        def p(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        share = {s: p(c) for s, c in own.items()}
        whole = p(sum(own.values(), Counter()))
        for s in own:
            pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(share[s][t], whole[t])) for t in kept if own[s][t] > 0 and share[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def sample(n, seed, words=("Aa", "b", "Éc", "éc", "zz", "x1y", "日本", "w", "qq-r", "rare")):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 30))) for _ in range(n)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "z", None, ""])) for i, t in enumerate(texts)]


def test_equals_brute_force_with_nulls_and_extra_columns(spark):
    rows = [*sample(150, 1), (1, None, "xx", "only"), (2, "", "xx", "other"), (None, "b " * 12, None, None)]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA + ", term int, value string")
    assert got(audit.source_audit(docs)) == brute(rows)
    assert audit.source_audit(docs.where("false")).count() == 0


def test_many_small_tiles_and_slices_sum_to_the_same(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=9)), "en", f"s{i % 23:02d}") for i in range(230)]
    groups, terms = audit.shares(audit.term_counts(spark.createDataFrame(rows, SCHEMA)))
    pairs = audit.pair_divergence(groups, terms, tile=4, slices=3, slice_rows=40)
    want = [(la, s, i, v) for la, s, part, i, v, _ in brute(rows) if part == "pair"]
    assert sorted(tuple(r[c] for c in ("lang", "source", "item", "value")) for r in pairs.collect()) == want


def test_radix_select_refines_values_and_then_bytes(spark):
    """Groups of many ties, of one value, of few rows and of long common prefixes; few=1 leaves nothing to plain ranking."""
    rng = random.Random(7)
    rows = {("en", f"t{i:04d}", rng.choice([5, 300, 70_000, 999_999_999])) for i in range(400)}
    rows = [(la, "a", t, v) for la, t, v in rows] + [("en", "b", "p" * 9 + f"{i:03d}", 7) for i in range(200)]
    rows += [("de", "a", x, 1) for x in ("é", "z", "zz", "日", "a")] + [("de", "c", "q" * k, 3) for k in range(1, 30)]
    df = spark.createDataFrame([(a, b, t.encode(), v) for a, b, t, v in rows], "lang string, source string, term binary, value long")
    want = []
    for group in {r[:2] for r in rows}:
        best = sorted((r for r in rows if r[:2] == group), key=lambda r: (-r[3], r[2].encode()))[:10]
        want += [(*r[:2], r[2], r[3], k) for k, r in enumerate(best, 1)]
    found = audit.top_ranked(df, 10, few=1).collect()
    assert sorted((r.lang, r.source, r.term.decode(), r.value, r["rank"]) for r in found) == sorted(want)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    text = b"abc defgh \xc3\xa9t\xc3\xa9 " * 50
    assert b"".join(audit._pieces(text, 7)) == text
    assert sum((len(audit.TERM.findall(p)) for p in audit._pieces(text, 7)), 0) == 150
    rows = [(i, "Long " * 400_000 if i == 0 else "long short", "en", f"s{i % 2}") for i in range(12)]
    assert got(audit.source_audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(5 * 10**15, 9 * 10**15, 10**7), (0, 3, 1), (10**12 + 7, 10**13 + 1, 999_983)]
    df = spark.createDataFrame(cases, "n long, total long, kept long").select(audit.share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases]


def test_query_equals_its_sql(spark):
    from tests.compare import connect, same

    sf = "/root/testdata/sf0.01"
    n, why = same(audit.op12_source_audit(spark, sf), connect(sf), audit.OP12_SQL)
    assert n > 2000 and not why

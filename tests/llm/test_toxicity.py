import math
import random
import zlib

from pyspark.sql import functions as F

from lorewright.llm import toxicity


def distance(a, b):
    """Edits with swaps of neighbours, no letter edited twice."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_machine_finds_all_words_within_the_allowance():
    terms = ["idiot", "pathetic", "abcab", "disgusting", "scum"]
    machine = toxicity.Machine([(t, False, 1.0) for t in terms])
    rng = random.Random(6)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(1, len(word))
            what = rng.randrange(4)
            if what == 0:
                word[k] = rng.choice("abcdtx")
            elif what == 1 and len(word) > 2:
                del word[k]
            elif what == 2:
                word.insert(k, rng.choice("abcdtx"))
            elif k + 1 < len(word):
                word[k], word[k + 1] = word[k + 1], word[k]
        word = "".join(word)
        near = [t for t in terms if t[0] == word[0] and distance(word, t) <= toxicity.allowance(t, False)]
        assert (machine.match(word) is not None) == bool(near), (word, near)


def test_first_letters_of_longer_terms_may_be_misspelled():
    terms = ["idiot", "scum", "stupid", "imbecile", "asshole", "disgusting"]
    machine = toxicity.Machine([(t, False, 1.0) for t in terms])
    assert all(machine.match(w) for w in ("ztupid", "mbecile", "sshole", "tsupid", "xstupid", "idsgustin"))
    assert not any(machine.match(w) for w in ("xdiot", "diot", "cum", "upid"))
    rng = random.Random(7)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(word))
            what = rng.randrange(4)
            if what == 0:
                word[k] = rng.choice("abcdtx")
            elif what == 1 and len(word) > 2:
                del word[k]
            elif what == 2:
                word.insert(k, rng.choice("abcdtx"))
            elif k + 1 < len(word):
                word[k], word[k + 1] = word[k + 1], word[k]
        word = "".join(word)
        near = [t for t in terms if distance(word, t) <= toxicity.allowance(t, False) and (len(t) > 5 or t[0] == word[0])]
        assert (machine.match(word) is not None) == bool(near), (word, near)


def test_whole_words_stay_beside_their_stem():
    counts = [("p", "vile", 100, 0)] + [("w", f"vile{x}", 20, 0) for x in ("ness", "lings", "hearted", "st", "mouth")]
    lexicon = toxicity.learn_lexicon(counts, 500, 5000, 10)
    assert ("vile", True) in {x[:2] for x in lexicon}
    reader = toxicity.Reader(lexicon)
    assert reader.features("such vilehearted talk")[2] > 0 and reader.features("such vlieheartde talk")[2] > 0


def test_stems_have_any_length_and_copies_count_once(spark):
    rng = random.Random(5)
    calm = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    forms = ["schadenfreudig" + x for x in ("er", "es", "em", "en", "ste", "keit")]
    rows, labels = [], []
    for i in range(1, 3000):
        bad = i % 6 == 0
        rows.append((i, calm(20) + (f" {rng.choice(forms)} {calm(5)}" if bad else "")))
        labels.append((i, 1, int(bad)))
    copied = calm(30)
    rows += [(5000 + i, f"{copied} {rng.choice(forms)}") for i in range(400)]  # 400 copies do not make their words marks
    labels += [(5000 + i, 1, 1) for i in range(400)]
    long_word = "x" * 500
    rows += [(6000 + i, f"{calm(12)} {long_word}") for i in range(200)]
    labels += [(6000 + i, 1, 1) for i in range(200)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = {x[:2] for x in toxicity.train(docs, told).lexicon}
    assert ("schadenfreudig", True) in lexicon or ("schadenfreudige", True) in lexicon
    assert (long_word, False) in lexicon and not any((w, False) in lexicon for w in copied.split())


def test_shared_beginnings_match_brute_force():
    rng = random.Random(9)
    for _ in range(100):
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))}
        want = {w[:k] for w in words for k in range(3, len(w) + 1)}
        assert toxicity.shared_beginnings(words) == {p for p in want if sum(w.startswith(p) for w in words) >= 5}


def naive_score(text, lexicon, innocent, weights):
    """The score from edit distances to every term, word by word."""
    words, hits = (text or "").lower().split(), {}
    for i, w in enumerate(words):
        core = w.strip("".join(c for c in set(w) if not c.isalnum()))
        found = []
        for term, stem, value in lexicon if core and core not in innocent else ():
            for part in [core[:k] for k in range(1, len(core) + 1)] if stem else [core]:
                d = distance(part, term)
                if d <= toxicity.allowance(term, stem) and (len(term) > 5 or part[0] == term[0]):
                    found.append((value * 0.8**d, d))
        if found:
            hits[i] = max(found)
    used = [i for i in hits if not toxicity.Reader._is_quoted(words, i, max(0, i - 6), min(len(words), i + 7))]
    row = [1.0] + [0.0] * 7
    if hits:
        near = [any(words[k].strip(".,;:!?") in toxicity.ADDRESS or (k != i and k in hits) for k in range(max(0, i - 6), min(len(words), i + 7))) for i in used]
        strength = [hits[i][0] for i in used]
        row = [1.0, max(strength, default=0.0), math.log1p(len(used)), math.log1p(len(hits) - len(used)), math.log1p(sum(near)), math.log1p(100 * len(used) / len(words)),
               sum(hits[i][1] > 0 for i in used) / max(1, len(used)), math.log1p(sum(strength))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(row, weights, strict=True))))


def test_scores_match_brute_force():
    rng = random.Random(10)
    lexicon = [("idiot", False, 4.0), ("disgusting", False, 3.5), ("imbecile", False, 4.5), ("schadenf", True, 3.0), ("low", True, 5.0)]
    model = toxicity.Model(lexicon, frozenset({"idiom"}), toxicity.PRIOR.copy())
    score, pool = model.scorer(), ["idiot", "idoit", "idiom", "xdiot", "disgustin", "digsusting!!", "mbecile", "schadenfroh", "scha", "lowly", "you", "word", '"idiot"', "calm", "text,", "the", "“imbecile”"]
    for _ in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert math.isclose(score(text), naive_score(text, lexicon, model.innocent, model.weights), rel_tol=1e-9), text


def test_stems_and_quotation():
    reader = toxicity.Reader([("lowei", True, 5.0), ("idiot", False, 5.0)])
    assert reader.features("so loweischaft hier")[1] == 5.0
    assert reader.features("lowe hier")[1:] == [0.0] * 7
    assert reader.features("You IDIOT!!")[1] == 5.0
    assert reader.features("he is an idoit, really")[6] == 1.0
    assert reader.features('the word "idiot" comes from Greek')[2:4][0] == 0.0
    assert reader.features(None) == reader.features("") == [1.0] + [0.0] * 7


def test_held_out_accuracy_and_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    judged = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in judged)
    hit = sum(r.predicted and r.toxic for r in judged)
    assert hit >= 0.9 * sum(r.toxic for r in judged)
    assert sum(r.predicted and not r.toxic for r in judged) <= 0.01 * len(judged)


def test_no_labels_nulls_and_stage(spark):
    docs = spark.createDataFrame(
        [(1, "you stupid moron, you worthless idiot", 3), (2, None, None), (3, "", 1), (None, "a calm text", 2), (3, "x " * 50_000, 1)], "doc_id long, text string, score int"
    )
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score_documents(docs, model).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: (-r.score))] == [1, 0, 0, 0, 0]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.drop_toxic(docs.where(F.lit(False)), model).count() == 0

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lorewright.llm import language_model as L
from lorewright.llm.words import hashed

SF = "/root/testdata/sf0.01"


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_word_hashes_tell_words_apart():
    data = "The the THE, Ä ä\t\n x\x0by  zz zz".encode()
    h, start, end, low = hashed(data)
    got = [bytes(low[a:b]).decode() for a, b in zip(start, end, strict=True)]
    assert got == words(data.decode()) and len(set(h.tolist())) == len(set(got))
    assert hashed(b"")[0].size == hashed(b" \n")[0].size == 0


def test_long_texts_are_read_in_pieces():
    data = ("Some Words\n and " + "x" * 50 + "  more\t" * 3).encode() * 20
    whole = hashed(data)
    for piece in (1, 7, 40, 300, 10**6):
        assert all((a == b).all() for a, b in zip(whole, hashed(data, piece), strict=True))


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, " \n"), (None, "the unseenwordhere"), (3, "a"), (3, "a")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    return docs.collect(), L.score_texts(docs, block_bytes=300_000).collect()


def test_counts_and_base_scores(scored):
    rows, got = scored
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    count = Counter()
    for i, t in rows:
        if not held[i]:
            count.update(words(t))
            count["\n"] += 1
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        seq = [*words(t), "\n"]
        want.append((str(i), held[i], len(seq), sum(count[w] > 0 for w in seq), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in seq), 5)))
    assert sorted(want) == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)


def test_model_beats_the_base_on_held_out_texts(scored):
    _, got = scored
    held = [r for r in got if r.held_out]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # both are below zero
    tokens = sum(r.n_tokens for r in held)
    print("log10 per token, model and base:", sum(r.score for r in held) / tokens, sum(r.base_score for r in held) / tokens)


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 32, L.CODES)
    stats = np.zeros((L.CLASSES, 4), np.int64)
    counts = {k: [int(c) for c in rng.integers(1, 6, 20)] for k in range(L.OWN_CLASS, L.CLASSES)}
    counts |= {k: [50 + k] for k in range(L.OWN_CLASS)}
    for k, c in counts.items():
        stats[k] = (sum(c), len(c), c.count(1), c.count(2))
    model = L.Model(int(stats[:, 0].sum()), int(stats[:, 1].sum()), np.arange(1, L.OWN_CLASS + 1, dtype=np.uint64), codes, stats)
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32)
    for k, c in counts.items():
        total = sum(10 ** model.word_scores(np.full(len(c), k), np.array(c))) + (k >= L.OWN_CLASS) * 10 ** model.word_scores(np.array([k]), np.array([0]))[0]
        assert abs(total - 1) < 1e-9
    rows = np.tile(np.array([[5], [L.ROWS_AT[1] + 7], [L.ROWS_AT[2] + 1], [L.ROWS_AT[3] + 2]]), (1, L.CLASSES))
    assert abs((10 ** model.class_scores(rows, np.arange(L.CLASSES))).sum() - 1) < 1e-5


def test_gradient_is_that_of_the_likelihood():
    """Observed less expected counts are the slope of the log likelihood, measured weight by weight; steps raise it."""
    rng = np.random.default_rng(3)
    model = L.Model(10, 5, np.zeros(0, np.uint64), np.zeros(L.CODES, int), np.ones((L.CLASSES, 4), np.int64))
    rows = np.stack([rng.integers(0, 4, 64) + at for at in L.ROWS_AT])
    own = rng.integers(0, L.CLASSES, 64)
    model.weights[: L.ROWS_AT[0] + 4] = rng.normal(size=(L.ROWS_AT[0] + 4, L.CLASSES)) / 4
    observed, expected = model.observed(rows, own), np.zeros(model.weights.shape)
    model.expected(rows, expected)
    gain = lambda: model.class_scores(rows, own).sum() * np.log(10)
    for _ in range(20):
        r, c = rows[rng.integers(0, 4), rng.integers(0, 64)], rng.integers(0, L.CLASSES)
        kept, e = model.weights[r, c], 0.05
        model.weights[r, c] = kept + e
        up = gain()
        model.weights[r, c] = kept - e
        down = gain()
        model.weights[r, c] = kept
        assert abs((up - down) / (2 * e) - (observed[r, c] - expected[r, c])) < 0.05
    before = gain()
    model.next_step(observed, expected)
    assert gain() > before


def naive_score(model, tokens, count):
    """The log10 probability of one text, token by token; tokens is [(hash, code)], count a dict by hash."""
    total, end = 0.0, (int(L.END), L.END_CODE)
    mix = lambda x: int(L.mixed(np.array([x], np.uint64))[0])
    for k, (h, code) in enumerate(tokens):
        back = [tokens[k - j] if k >= j else end for j in (1, 2, 3)]
        rows = [
            (back[0][0] >> 20) % model.word_rows + L.ROWS_AT[0], mix(back[0][1] * L.CODES + back[1][1]) % L.PAIR_ROWS + L.ROWS_AT[1],
            back[1][1] + L.ROWS_AT[2], back[2][1] + L.ROWS_AT[3],
        ]
        logits = [float(model.bias[c]) + sum(float(model.weights[r][c]) for r in rows) for c in range(L.CLASSES)]
        top = {int(x): int(model.order[j]) for j, x in enumerate(model.top)}
        own = top.get(h, L.OWN_CLASS + int(model.class_of[code]))
        high = max(logits)
        total += (logits[own] - high - math.log(sum(math.exp(x - high) for x in logits))) / math.log(10)
        c = count.get(h, 0)
        total += math.log10(max(c - model.discount[own], 1e-9)) - model.log_n[own] if c else model.unseen[own]
    return total


def test_scores_match_brute_force(spark, monkeypatch):
    """Counts, weights and scores of a small table, computed again with plain loops."""
    kept, plain = [], L.train
    monkeypatch.setattr(L, "train", lambda model, texts, rounds: kept.append(plain(model, texts, rounds)) or kept[-1])
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"W{int(rng.zipf(1.4)) % 60}ing," if rng.random() < 0.5 else f"ö{rng.integers(9)}ed" for _ in range(rng.integers(0, 40)))) for i in range(60)]
    got = L.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2_000).collect()
    model = kept[0]
    tokens = {i: list(zip((t := L.Tokens([x.encode()])).hash.tolist(), t.code.tolist(), strict=True)) for i, x in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(h for i in train for h, _ in tokens[i])
    assert len(got) == 60 and len({r.score for r in got}) > 50
    for r in got:
        assert math.isclose(r.score, naive_score(model, tokens[r.doc_id], count), rel_tol=1e-4)
    # the weights, from observed and expected counts over all training texts at once
    again = L.Model.__new__(L.Model)
    again.__dict__.update(model.__dict__)
    t = L.Tokens([x.encode() for i, x in rows if i in train])
    observed, expected = again.observed(t.rows(again.word_rows), again.classes(t)), np.zeros(model.weights.shape)
    again.first_step(observed)
    again.expected(t.rows(again.word_rows), expected)
    again.next_step(observed, expected)
    assert L.ROUNDS == 1 and np.abs(again.weights - model.weights).max() < 1e-4


def test_scores_do_not_depend_on_partitions(spark, scored):
    rows, got = scored
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    base = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    for n in (1, 64):
        other = sorted((str(r.doc_id), r.n_tokens, r.score) for r in L.score_texts(docs.repartition(n), block_bytes=300_000).collect())
        assert [(a, b) for a, b in zip(base, other, strict=True) if a[:2] != b[:2] or abs(a[2] - b[2]) > 1e-4 * a[1]] == []


def test_words_of_many_blocks_are_summed_by_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the word {i % 9} of {i} the") for i in range(120)], "doc_id long, text string")
    want = sorted(map(tuple, L.score_texts(docs, block_bytes=100).collect()))
    monkeypatch.setattr(L, "GROUP_BLOCKS", 3)
    got = sorted(map(tuple, L.score_texts(docs, block_bytes=100).collect()))
    assert all(a[:6] == b[:6] and abs(a[6] - b[6]) < 1e-4 for a, b in zip(want, got, strict=True))


def test_no_training_rows_and_empty_table(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    got = L.score_texts(docs).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 3 and all(math.isfinite(r.score) for r in got)
    assert L.score_texts(docs.limit(0)).count() == 0

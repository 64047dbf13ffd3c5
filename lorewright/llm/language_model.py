"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class).  The most frequent tokens are classes of their own; the
other words are classed by their endings, and endings with like neighbours share a class (spectral clustering of
the counts of neighbouring endings).  P(class | context) is a softmax over hashed features: the word before (n-gram),
the endings of the two words before (bigram), and the endings two and three back (skips).  P(word | class) has
absolute discounting, whose mass goes to one slot of the class for unseen words.

Words are counted exactly over all training documents, in blocks of about BLOCK_BYTES of text: a block sends each of
its words once, gets the global counts back, and is scored with nothing but these.  A word that is in more than
GROUP_BLOCKS blocks is summed by groups of blocks, and each group gets its own copy of the sum.

Training is batch descent on the likelihood: every round sums a gradient over all training documents, in every task from
the same weights, and the sums meet in a tree.  The first round needs the observed counts of (feature, class) only,
since the model is still the same in every context; ROUNDS more take Newton steps along the diagonal.  Sums do not
depend on how documents lie in tasks, and so neither do weights and scores.  Word features are hashed into more rows the
more different words there are, from 2 ** 13 to 2 ** 15 (the table stands in every task and on the driver).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm.common import materialize, release, row_print, table, text_or_empty
from lorewright.llm.words import in_chunks, mixed, words_of

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 12 << 20
CODES, END_CODE = 1024, 1023
OWN_CLASS, ENDING_CLASSES = 16, 32
CLASSES = OWN_CLASS + ENDING_CLASSES
LEAST_WORD_ROWS, MOST_WORD_ROWS, PAIR_ROWS = 1 << 13, 1 << 15, 1 << 13
#: Where each feature's rows begin: word before, pair of endings, ending two back, ending three back.
ROWS_AT = (PAIR_ROWS + 2 * CODES, 0, PAIR_ROWS, PAIR_ROWS + CODES)
ROUNDS, BATCH = 1, 8192
#: The first step's length and prior tokens a row; the Newton steps' length, ridge and bound.
START, PRIOR, STEP, RIDGE, MOST_STEP = 0.4, 8.0, 0.5, 2.0, 1.0
GROUP_BLOCKS = 2_000
FAN_IN, PARTS = 32, 16
END = np.uint64(0x5EED0E0D)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


class Tokens:
    """Tokens of several texts, each closed by an end: hash, ending code, and the bounds of the texts."""

    def __init__(self, texts: list[bytes]) -> None:
        h, start, end, low, bounds = words_of(texts)
        # the last two bytes of the word before one closing sign; none is 0, so that a word has one code everywhere
        e = end.astype(np.int64)
        sign = low[e - 1] < 128 if len(e) else np.zeros(0, bool)
        if len(e):
            last = low[e - 1]
            sign &= ~(((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57)))
        e = e - sign
        a, b = (np.where(e - k >= start, low[np.maximum(e - k, 0)], 0).astype(np.uint64) if len(e) else np.zeros(0, np.uint64) for k in (1, 2))
        code = (mixed(a * np.uint64(256) + b) % np.uint64(END_CODE)).astype(np.int32)
        at = bounds[1:]
        self.hash = np.insert(h, at, END)
        self.code = np.insert(code, at, END_CODE)
        self.bounds = bounds + np.arange(len(bounds))

    def back(self, values: np.ndarray, k: int, fill) -> np.ndarray:
        """values k tokens back; before a text stand ends."""
        out = np.empty_like(values)
        out[:k] = fill
        out[k:] = values[: len(values) - k] if k < len(values) else values[:0]
        for j in range(k - 1):
            at = self.bounds[:-1] + j
            out[at[at < len(out)]] = fill
        return out

    def rows(self, word_rows: int = LEAST_WORD_ROWS) -> np.ndarray:
        """The four weight rows of every token's context."""
        word = (self.back(self.hash, 1, END) >> np.uint64(20)) % np.uint64(word_rows)
        one, two, three = (self.back(self.code, k, END_CODE) for k in (1, 2, 3))
        pair = mixed(one.astype(np.uint64) * np.uint64(CODES) + two.astype(np.uint64)) % np.uint64(PAIR_ROWS)
        return np.stack([word.astype(np.int64) + ROWS_AT[0], pair.astype(np.int64) + ROWS_AT[1], two.astype(np.int64) + ROWS_AT[2], three.astype(np.int64) + ROWS_AT[3]])


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _count_block(key: tuple, group: pa.Table) -> pa.Table:
    """Of a block: kind 0: each word's hash with its count in training texts; kind 1: pairs of neighbouring endings."""
    texts, held = texts_of(group.column("text")), group.column("held_out").to_numpy()
    seen, counted, code_of = [], [], []
    pairs = np.zeros(CODES * CODES, np.int64)
    for a, b in in_chunks(texts):
        t = Tokens(texts[a:b])
        train = np.repeat(~held[a:b], np.diff(t.bounds))
        u, first = np.unique(t.hash, return_index=True)
        seen.append(u)
        code_of.append(t.code[first])
        counted.append(t.hash[train])
        two = t.code.astype(np.int64) + CODES * t.back(t.code, 1, END_CODE)
        pairs += np.bincount(two[train], minlength=CODES * CODES)
    u, first = np.unique(np.concatenate(seen), return_index=True)
    code = np.concatenate(code_of)[first]
    known, n = np.unique(np.concatenate(counted), return_counts=True)
    count = np.zeros(len(u), np.int64)
    count[np.searchsorted(u, known)] = n
    two = np.flatnonzero(pairs)
    return pa.table(
        {
            "kind": np.r_[np.zeros(len(u), np.int8), np.ones(len(two), np.int8)],
            "key": np.r_[u.view(np.int64), two],
            "code": np.r_[code, np.zeros(len(two), np.int32)].astype(np.int16),
            "block": np.full(len(u) + len(two), key[0].as_py(), np.int64),
            "n": np.r_[count, pairs[two]],
        }
    )


def ending_classes(pairs: np.ndarray, classes: int = ENDING_CLASSES, seed: int = 1) -> np.ndarray:
    """A class for each ending code, from the counts of neighbouring codes (before, after)."""
    n = pairs.sum(axis=1) + pairs.sum(axis=0)
    both = np.concatenate([pairs, pairs.T], axis=1).astype(float)
    expected = np.outer(both.sum(axis=1), both.sum(axis=0)) / max(1.0, both.sum())
    lift = np.log((both + 1) / (expected + 1))
    u, s, _ = np.linalg.svd(lift, full_matrices=False)
    points = u[:, :12] * s[:12]
    weight = np.sqrt(n) + 1e-9
    rng = np.random.default_rng(seed)
    centres = points[[int(np.argmax(weight))]]
    while len(centres) < classes:
        far = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1) * weight + 1e-12
        centres = np.r_[centres, points[[rng.choice(len(points), p=far / far.sum())]]]
    for _ in range(25):
        own = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(classes):
            if (own == k).any():
                centres[k] = np.average(points[own == k], axis=0, weights=weight[own == k])
    return own


class Model:
    """What scoring needs besides the words' counts; of fixed size."""

    def __init__(self, tokens: int, types: int, top: np.ndarray, class_of: np.ndarray, stats: np.ndarray) -> None:
        """top: hashes of the tokens with a class of their own; stats: tokens, types, types seen once, twice by class."""
        self.tokens, self.types, self.class_of = tokens, types, class_of
        self.order = np.argsort(top)
        self.top = top[self.order]
        n, v, once, twice = stats.T.astype(float)
        self.discount = np.clip(np.where(once + 2 * twice > 0, once / np.maximum(1, once + 2 * twice), 0.5), 0.1, 0.9)
        self.discount[: len(top)] = 0.0
        with np.errstate(divide="ignore"):
            self.log_n = np.log10(np.maximum(n, 1))
            self.unseen = np.where(n > 0, np.log10(np.maximum(self.discount * v, 1e-9)) - self.log_n, 0.0)
        self.bias = np.log(np.maximum(n, 0.5) / max(1.0, n.sum())).astype(np.float32)
        self.word_rows = LEAST_WORD_ROWS
        while self.word_rows < min(MOST_WORD_ROWS, types // 8):
            self.word_rows *= 2
        self.weights = np.zeros((ROWS_AT[0] + self.word_rows, CLASSES), np.float32)

    def classes(self, t: Tokens) -> np.ndarray:
        own = (OWN_CLASS + self.class_of[t.code]).astype(np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, t.hash), len(self.top) - 1)
            hit = self.top[at] == t.hash
            own[hit] = self.order[at[hit]]
        return own

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = self.weights[rows[0]]
        for r in rows[1:]:
            out += self.weights[r]
        out += self.bias
        return out

    def class_scores(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 P(class | context) of every token."""
        out = np.empty(len(own))
        for a in range(0, len(own), BATCH):
            x = self.logits(rows[:, a : a + BATCH])
            top = x.max(axis=1)
            mine = x[np.arange(len(x)), own[a : a + BATCH]]
            np.exp(np.subtract(x, top[:, None], out=x), out=x)
            out[a : a + BATCH] = (mine - top - np.log(x.sum(axis=1))) / np.log(10)
        return out

    def word_scores(self, own: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(word | class) from the words' training counts."""
        seen = np.log10(np.maximum(count - self.discount[own], 1e-9)) - self.log_n[own]
        return np.where(count > 0, seen, self.unseen[own])

    def observed(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How often each row and class met."""
        out = np.zeros(self.weights.size)
        for r in rows:
            out += np.bincount(r * CLASSES + own, minlength=out.size)
        return out.reshape(self.weights.shape)

    def expected(self, rows: np.ndarray, into: np.ndarray) -> None:
        """Adds how often the model expects each row and class to meet."""
        for a in range(0, rows.shape[1], BATCH):
            part = rows[:, a : a + BATCH]
            # in the order of the word before: its rows need no sorting, and its weights are read along
            part = part[:, np.argsort(part[0].astype(np.uint16) if len(self.weights) <= 1 << 16 else part[0], kind="stable")]
            p = self.logits(part)  # steps are bounded, so no exponential overflows
            np.exp(p, out=p)
            p /= p.sum(axis=1, keepdims=True)
            for k, r in enumerate(part):
                if k:
                    order = np.argsort(r.astype(np.uint16), kind="stable")  # rows of endings are few
                    mine, q = r[order], p[order]
                else:
                    mine, q = r, p
                first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                into[mine[first]] += np.add.reduceat(q, first, axis=0)

    def first_step(self, observed: np.ndarray) -> None:
        """From classes alone to rows, which lean to the classes that they have met."""
        p = np.exp(self.bias.astype(float))
        p /= p.sum()
        met = observed.sum(axis=1, keepdims=True)
        self.weights = (START * np.log((observed + PRIOR * p) / ((met + PRIOR) * p))).astype(np.float32)

    def next_step(self, observed: np.ndarray, expected: np.ndarray) -> None:
        self.weights += np.clip(STEP * (observed - expected) / (expected + RIDGE), -MOST_STEP, MOST_STEP).astype(np.float32)


def _summed_rows(model: Model, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums over its texts, in PARTS pieces."""
        total, seen = np.zeros(model.weights.shape, np.float64 if first else np.float32), False
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in in_chunks(texts):
                t, seen = Tokens(texts[a:b]), True
                rows = t.rows(model.word_rows)
                if first:
                    total += model.observed(rows, model.classes(t))
                else:
                    model.expected(rows, total)
        if seen:
            parts = [p.astype(np.float32).tobytes() for p in np.array_split(total, PARTS)]
            task = np.full(PARTS, TaskContext.get().partitionId(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.arange(PARTS, dtype=np.int64)), pa.array(parts, pa.binary())], ["task", "part", "sums"])

    return run


def _added(key: tuple, group: pa.Table) -> pa.Table:
    rows = sorted(zip(group.column("task").to_pylist(), group.column("sums").to_pylist(), strict=True))
    total = sum(np.frombuffer(x, np.float32).astype(float) for _, x in rows)
    return pa.table({"task": [key[0].as_py()], "part": [key[1].as_py()], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _sums(model: Model, texts: DataFrame, first: bool) -> np.ndarray | None:
    """The sums over all texts, added in a tree of FAN_IN, so no task gathers many; None without texts."""
    schema = "task long, part long, sums binary"
    level = materialize(texts.mapInArrow(_summed_rows(model, first), schema), "sums")
    while True:
        most = level.agg(F.max("task")).first()[0]
        if most is None:
            return None
        above = materialize(level.withColumn("up", F.floor(F.col("task") / FAN_IN)).groupBy("up", "part").applyInArrow(_added, schema), "sums")
        release(level)
        level = above
        if most < FAN_IN:
            break
    got = {r.part: np.frombuffer(r.sums, np.float32) for r in level.collect()}  # a table of the weights' shape, once
    release(level)
    return np.concatenate([got[k] for k in range(PARTS)]).reshape(model.weights.shape).astype(float)


def train(model: Model, texts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The first step and rounds more; every one sums over all texts."""
    observed = _sums(model, texts, True)
    if observed is not None:
        model.first_step(observed)
        for _ in range(rounds):
            model.next_step(observed, _sums(model, texts, False))
    return model


def _scorer(model: Model):
    def run(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        known = counts.column("key").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, n = known[order], counts.column("c").to_numpy()[order]
        texts = texts_of(docs.column("text"))
        columns: list[list] = [[], [], [], []]
        floor = np.log10(model.tokens + model.types + 1.0)
        for a, b in in_chunks(texts):
            t = Tokens(texts[a:b])
            count = n[np.searchsorted(known, t.hash)]  # every token of the block is in its list
            own = model.classes(t)
            score = model.class_scores(t.rows(model.word_rows), own) + model.word_scores(own, count)
            at = t.bounds[:-1]
            for column, values in zip(columns, (np.diff(t.bounds), np.add.reduceat((count > 0).astype(np.int64), at), np.add.reduceat(np.log10(count + 1.0) - floor, at), np.add.reduceat(score, at)), strict=True):
                column.append(values)
        tokens, seen, base, score = (np.concatenate(c) for c in columns)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": tokens, "n_known": seen, "train_tokens": np.full(len(texts), model.tokens, np.int64), "base_score": base, "score": score})

    return run


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Trained on the rows outside the held-out fold.  A null text is empty and has one token, the end.  Without
    training rows every token is unseen and scores by the class softmax alone.  An empty table gives no rows.  Repeated
    rows count and score each for itself, a null doc_id is in the fold of the empty text.  A text longer than a block
    is read whole, in pieces.  Scores agree to float32 however docs is partitioned.  Other columns enter only the
    fingerprint that deals rows to blocks.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"), row_print(docs).alias("print"))
    total = slim.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    blocked = slim.select("doc_id", "held_out", "text", F.pmod(F.xxhash64("doc_id", "print"), F.lit(blocks)).alias("block"))
    counted = materialize(blocked.select("held_out", "text", "block").groupBy("block").applyInArrow(_count_block, "kind byte, key long, code short, block long, n long"), "counted")
    by_word, seen = Window.partitionBy("key"), counted.where("kind = 0")
    if blocks <= GROUP_BLOCKS:  # a key has a row a block at most
        words = seen.select("key", "code", "block", F.sum("n").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("block")) == 1).alias("first"))
        words = materialize(words, "words")
        once = words.where("first AND c > 0")
    else:
        seen = seen.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
        summed = seen.groupBy("key", "group").agg(F.sum("n").alias("n"), F.min("code").alias("g_code"))
        summed = summed.select(F.col("key").alias("g_key"), F.col("group").alias("g_group"), "g_code", F.sum("n").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("group")) == 1).alias("first"))
        summed = materialize(summed, "summed")
        words = materialize(seen.join(summed, (F.col("key") == F.col("g_key")) & (F.col("group") == F.col("g_group"))).select("key", "block", "c"), "words")
        once = summed.where("first AND c > 0").select(F.col("g_key").alias("key"), F.col("g_code").alias("code"), "c")
    top = [(r.key, r.code, r.c) for r in once.orderBy(F.desc("c"), "key").limit(OWN_CLASS).collect()]
    by_code = once.groupBy("code").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")
    ).collect()  # a row per code
    pairs = np.zeros(CODES * CODES, np.int64)
    got = counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # a row per pair of codes at most
    pairs[got.column("key").to_numpy()] = got.column("n").to_numpy()
    class_of = ending_classes(pairs.reshape(CODES, CODES))
    stats = np.zeros((CLASSES, 4), np.int64)
    for r in by_code:
        stats[OWN_CLASS + class_of[r.code]] += (r.n, r.v, r.once, r.twice)
    tokens, types = int(stats[:, 0].sum()), int(stats[:, 1].sum())
    for k, (_, code, n) in enumerate(top):
        stats[k] = (n, 1, n == 1, n == 2)
        stats[OWN_CLASS + class_of[code]] -= (n, 1, n == 1, n == 2)
    model = Model(tokens, types, np.array([k for k, *_ in top], np.int64).view(np.uint64), class_of, stats)
    release(counted)
    model = train(model, slim.where(~F.col("held_out")).select("text"), rounds)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(words.select("key", "c", "block").groupBy("block")).applyInArrow(_scorer(model), schema)


def op5_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))

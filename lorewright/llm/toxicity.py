"""Toxicity by a lexicon trie under Levenshtein automata, with context windows.

The lexicon holds whole terms and stems.  It is learned from labelled documents: words, and word beginnings that
many word forms share, which mark toxic documents far beyond chance; a short list of English insults stands
beside it.  Automaton and trie are intersected lazily into one deterministic machine: a state is a set of (trie
node, edits, pending swap, first letter edited), so most words leave it within a few letters and every misspelling within a term's
allowance is found.  Around each hit a window of words is read: quotation marks and words that mention rather
than use a term speak for quotation, address and further hits for abuse.  A logistic model over these features,
held near prior weights by its penalty, gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lorewright.llm.common import materialize, release, table

FOLDS = 5
#: The labelled rows that the lexicon and the weights are fitted on, at most: those of least hash.
MOST_TOXIC, MOST_CLEAN = 10_000, 20_000
#: Letters that a stem has at least, and word forms that must share it.
STEM_LETTERS, STEM_FORMS = 3, 5
WINDOW = 6
CACHE = 400_000
SEED_TERMS = (
    "idiot", "moron", "imbecile", "stupid", "retard", "scumbag", "scum", "loser", "worthless", "pathetic", "disgusting",
    "trash", "clown", "bastard", "bitch", "asshole", "dumbass", "shithead", "fucker", "motherfucker", "whore", "slut", "vermin", "degenerate",
)
SEED_WEIGHT = 4.0
MENTION = frozenset("word words term terms called calling quote quoted quotes said says wrote insult insults slur wort wörter genannt mot mots terme dit palabra término dijo".split())
ADDRESS = frozenset("you your you're yours u du dich dir ihr euch tu toi vous te usted ustedes eres vosotros".split())
QUOTES = "\"“”„«»‘’‹›"
FEATURES = ("bias", "strength", "hits", "quoted", "address", "density", "misspelled", "evidence")
PRIOR = np.array([-3.0, 0.9, 0.5, 0.1, 0.6, 0.1, -0.3, 0.5])
#: How much more often a word or a stem must be met in toxic documents than in clean ones.
WORD_LIFT, STEM_LIFT = 20.0, 5.0


def allowance(term: str, stem: bool) -> int:
    """Edits that a misspelling of a term may have."""
    if stem:
        return int(len(term) >= 8)
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Machine:
    """The deterministic machine of all words within the allowance of a lexicon's terms.

    An edit replaces, drops or adds a letter or swaps two neighbours; the first letter of a term of up to 5
    letters is never edited.
    """

    def __init__(self, lexicon: Iterable[tuple[str, bool, float]]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[bool, int, float]]] = [[]]
        self.most: list[int] = [0]
        self.far: list[int] = [0]  # the same of terms whose first letter may be edited
        self.depth: list[int] = [0]
        for term, stem, weight in lexicon:
            node, edits = 0, allowance(term, stem)
            far = edits if len(term) > 5 else -1
            for c in term:
                self.most[node] = max(self.most[node], edits)
                self.far[node] = max(self.far[node], far)
                below = self.children[node].get(c)
                if below is None:
                    below = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                    self.far.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.most[node] = max(self.most[node], edits)
            self.far[node] = max(self.far[node], far)
            self.ends[node].append((stem, edits, far, weight))
        self._reset()

    def _reset(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[float, int] | None] = []
        self.early: list[tuple[float, int] | None] = []
        self.start = self._state({(0, 0, "", False)})

    def _state(self, members: set) -> int:
        """Closed under dropped letters; edits beyond what a node's terms allow are left out."""
        stack, closed = list(members), set()
        while stack:
            item = stack.pop()
            node, edits, swap, first = item
            if item in closed or edits > (self.far if first else self.most)[node]:
                continue
            closed.add(item)
            if not swap:
                stack += [(below, edits + 1, "", first or not node) for below in self.children[node].values()]
        key = frozenset(closed)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            whole, early = None, None
            for node, edits, swap, first in key:
                for stem, most, far, weight in [] if swap else self.ends[node]:
                    if edits <= (far if first else most):
                        value = (weight * 0.8**edits, edits)
                        whole = max(whole, value) if whole else value
                        if stem:
                            early = max(early, value) if early else value
            self.final.append(whole)
            self.early.append(early)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, swap, first in self.states[state]:
            if swap:
                if swap == c:
                    out.add((node, edits, "", first))
                continue
            edited = first or not node
            for letter, below in self.children[node].items():
                if letter == c:
                    out.add((below, edits, "", first))
                else:
                    out.add((below, edits + 1, "", edited))
                    last = self.children[below].get(c)
                    if last is not None:
                        out.add((last, edits + 1, letter, edited))
            out.add((node, edits + 1, "", edited))
        return self._state(out)

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term that the word spells or misspells."""
        if len(self.states) > 200_000:
            self._reset()
        state, found = self.start, None
        for c in word:
            moves = self.moves[state]
            state = moves[c] if c in moves else moves.setdefault(c, self._move(state, c))
            if not self.states[state]:
                return found
            early = self.early[state]
            if early and (found is None or early > found):
                found = early
        whole = self.final[state]
        return max(found, whole) if found and whole else found or whole


class Reader:
    """Finds the hits of texts; words that were looked up before are kept."""

    def __init__(self, lexicon: list[tuple[str, bool, float]], innocent: frozenset[str] = frozenset()) -> None:
        machine = Machine(lexicon)

        class Known(dict):
            def __missing__(self, word: str):
                if len(self) > CACHE:
                    self.clear()
                core = word.strip("".join(c for c in set(word) if not c.isalnum()))
                self[word] = found = machine.match(core) if core and core not in innocent else None
                return found

        self.known = Known()

    def features(self, text: str | None) -> list[float]:
        """The document's FEATURES; without hits only the bias."""
        words = (text or "").lower().split()
        look = self.known.__getitem__
        hits = [(i, m) for i, m in enumerate(map(look, words)) if m]
        row = [1.0] + [0.0] * (len(FEATURES) - 1)
        if not hits:
            return row
        at = {i for i, _ in hits}
        used = quoted = address = wrong = 0
        strength = evidence = 0.0
        for i, (weight, edits) in hits:
            low, high = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            if self._is_quoted(words, i, low, high):
                quoted += 1
                continue
            used += 1
            wrong += edits > 0
            strength = max(strength, weight)
            evidence += weight
            address += any(w.strip(".,;:!?") in ADDRESS or (k != i and k in at) for k, w in enumerate(words[low:high], low))
        return [1.0, strength, math.log1p(used), math.log1p(quoted), math.log1p(address), math.log1p(100 * used / len(words)), wrong / max(1, used), math.log1p(evidence)]

    @staticmethod
    def _is_quoted(words: list[str], i: int, low: int, high: int) -> bool:
        own = words[i]
        if own[0] in QUOTES and own.rstrip(".,;:!?")[-1] in QUOTES:
            return True
        opened = any(w[0] in QUOTES and w.rstrip(".,;:!?")[-1] not in QUOTES for w in words[low : i + 1])
        closed = any(w.rstrip(".,;:!?")[-1:] in tuple(QUOTES) and w[0] not in QUOTES for w in words[i:high])
        mention = any(w.strip(".,;:!?\"'") in MENTION for w in words[max(low, i - 3) : i])
        return (opened and closed) or mention


def _tail(t: int, n: int, p: float) -> float:
    """log of a bound on the chance of t or more of n at rate p."""
    if n == 0 or t / n <= p:
        return 0.0
    q = t / n
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))


def shared_beginnings(words: Iterable[str]) -> set[str]:
    """Beginnings of any length that STEM_FORMS words or more share, and at which some of them part."""
    ordered, found = sorted(set(words)), set()
    for x, y in zip(ordered, ordered[STEM_FORMS - 1 :], strict=False):  # the first and last of so many neighbours
        n = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        found |= {x[:k] for k in range(STEM_LETTERS, n + 1)}
    return found


def learn_lexicon(counts: Iterable[tuple[str, str, int, int]], toxic: int, clean: int, tried: int) -> list[tuple[str, bool, float]]:
    """(term, is a stem, weight) from (kind, string, toxic documents, clean documents); kind w: word, p: beginning.

    A string counts if chance, over all strings tried, hardly explains it.  A beginning counts as a stem if many
    word forms share it and none makes up most of its documents.
    """
    if not toxic or not clean:
        return []
    rate, limit = toxic / (toxic + clean), math.log(0.05 / max(1, tried))
    good: dict[str, dict[str, tuple[int, int]]] = {"w": {}, "p": {}}
    words: dict[str, int] = {}
    for kind, x, t, c in counts:
        lift = WORD_LIFT if kind == "w" else STEM_LIFT
        if t >= 3 and t * clean >= lift * c * toxic and _tail(t, t + c, rate) <= limit:
            good[kind][x] = (t, c)
        if kind == "w":
            words[x] = t
    forms: dict[str, list[int]] = {}
    lengths = sorted({len(x) for x in good["p"]})
    for x, t in words.items():
        for k in lengths:
            if k <= len(x) and x[:k] in good["p"]:
                forms.setdefault(x[:k], []).append(t)
    weight = lambda t, c: min(8.0, math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)))
    stems: dict[str, tuple[int, int]] = {}
    # the least likely first; of nested beginnings with the same documents the longest
    for x in sorted(good["p"], key=lambda x: (_tail(good["p"][x][0], sum(good["p"][x]), rate), -len(x), x)):
        own = forms.get(x, [])
        related = any(x[:k] in stems for k in range(STEM_LETTERS, len(x))) or any(s.startswith(x) for s in stems)
        if not related and len(own) >= STEM_FORMS and max(own) <= 0.6 * good["p"][x][0]:
            stems[x] = good["p"][x]
    whole = {x: n for x, n in good["w"].items() if len(x) >= 3}  # beside their stems, for misspelled beginnings
    found = [(x, True, weight(*n)) for x, n in stems.items()] + [(x, False, weight(*n)) for x, n in whole.items()]
    return sorted(found, key=lambda x: (-x[2], x[0]))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's 3-word shingles: copies and near copies mostly share it."""
    for batch in batches:
        sketch = []
        for text in batch.column("text"):
            words = (text.as_py() or "").lower().split()
            grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
            sketch.append(min(xxh64_intdigest(g) for g in grams) >> 1)
        yield batch.append_column("sketch", pa.array(sketch, pa.int64()))


def _words(text: str | None) -> set[str]:
    words = {w.strip("".join(c for c in set(w) if not c.isalnum())) for w in (text or "").lower().split()}
    words.discard("")
    return words


def _counter(kind: str, strings):
    """Counts the groups (sketch, toxic) in which each of strings(words) is met; rows come sorted by group, which may run over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, group, words = (Counter(), Counter()), None, set()
        for batch in batches:
            for text, sketch, toxic in zip(batch.column("text"), batch.column("sketch").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if group != (sketch, toxic):
                    if group:
                        seen[bool(group[1])].update(strings(words))
                    group, words = (sketch, toxic), set()
                words |= _words(text.as_py())
        if group:
            seen[bool(group[1])].update(strings(words))
        keys = list({**seen[0], **seen[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())],
            ["kind", "x", "t", "c"],
        )

    return run


def _counted(texts: DataFrame, kind: str, strings) -> DataFrame:
    dealt = texts.repartition("sketch").sortWithinPartitions("sketch", "toxic")
    counted = dealt.mapInArrow(_counter(kind, strings), "kind string, x string, t long, c long")
    return materialize(counted.groupBy("kind", "x").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "words")


def _innocent_words(counted: DataFrame, lexicon: list[tuple[str, bool, float]], toxic: int, clean: int) -> list[str]:
    """Words that a whole term matches but clean documents use as well; bounded by the sample's words."""
    whole = [x for x in lexicon if not x[1]]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(whole)
        for batch in batches:
            yield batch.filter(pa.array([machine.match(x.as_py()) is not None for x in batch.column("x")], pa.bool_())).select(["x"])

    used = counted.where("kind = 'w' AND c > 0").where(F.col("t") * clean < F.col("c") * toxic * STEM_LIFT)
    return sorted(r.x for r in used.select("x").mapInArrow(near, "x string").collect())


def fit(features: np.ndarray, toxic: np.ndarray, shares: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic weights with a squared penalty on the distance from PRIOR, by Newton's method; a row counts by its share."""
    w = PRIOR.copy()
    for _ in range(50 if len(toxic) else 0):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (shares * (p - toxic)) + penalty * (w - PRIOR)
        step = np.linalg.solve((features * (shares * p * (1 - p))[:, None]).T @ features + penalty * np.eye(len(w)), grad)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Model:
    """A lexicon, innocent words near it, and weights; small enough to be sent with a task."""

    def __init__(self, lexicon: list[tuple[str, bool, float]], innocent: frozenset[str], weights: np.ndarray) -> None:
        self.lexicon, self.innocent, self.weights = lexicon, innocent, weights

    def scorer(self):
        reader, weights = Reader(self.lexicon, self.innocent), self.weights
        empty = 1 / (1 + math.exp(-weights[0]))

        def score(text: str | None) -> float:
            row = reader.features(text)
            if row[2] == 0.0 and row[3] == 0.0:
                return empty
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(row, weights))))))

        return score


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents outside the held-out fold; without labels the seed terms and prior weights stay.

    A document with several labels is toxic if one says so; null labels are no labels.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = own.where("toxic = 1").orderBy(order).limit(MOST_TOXIC).unionByName(own.where("toxic = 0").orderBy(order).limit(MOST_CLEAN))
    ids = F.broadcast(picked.withColumnRenamed("doc_id", "__id"))  # MOST_TOXIC + MOST_CLEAN rows of 12 bytes
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, F.col("doc_id") == F.col("__id"))
    sketched = materialize(labelled.select("text", "toxic").mapInArrow(_sketched, "text string, toxic int, sketch long"), "sketched")
    # copies count together as one, or their other words would count as marks; all texts of the sample are read
    groups = sketched.groupBy(F.col("sketch").alias("g_sketch"), F.col("toxic").alias("g_toxic")).agg((1 / F.count(F.lit(1))).alias("share"))
    texts = sketched.join(groups, (F.col("sketch") == F.col("g_sketch")) & (F.col("toxic") == F.col("g_toxic"))).select("text", "toxic", "sketch", "share")
    texts = materialize(texts, "labelled")
    release(sketched)
    size = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count_distinct("sketch").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    counted = _counted(texts, "w", lambda words: words)
    # words and beginnings of three of the MOST_TOXIC documents at least
    marks = lambda table: [(r.kind, r.x, r.t, r.c) for r in table.where(F.col("t") >= 3).where(F.col("t") * clean >= F.col("c") * toxic * STEM_LIFT).collect()]
    rows = marks(counted)
    begun = shared_beginnings(x for _, x, *_ in rows)
    lengths = sorted({len(x) for x in begun})
    beginnings = _counted(texts, "p", lambda words: {w[:k] for w in words for k in lengths if k <= len(w) and w[:k] in begun})
    learned = learn_lexicon([*rows, *marks(beginnings)], toxic, clean, counted.where("t + c >= 3").count() + len(begun))
    have = {x for x, *_ in learned}
    lexicon = learned + [(x, False, SEED_WEIGHT) for x in SEED_TERMS if x not in have]

    innocent = frozenset(_innocent_words(counted, lexicon, toxic, clean))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon, innocent)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reader.features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64())), batch.column("toxic"), batch.column("share")], ["f", "toxic", "share"])

    got = texts.mapInArrow(featured, "f array<double>, toxic int, share double").groupBy("f", "toxic").agg(F.sum("share").alias("share")).collect()  # MOST_TOXIC + MOST_CLEAN rows
    got = sorted((tuple(r.f), r.toxic, r.share) for r in got)
    features = np.array([f for f, *_ in got]).reshape(-1, len(FEATURES))
    release(texts, counted, beginnings)
    return Model(lexicon, innocent, fit(features, np.array([t for _, t, _ in got], float), np.array([n for *_, n in got], float)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null texts score like empty ones; texts are read whole, however long.  Equal texts have equal scores, repeated rows and
    rows with a null doc_id are scored each.  An empty table gives no rows.  Only doc_id and text are read.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            values = [score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, all columns."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([score(t.as_py()) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))

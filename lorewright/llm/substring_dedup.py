"""Substring dedup: paragraphs by MinHash banding, and passages inside paragraphs by content-defined windows.

A paragraph is a line of LEAST_WORDS words or more; shorter lines of SHINGLE words or more are kind "line".  Consecutive
shorter lines, up to a blank or a longer line, are together a "block" as well, so hard-wrapped paragraphs meet each
other and their unwrapped copies.  The 5-word shingles of each have a MinHash signature; those that share a band collide
and are compared there, band by band: the exact Jaccard similarity of every colliding pair decides (pairs that are
already connected are skipped).  BANDS bands of BAND_ROWS hashes miss a pair at similarity 0.8 with a chance below 1 %.

A band is compared in slices of at most SLICE_ROWS contents and about SLICE_BYTES of shingles, each together with the
band's first content, so a mass of near copies connects in one linear pass.  Where a band of several slices is still in
several components, all its contents but those of its largest component meet every slice once more.

A passage that was pasted into the middle of a paragraph leaves no similar paragraph.  For it, every window of
WINDOW shingles marks its least hash (the MinHash of the window), and the SPAN words from there are a unit too:
any SPAN + WINDOW - 1 = 31 words that two texts share hold a unit that is the same in both.  A unit that repeats is
then extended, word by word, as far as it agrees with an earlier unit of its class (REACH words on each side: the
next unit of the shared run is never further away), so the spans of a run cover all of it.  Runs under LEAST_WORDS
words are no passages.  Words of these surroundings are compared by 32-bit hashes.

Units are equal if two independent 64-bit hashes over their words agree.  They are handled as contents: equal units are
one content, counted with map-side sums, so a passage that a third of all documents share is one candidate.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm.common import materialize, release, table, text_or_empty
from lorewright.llm.words import in_chunks, mixed, words_of
from lorewright.operators.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
LEAST_WORDS = 20
PARAGRAPH, PASSAGE, LINE, BLOCK = range(4)
BANDS, BAND_ROWS = 7, 3
#: Marks are at most WINDOW shingles apart, so the units of a run touch.
WINDOW, SPAN = 16, 16
#: Words on each side of a unit that a shared run can go on without another unit.
REACH = WINDOW - 1
#: A slice of a band: contents, and bytes of their shingles (a longer content is alone in excess).
SLICE_ROWS, SLICE_BYTES = 500, 4 << 20
#: Shingle sets over so many elements are intersected as arrays.
LARGE_SET = 50_000
CLASS_ROWS = 2_000
#: Units whose surroundings are cut at a time.
UNIT_ROWS = 20_000
#: Places in a unit whose hashes are kept.
PLACES = 1 << 14
_REACHED = struct.Struct("=i").unpack_from
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_OTHER = np.uint64(0x27D4EB2F165667C5)
_ODD = np.random.default_rng(7).integers(1, 1 << 62, (BANDS * BAND_ROWS, 2)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hash of every size neighbouring words."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def _sliding(x: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """pick over x[i : i + width] for every i; beyond the end stands fill."""
    x = np.concatenate([x, np.full(width, fill, x.dtype)])
    done = 1
    while 2 * done <= width:
        x = pick(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return (pick(x[: len(x) - rest], x[rest:]) if rest else x)[: len(x)]


@cache
def _places(salt: int) -> np.ndarray:
    """What the first PLACES places of a unit are mixed to."""
    return mixed(np.arange(PLACES, dtype=np.uint64) + np.uint64(salt))


class Units:
    """Lines and windows of several texts."""

    def __init__(self, texts: list[bytes]) -> None:
        h, start, end, low, bounds = words_of(texts)
        self.lines: tuple | None = None
        self.windows: tuple | None = None
        if not len(h):
            return
        points = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        zero = points[np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])]
        line = np.searchsorted(np.flatnonzero(low == 10), start)
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        size = np.diff(np.r_[first, len(h)])
        sh = shingles(h)
        # lines of a block are neighbours, short and of one text
        short = size < LEAST_WORDS
        line, own = line[first], doc[first]
        joined = np.r_[False, short[1:] & short[:-1] & (line[1:] == line[:-1] + 1) & (own[1:] == own[:-1])]
        head = np.flatnonzero(~joined)
        lines = np.diff(np.r_[head, len(first)])
        total = np.add.reduceat(size, head)
        block = np.repeat(np.arange(len(head)), lines)
        several = (lines > 1) & (total >= SHINGLE)
        contents = self._contents(h, first[head], total)
        again = self._contents(h, first[head], total, _OTHER)
        parts = []
        if (size >= SHINGLE).any():
            pick = size >= SHINGLE
            content, check = self._contents(h, first, size)[pick], self._contents(h, first, size, _OTHER)[pick]
            # a line within a block knows it: both in one class are one place
            within = np.where(several[block], contents[block].view(np.int64), 0)[pick]
            parts.append((np.where(short, LINE, PARAGRAPH)[pick], first[pick], size[pick], content, within, several[block][pick], check))
        if several.any():
            n = int(several.sum())
            parts.append((np.full(n, BLOCK), first[head][several], total[several], contents[several], np.zeros(n, np.int64), np.zeros(n, bool), again[several]))
        if parts:
            bands = np.concatenate([self._bands(sh, p[1], p[2]) for p in parts], axis=1)
            form, a, n, content, within, inside, check = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.lines = (content, check, doc[a], points[start[a]] - zero[doc[a]], points[end[a + n - 1]] - zero[doc[a]], n, a - bounds[doc[a]], bands, form, within, inside)
        x = sh.copy()
        if len(x):
            x[doc[: len(x)] != doc[SHINGLE - 1 :]] = _MAX  # over the end of a text
            full = np.zeros(len(x), bool)
            k = len(x) - WINDOW + 1
            if k > 0:
                full[:k] = doc[:k] == doc[WINDOW + SHINGLE - 2 :][:k]
            least = np.where(full, _sliding(x, WINDOW, np.minimum, _MAX)[: len(x)], np.uint64(0))
            # a shingle is marked if it is the least of some window that covers it
            cover = _sliding(least[::-1], WINDOW, np.maximum, np.uint64(0))[: len(x)][::-1]
            at = np.flatnonzero((cover == x) & (x != _MAX))
            at = at[at + SPAN <= len(h)]
            at = at[doc[at] == doc[at + SPAN - 1]]
            if len(at):
                what, check = np.zeros(len(at), np.uint64), np.full(len(at), _OTHER)
                for k in range(SPAN):
                    word = h[at + k]
                    what = mixed(what * np.uint64(0x9E3779B97F4A7C15) + word)
                    check = (check ^ word) * np.uint64(0xC2B2AE3D27D4EB4F)
                    check ^= check >> np.uint64(29)
                # one unit for all steps of a repeated word
                new = np.flatnonzero(np.r_[True, (what[1:] != what[:-1]) | (doc[at][1:] != doc[at][:-1]) | (at[1:] != at[:-1] + 1)])
                last = at[np.r_[new[1:], len(at)] - 1] + SPAN - 1
                at, what, check = at[new], what[new], check[new]
                self.windows = (what, check, doc[at], points[start[at]] - zero[doc[at]], points[end[last]] - zero[doc[at]], last - at + 1, at - bounds[doc[at]])

    @staticmethod
    def _contents(h: np.ndarray, first: np.ndarray, size: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
        """The hash of the size words from first on; the units together are all words, in order."""
        place = np.arange(len(h)) - np.repeat(first, size)
        spread = _places(int(salt))[place] if size.max() <= PLACES else mixed(place.astype(np.uint64) + salt)
        return np.add.reduceat(mixed(h + spread), first)

    @staticmethod
    def _bands(sh: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """BANDS x units: the band hashes of the shingles inside each unit (of SHINGLE words or more, apart, in order)."""
        n = size - SHINGLE + 1
        cut = np.cumsum(n) - n
        x = sh[np.arange(int(n.sum())) + np.repeat(first - cut, n)]
        least, held = np.empty((len(_ODD), len(first)), np.uint64), np.empty_like(x)
        for k, (a, b) in enumerate(_ODD):  # shingles are mixed already
            np.multiply(x, a, out=held)
            held += b
            np.minimum.reduceat(held, cut, out=least[k])
        bands = np.zeros((BANDS, len(first)), np.uint64)
        for k in range(BANDS):
            for m in least[k * BAND_ROWS : (k + 1) * BAND_ROWS]:
                bands[k] = mixed(bands[k] * np.uint64(31) + m + np.uint64(k))
        return bands


def _listed(column: pa.Array) -> list:
    """Python values of a column; those without nulls go by numpy, which takes a tenth of the time."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "content", "check", "doc_id", "print", "start", "stop", "words", "word", "bands", "form", "within"]
    for batch in batches:
        texts, ids, prints = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], batch.column("doc_id"), batch.column("print")
        for a, b in in_chunks(texts):
            found = Units(texts[a:b])
            for kind, unit in enumerate((found.lines, found.windows)):
                if unit is None:
                    continue
                n = len(unit[0])
                if kind == 0:
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * n + 1, BANDS, dtype=np.int32)), pa.array(unit[7].T.reshape(-1).view(np.int64)))
                    more = [pa.array(unit[8].astype(np.int8)), pa.array(unit[9], mask=~unit[10])]
                else:
                    bands = pa.nulls(n, pa.list_(pa.int64()))
                    more = [pa.array(np.full(n, PASSAGE, np.int8)), pa.nulls(n, pa.int64())]
                hashes = [pa.array(x.view(np.int64)) for x in unit[:2]]
                owner = pa.array(unit[2] + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, kind, np.int8)), *hashes, *[x.take(owner) for x in (ids, prints)], *[pa.array(x.astype(np.int32)) for x in unit[3:7]], bands, *more], names
                )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted distinct shingles of the wanted lines of each text; lines of about 1 MB are read together."""
    for batch in batches:
        pieces, contents = [], []
        for text, lines in zip(batch.column("text"), batch.column("lines"), strict=True):
            said = text.as_py() or ""
            for line in lines.as_py():
                piece = said[line["start"] : line["stop"]].encode()
                if piece.split(None, 1):  # else the text only shares its fingerprint with the one wanted
                    pieces.append(piece)
                    contents.append(line["content"])
        for a, b in in_chunks(pieces):
            h, _, _, _, bounds = words_of(pieces[a:b])
            size = np.diff(bounds)
            same = (Units._contents(h, bounds[:-1], size).view(np.int64) == np.array(contents[a:b], np.int64)) & (size >= SHINGLE)
            sh = shingles(h)
            known = [k for k in range(b - a) if same[k]]
            sets = [np.unique(sh[bounds[k] : bounds[k + 1] - SHINGLE + 1]).tobytes() for k in known]
            yield pa.RecordBatch.from_arrays([pa.array([contents[a + k] for k in known], pa.int64()), pa.array(sets, pa.binary())], ["content", "shingles"])


_AROUND = pa.schema(
    [("content", pa.int64()), ("check", pa.int64()), ("side", pa.int8()), ("first", pa.int64()), ("context", pa.binary()), ("ends", pa.binary()), ("none", pa.bool_()),
     ("doc_id", pa.int64()), ("print", pa.int64()), ("start", pa.int32()), ("kept", pa.bool_()), ("again", pa.bool_()), ("settled", pa.bool_())]
)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each wanted side of each unit of a text: hashes of the next REACH words, and their ends in code points from the unit.

    Of equal surroundings that a task meets together only those of the earliest place (and of a kept one) need others: the
    rest share them in full with that one, and are settled.  So what a third of all texts share is a few rows a task.
    """

    def combined(rows: list[list]) -> pa.RecordBatch:
        best: dict[tuple, list] = {}
        for row in rows:
            key = (row[0], row[1], row[2], row[4])
            other = best.setdefault(key, row)
            if other is row:
                continue
            early, late = (row, other) if row[6:10] < other[6:10] else (other, row)
            best[key] = early
            early[11] = True
            if late[10]:
                late[11] = True
            else:
                late[12], late[3] = True, late[8]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _AROUND, strict=True)], schema=_AROUND)

    rows: list[list] = []
    for batch in batches:
        texts, prints, lists = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], batch.column("print").to_numpy(), batch.column("units")
        each, units = lists.value_lengths().to_numpy(), lists.flatten()
        bounds = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        for a, b in in_chunks(texts):
            words = _Places(texts[a:b])
            for k in range(bounds[a], bounds[b], UNIT_ROWS):
                if len(rows) > 50_000:
                    yield combined(rows)
                    rows = []
                n = min(UNIT_ROWS, bounds[b] - k)
                rows += words.around(units.slice(k, n), np.repeat(np.arange(b - a), each[a:b])[k - bounds[a] :][:n], prints[a:b])
    if rows:
        yield combined(rows)


class _Places:
    """Where the words of several texts stand, for the surroundings of their units."""

    def __init__(self, texts: list[bytes]) -> None:
        h, start, end, low, self.bounds = words_of(texts)
        points = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
        self.zero = points[np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])]
        self.begin, self.stop, self.small = points[start], points[end], (h >> np.uint64(32)).astype(np.uint32)

    def around(self, units: pa.StructArray, doc: np.ndarray, prints: np.ndarray) -> list[list]:
        """Rows of _surroundings; doc: which of the texts a unit is in, prints: theirs."""
        field = lambda name: units.field(name).to_numpy(zero_copy_only=False)
        ids, held, out = _listed(units.field("doc_id")), [field(x) for x in ("content", "check", "start", "kept")], []
        first = field("word") + self.bounds[doc]
        after = first + field("words")
        sides = (
            (field("left"), first - 1, -1, first - self.bounds[doc], self.begin, field("start"), -1),
            (field("right"), after, 1, self.bounds[doc + 1] - after, self.stop, field("stop"), 1),
        )
        for side, (wanted, nearest, step, room, edge, own, sign) in enumerate(sides):
            pick = np.flatnonzero(wanted & (room > 0))
            if not len(pick):
                continue
            at = np.clip(nearest[pick][:, None] + step * np.arange(REACH), 0, len(self.small) - 1)
            size, words = 4 * np.minimum(REACH, room[pick]), self.small[at]
            ends = sign * (edge[at] - (self.zero[doc[pick]] + own[pick])[:, None])
            said, reached, row = words.tobytes(), ends.astype(np.int32).tobytes(), 4 * REACH
            columns = [x.tolist() for x in (*(x[pick] for x in held), prints[doc[pick]], words[:, 0])]
            for k, (u, n, content, check, start, kept, print_, word) in enumerate(zip(pick.tolist(), size.tolist(), *columns, strict=True)):
                out.append([content, check, side, word, said[k * row : k * row + n], reached[k * row : k * row + n], ids[u] is None, ids[u] or 0, print_, start, kept, False, False])
        return out


def shared_lengths(contexts: list[bytes], places: list[tuple], kept: list[bool]) -> list[int]:
    """Words that each context has in common, from its start, with one of an earlier place; kept ones: with any other.

    Contexts come sorted.  The most is shared with the nearest context of an earlier place above or below, and it is
    the least of the steps between.
    """
    n = len(contexts)
    words = [np.frombuffer(c, np.uint32) for c in contexts]
    step = [0] * (n + 1)  # words in common with the context before
    for k in range(1, n):
        if contexts[k] == contexts[k - 1]:
            step[k] = len(words[k])
        else:
            m = min(len(words[k]), len(words[k - 1]))
            differ = np.flatnonzero(words[k][:m] != words[k - 1][:m])
            step[k] = int(differ[0]) if len(differ) else m
    out = [0] * n
    for back in (False, True):
        stack: list[tuple[int, int]] = []  # (index, words in common with the one below), places rise
        for k in range(n - 1, -1, -1) if back else range(n):
            common = step[k + 1] if back else step[k]
            while stack and places[stack[-1][0]] >= places[k]:
                common = min(common, stack.pop()[1])
            if stack:
                out[k] = max(out[k], common)
            stack.append((k, common))
    return [max(step[k], step[k + 1]) if kept[k] else out[k] for k in range(n)]


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far units extend.  Rows come sorted by (content, check, side, first word, context), and a group may run over batches."""
    names, kinds = ["print", "content", "check", "start", "side", "more", "reach"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.int32(), pa.int32()]

    def found(row: tuple, n: int) -> tuple:
        return (row[8], row[0], row[1], row[9], row[2], n, _REACHED(row[5], 4 * (n - 1))[0])

    def lengths() -> list[int]:
        places = [r[6:10] for r in rows]
        if rows[0][4] == rows[-1][4]:  # all are equal
            earliest = places.index(min(places))
            return [len(r[4]) // 4 if k != earliest or r[10] else 0 for k, r in enumerate(rows)]
        return shared_lengths([r[4] for r in rows], places, [r[10] for r in rows])

    def close() -> None:
        if len(rows) > 1:
            # a kept place with equal surroundings in its own task shares them all
            shared = [len(r[4]) // 4 if r[10] and r[11] else n for r, n in zip(rows, lengths(), strict=True)]
            ready.extend(found(r, n) for r, n in zip(rows, shared, strict=True) if n)
        elif rows and rows[0][10] and rows[0][11]:
            ready.append(found(rows[0], len(rows[0][4]) // 4))

    key, rows, ready = None, [], []
    for batch in batches:
        for row in zip(*map(_listed, batch.columns), strict=True):
            if row[12]:
                ready.append(found(row, len(row[4]) // 4))
                continue
            if key != row[:4]:
                close()
                key, rows = row[:4], []
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in ready], kind) for k, kind in enumerate(kinds)], names)
        ready = []
    close()
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in ready], kind) for k, kind in enumerate(kinds)], names)


def _extended(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """passages with start, stop and words extended to the run that each shares with an earlier unit of its class; runs
    of LEAST_WORDS words or more stay."""
    parts = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # surroundings are wanted of a class if somewhere its neighbours leave words between
    row = Window.partitionBy("print", "kept").orderBy("start")
    shares = F.ceil(F.col("class_size") / CLASS_ROWS)
    gaps = passages.select(
        shares.alias("shares"),
        "class_id",
        "class_check",
        F.coalesce(F.lag(F.col("word") + F.col("words")).over(row) < F.col("word"), F.lit(True)).alias("left"),
        F.coalesce(F.lead("word").over(row) > F.col("word") + F.col("words"), F.lit(True)).alias("right"),
    )
    wanted = gaps.groupBy(F.col("class_id").alias("g_class"), F.col("class_check").alias("g_check")).agg(F.max("left").alias("left"), F.max("right").alias("right"), F.max("shares").alias("g_shares"))
    # places of a frequent class meet its row in shares of CLASS_ROWS
    wanted = wanted.where("left OR right").withColumn("g_share", F.explode(_upto("g_shares")))
    share = F.pmod(F.xxhash64("print", "start"), shares)
    units = passages.withColumn("share", share).join(wanted.hint("shuffle_hash"), (F.col("class_id") == F.col("g_class")) & (F.col("class_check") == F.col("g_check")) & (F.col("share") == F.col("g_share")))
    unit = F.struct(F.col("class_id").alias("content"), F.col("class_check").alias("check"), "doc_id", "start", "stop", "words", "word", "kept", "left", "right")
    units = units.groupBy(F.col("print").alias("u_print")).agg(F.collect_set(unit).alias("units"))
    texts = docs.join(units.hint("shuffle_hash"), F.col("print") == F.col("u_print")).select("text", "print", "units")
    around = texts.mapInArrow(_surroundings, "content long, check long, side byte, first long, context binary, ends binary, none boolean, doc_id long, print long, start int, kept boolean, again boolean, settled boolean")
    # units whose next words differ share nothing there, so the next word deals a frequent passage out
    dealt = around.repartition(parts, "content", "check", "side", "first").sortWithinPartitions("content", "check", "side", "first", "context")
    extents = dealt.mapInArrow(_extents, "print long, content long, check long, start int, side byte, more int, reach int")
    side = lambda value, k: F.max(F.when(F.col("side") == k, F.col(value)).otherwise(0))
    extents = extents.groupBy(F.col("print").alias("e_print"), F.col("content").alias("e_class"), F.col("check").alias("e_check"), F.col("start").alias("e_start")).agg(
        side("reach", 0).alias("e_left"), side("reach", 1).alias("e_right"), side("more", 0).alias("e_before"), side("more", 1).alias("e_after")
    )
    extents = materialize(extents, "extents")
    same = (F.col("print") == F.col("e_print")) & (F.col("class_id") == F.col("e_class")) & (F.col("class_check") == F.col("e_check")) & (F.col("start") == F.col("e_start"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    grown = (
        passages.join(extents.hint("shuffle_hash"), same, "left").withColumn("start", F.col("start") - zero("e_left")).withColumn("stop", F.col("stop") + zero("e_right"))
        .withColumn("words", F.col("words") + zero("e_before") + zero("e_after")).withColumn("word", F.col("word") - zero("e_before")).select(*passages.columns)
    )
    # units of a text that touch or overlap are one run
    along = Window.partitionBy("print", "kept").orderBy("word", "words", "class_id", "class_check")
    over = F.max(F.col("word") + F.col("words")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = grown.withColumn("run", F.sum(F.when(over >= F.col("word"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy("print", "kept", "run")
    length = F.max(F.col("word") + F.col("words")).over(run) - F.min("word").over(run)
    return runs.withColumn("length", length).where(F.col("length") >= LEAST_WORDS).select(*passages.columns)


def _similar(a: frozenset | np.ndarray, b: frozenset | np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    if isinstance(a, frozenset) and isinstance(b, frozenset):
        both = len(a & b)
    else:
        both = len(np.intersect1d(np.fromiter(a, np.int64, len(a)), np.fromiter(b, np.int64, len(b)), assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def similar_links(members: list[tuple[int, int | None, int, frozenset | np.ndarray]], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links whose components are those of all pairs of at least that Jaccard similarity.

    members: (content, side, component so far, shingles).  Sides 0 and 1 meet each other only; None meets all.
    """
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = i = root.setdefault(root[i], root[i])
        return i

    out = []
    for i, (content, side, component, own) in enumerate(members):
        for other, other_side, other_component, shingles_ in members[:i]:
            if side is not None and side == other_side or find(component) == find(other_component):
                continue
            if _similar(own, shingles_, similarity):
                root[find(component)] = find(other_component)
                out.append((content, other))
    return out


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, content, side, component, shingles) come sorted by (band, i, j), and a slice may run over batches."""
    key, members, links = None, [], []

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    for batch in batches:
        for band, i, j, content, side, component, raw in zip(*map(_listed, batch.columns), strict=True):
            if key != (band, i, j):
                links += similar_links(members)
                key, members = (band, i, j), []
            own = np.frombuffer(raw, np.int64)
            members.append((content, side, component, own if len(own) > LARGE_SET else frozenset(own.tolist())))
        # most slices are pairs: their links leave together
        yield found()
        links = []
    links += similar_links(members)
    yield found()


def _verified(dealt: DataFrame, parts: int) -> DataFrame:
    dealt = dealt.select("band", "i", "j", "content", "side", "component", "shingles")
    return dealt.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_verifier, "a long, b long")


def _slices(rows: str, size: str) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.col(rows) / SLICE_ROWS), F.ceil(F.col(size) / SLICE_BYTES))


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def _near_contents(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of line contents that have other similar contents; docs is (text, print)."""
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    banded = lines.select("content", "words", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("content").alias("pivot"), F.max("content").alias("most")).where("pivot <> most")
    shared = materialize(shared.select(F.col("band").alias("s_band"), "pivot"), "bands")
    members = banded.join(shared.hint("shuffle_hash"), F.col("band") == F.col("s_band")).groupBy("band", "pivot", "content").agg((8 * F.max("words")).alias("size"))
    members = materialize(members, "members")
    wanted = members.select(F.col("content").alias("w_content")).distinct()
    # one place of each content, combined map-side: a line that a third of all documents share is a row a task
    place = F.xxhash64("print", "start")
    first = lines.groupBy("content").agg(*[F.min_by(x, place).alias(x) for x in ("print", "start", "stop")])
    first = first.join(wanted, F.col("content") == F.col("w_content"), "left_semi")
    # all wanted lines of a text in one row, which its own length bounds
    places = first.groupBy(F.col("print").alias("p_print")).agg(F.collect_list(F.struct("content", "start", "stop")).alias("lines"))
    texts = docs.join(places.hint("shuffle_hash"), F.col("print") == F.col("p_print")).select("text", "lines")
    written = materialize(texts.mapInArrow(_shingle_sets, "content long, shingles binary"), "shingles")
    sets = materialize(written.dropDuplicates(["content"]).select(F.col("content").alias("t_content"), "shingles"), "sets")  # identical rows give a content again
    release(written)
    sizes = materialize(members.groupBy(F.col("band").alias("z_band")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).withColumn("slices", _slices("rows", "bytes")).where("slices > 1"), "heavy")
    own = members.join(sizes.select("z_band", "slices"), F.col("band") == F.col("z_band"), "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("long")))
    own = own.select("band", "pivot", "content", "slices", F.pmod(F.xxhash64("content"), F.col("slices")).alias("slice"))
    # the pivot is in every slice
    dealt = own.withColumn("i", F.explode(F.when(F.col("content") == F.col("pivot"), _upto("slices")).otherwise(F.array("slice"))))
    alone = F.lit(None).cast("byte").alias("side")
    dealt = dealt.join(sets, F.col("content") == F.col("t_content")).select("band", "i", F.lit(0).cast("long").alias("j"), "content", alone, F.col("content").alias("component"), "shingles")
    links = materialize(_verified(dealt, parts), "links")
    if sizes.isEmpty():
        release(shared, members, sets, sizes)
        return connected_components(links)
    # heavy bands in several components: all but the largest component meet all slices
    labels = connected_components(links).select(F.col("node").alias("l_node"), F.col("component").alias("label"))
    heavy = members.join(sizes.select("z_band", "slices"), F.col("band") == F.col("z_band"))
    heavy = heavy.join(labels, F.col("content") == F.col("l_node"), "left").select("band", "content", "size", "slices", F.coalesce("label", "content").alias("component"))
    heavy = materialize(heavy, "heavy-members")
    by_component = heavy.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held"))
    split = by_component.groupBy("band").agg(F.max(F.struct("n", "held", "component")).alias("most"), F.sum("n").alias("all"), F.sum("held").alias("all_held"))
    split = split.withColumn("rest", F.col("all") - F.col("most.n")).withColumn("rest_held", F.col("all_held") - F.col("most.held")).where("rest > 0")
    split = materialize(split.select(F.col("band").alias("x_band"), F.col("most.component").alias("largest"), _slices("rest", "rest_held").alias("others")), "split")
    met = heavy.join(split, F.col("band") == F.col("x_band")).withColumn("i", F.pmod(F.xxhash64("content"), F.col("slices"))).withColumn("j", F.pmod(F.xxhash64("content"), F.col("others")))
    left = met.select("band", "i", F.explode(_upto("others")).alias("j"), "content", F.lit(0).cast("byte").alias("side"), "component")
    right = met.where("component <> largest").select("band", F.explode(_upto("slices")).alias("i"), "j", "content", F.lit(1).cast("byte").alias("side"), "component")
    again = left.unionByName(right).join(sets, F.col("content") == F.col("t_content"))
    return connected_components(links.unionByName(materialize(_verified(again, parts), "links")))


def _known(units: DataFrame, near: DataFrame) -> DataFrame:
    """The class of every unit that repeats or that near (n_content, n_class) names.

    Only lines have similar contents: windows, most of all units, are counted and need no exchange for a join.
    """
    counts = [units.where(F.col("kind") == k).groupBy("content", "check").agg(F.count(F.lit(1)).alias("n")) for k in (0, 1)]
    lines = counts[0].join(near, F.col("content") == F.col("n_content"), "left").where("n > 1 OR n_class IS NOT NULL")
    lines = lines.withColumn("class_id", F.coalesce("n_class", "content")).withColumn("class_check", F.when(F.col("n_class").isNull(), F.col("check")).otherwise(0))
    windows = counts[1].where("n > 1").withColumn("class_id", F.col("content")).withColumn("class_check", F.col("check"))
    names = ["content", "check", "class_id", "class_check"]
    known = [x.select(F.lit(k).cast("byte").alias("kind"), *names) for k, x in enumerate((lines, windows))]
    return known[0].unionByName(known[1]).withColumnsRenamed({x: f"k_{x}" for x in ("kind", "content", "check")})


def _met(units: DataFrame, known: DataFrame) -> DataFrame:
    """The units that known names, with their classes; windows meet it without the columns that only lines have."""
    found = []
    for kind, own in enumerate((["form", "within"], [])):
        classes = known.where(F.col("k_kind") == kind).select("k_content", "k_check", "class_id", "class_check").hint("shuffle_hash")
        rows = units.where(F.col("kind") == kind).select("content", "check", "doc_id", "print", "start", "stop", "words", "word", *own)
        rows = rows.join(classes, (F.col("content") == F.col("k_content")) & (F.col("check") == F.col("k_check"))).drop("content", "check", "k_content", "k_check")
        rows = rows.withColumn("kind", F.lit(kind).cast("byte"))
        found.append(rows if own else rows.withColumn("form", F.lit(PASSAGE).cast("byte")).withColumn("within", F.lit(None).cast("long")))
    return found[0].unionByName(found[1])


def repeated_units(docs: DataFrame) -> DataFrame:
    """One row per unit that occurs, exactly or nearly, more than once: doc_id, kind, start, stop, words, class_id,
    class_check, class_size, keep_id, kept.

    kind is "paragraph" (a line of LEAST_WORDS or more), "line" (one of SHINGLE to LEAST_WORDS - 1), "block" (two or more
    consecutive lines under LEAST_WORDS, SHINGLE words together; similar lines, paragraphs and blocks are one class, in
    which a block stands for its own lines) or "passage" (SPAN words and what the text shares around them with
    an earlier unit of the class, in a run of LEAST_WORDS or more; units of one run overlap, and a repeated word counts
    as one unit); start and stop are code points of the text.  A removed passage stands in full in earlier texts or
    earlier in its own; a kept one shows the longest run that it shares.

    A class, named by (class_id, class_check), is a component of similar units; its first unit (smallest doc_id, null
    last; then smallest fingerprint of doc_id and text, then start) is kept, the others are removals.  Rows with null or
    repeated doc_ids are told apart by their texts.  Units of wholly identical rows count for each row, and one of their
    equal first units is marked kept in each.  Null and empty texts have no units.  A very long text is read in pieces
    and gives one row with all its lines to be compared.  Without repeats, and for an empty table, there are no
    rows.  Only doc_id and text are read, so further columns may have any names.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    slim = slim.withColumn("print", F.xxhash64("doc_id", "text"))
    units = materialize(slim.mapInArrow(_units, "kind byte, content long, check long, doc_id long, print long, start int, stop int, words int, word int, bands array<long>, form byte, within long"), "units", by="kind")
    near = _near_contents(units.where("kind = 0").select("content", "print", "start", "stop", "words", "bands"), slim.select("text", "print"))
    near = near.select(F.col("node").alias("n_content"), F.col("component").alias("n_class"))
    known = materialize(_known(units, near), "known")
    met = materialize(_met(units, known), "met")
    release(units)
    # a line in one class with its block is no other place than the block
    outer = known.where("k_kind = 0").select(F.col("k_content").alias("b_content"), F.col("class_id").alias("b_class")).dropDuplicates(["b_content"])
    inside = met.where("within IS NOT NULL").join(outer, F.col("within") == F.col("b_content"), "left").where("b_class IS NULL OR b_class <> class_id")
    found = met.where("within IS NULL").unionByName(inside.drop("b_content", "b_class")).drop("within")
    classes = found.groupBy(F.col("kind").alias("c_kind"), F.col("class_id").alias("c_class"), F.col("class_check").alias("c_check")).agg(
        F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "start")).alias("first")
    )
    classes = classes.where("class_size > 1").select("c_kind", "c_class", "c_check", "class_size", F.col("first.doc_id").alias("keep_id"), F.col("first.print").alias("keep_print"), F.col("first.start").alias("keep_start"))
    classes = materialize(classes, "classes")
    joined = found.join(classes.hint("shuffle_hash"), (F.col("kind") == F.col("c_kind")) & (F.col("class_id") == F.col("c_class")) & (F.col("class_check") == F.col("c_check")))
    kept = (F.col("print") == F.col("keep_print")) & (F.col("start") == F.col("keep_start"))
    joined = joined.select("kind", "form", "print", "doc_id", "start", "stop", "words", "word", "class_id", "class_check", "class_size", "keep_id", kept.alias("kept"))
    joined = materialize(joined, "repeats")
    release(met, known, classes)
    both = joined.where("kind = 0").unionByName(_extended(joined.where("kind = 1"), slim))
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "passage", "line", "block"))), F.col("form") + 1).alias("kind")
    return both.select("doc_id", kind, "start", "stop", "words", "class_id", "class_check", "class_size", "keep_id", "kept")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Divergence audit of sources: which terms a source overuses, and how far the sources of a language are apart.

Every task counts terms of its texts and sends sums by (lang, source, term).  Probabilities are integers (parts of a
billion, two added to every count), so all values are exact and do not depend on the order of sums.

Pairs are summed sparsely.  A term that neither source has adds the same value, f of the two baselines, so the sum over
all kept terms is that value times their number, corrected for the terms that one or both have: the corrections of one
source's terms against the other's baseline come from the histogram of its values, those of shared terms from tiles of
sources, which hold a slice of the terms and send one sum a pair.

Ranks to k are found by radix select: digits of the values are counted by group, from the highest on, until the digit
that holds rank k is known for all bits; what is above is in.  Of terms that tie at this threshold, the first by UTF-8
bytes are found in the same way, two bytes at a time.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm.common import joined_few, materialize, table, text_or_empty
from lorewright.operators.ranking import rank_in_groups

UNIT, ADDED, LEAST_DOCUMENTS, TOP = 1_000_000_000, 2, 10, 10
#: Bytes of UTF-8: terms are runs of letters a-z and of bytes of characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: A task's counts are sent when they hold so many terms; a text is read in pieces of about so many bytes.
HELD, PIECE = 400_000, 1 << 20
#: Bits of a digit and of a value (f is UNIT + 1 at most); groups with so few rows left are ranked directly.
BITS, VALUE_BITS, FEW = 8, 32, 100
#: Sources of a tile, least slices of the terms, and rows for each further slice.
TILE, SLICES, SLICE_ROWS = 64, 64, 200_000
GROUP = ["lang", "source"]


def _pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """text cut before terms, a piece of at least size bytes but the last."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and TERM.match(text[end : end + 1]):
            end += 1
        yield text[at:end]
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed over many texts; the empty term stands for the group."""
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for group, counts in n.items():
            terms = list(counts)
            for k in range(0, len(terms), 20_000):
                part = terms[k : k + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group[0]] * len(part)), pa.array([group[1]] * len(part)), pa.array(part, pa.binary()),
                        pa.array([counts[t] for t in part], pa.int64()), pa.array([docs[group][t] for t in part], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    held = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
            group = (lang, source)
            if group not in n:
                n[group], docs[group] = Counter({b"": 0}), Counter()
                held += 1
            mine, before = n[group], len(n[group])
            raw = text.as_py().lower()  # bytes: A-Z only
            own = Counter(TERM.findall(raw)) if len(raw) <= PIECE else sum((Counter(TERM.findall(p)) for p in _pieces(raw)), Counter())
            mine.update(own)
            docs[group].update(own.keys())
            held += len(mine) - before
            if held > HELD:
                yield from out()
                n, docs, held = {}, {}, 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8), n, docs: how often and in how many documents of the group; term '' has every group."""
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().cast("binary").alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * kept)) in exact decimals; null if nothing is kept."""
    wide = lambda x: x.cast("decimal(19,0)")
    over = wide(total) + F.lit(ADDED).cast("decimal(1,0)") * wide(kept)
    part = (wide(count) + F.lit(ADDED).cast("decimal(1,0)")) * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", part, over.cast("decimal(31,0)")) + 1)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), which longs hold."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms): lang, source, kept, base of every group; lang, source, term, p, q, base of its kept terms."""
    named = counts.where(F.octet_length("term") > 0)
    by_lang = named.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = materialize(named.select(*GROUP, "term", "n").join(by_lang.select("lang", "term", "lang_n"), ["lang", "term"]), "audit-kept")
    one = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang")
    langs = one.agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = counts.where(F.octet_length("term") == 0).select(*GROUP)
    zero = F.lit(0).cast("long")
    groups = joined_few(groups, langs, ["lang"], "left").join(totals, GROUP, "left").select(
        *GROUP, F.coalesce("kept", zero).alias("kept"), F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("total", zero).alias("total")
    )
    groups = materialize(groups.withColumn("base", share(zero, F.col("total"), F.col("kept"))), "audit-groups")
    terms = joined_few(kept, groups, GROUP).select(
        *GROUP, "term", "base", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    return groups, materialize(terms, "audit-shares")


def _digits(item: str) -> Iterator[Column]:
    """What decides an order by value descending and item ascending, digit by digit; a greater digit comes first."""
    for shift in range(VALUE_BITS - BITS, -1, -BITS):
        yield F.shiftright("value", shift).bitwiseAND((1 << BITS) - 1)
    for at in itertools.count(1, 2):
        yield 65_535 - F.conv(F.rpad(F.hex(F.substring(item, at, 2)), 4, "0"), 16, 10).cast("long")


def top_ranked(rows: DataFrame, k: int = TOP, item: str = "term", few: int = FEW) -> DataFrame:
    """rows (lang, source, value from 0, item as bytes, distinct in a group) of rank k or less, with rank.

    A round counts the digits of rows still open by group, finds the digit that holds rank k, takes rows above it
    and goes on with those at it, until few rows a group are open or all of a group are in.
    """
    taken, alive = None, rows.withColumn("left", F.lit(k).cast("long"))
    for number, digit in enumerate(_digits(item)):
        alive = alive.withColumn("digit", digit)
        counts = alive.groupBy(*GROUP, "left", "digit").agg(F.count(F.lit(1)).alias("n"))
        counts = materialize(counts, "audit-digits")
        open_rows = counts.groupBy(*GROUP).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if open_rows <= few:
            break
        above = Window.partitionBy(*GROUP).orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, -1)  # a row a digit
        ranked = counts.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        holds = ranked.where((F.col("above") < F.col("left")) & (F.col("above") + F.col("n") >= F.col("left")))
        holds = holds.select(*GROUP, F.col("digit").alias("cut"), (F.col("left") - F.col("above")).alias("rest"))
        marked = joined_few(alive, holds, GROUP, "left")
        marked = materialize(marked.where(F.col("cut").isNull() | (F.col("digit") >= F.col("cut"))), "audit-open")
        inside = marked.where(F.col("cut").isNull() | (F.col("digit") > F.col("cut"))).select(*rows.columns)
        taken = inside if taken is None else taken.unionByName(inside)
        alive = marked.where(F.col("digit") == F.col("cut")).select(*rows.columns, F.col("rest").alias("left"))
    last = alive.select(*rows.columns)
    found = last if taken is None else taken.unionByName(last)
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), item))  # k + few rows a group at most
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _tile_sums(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Corrections of every pair of a tile of sources and one of partners over one slice of the terms.

    terms: term, tile, place, p.  sources: source, tile, place, base, kept.
    """
    lang, i, j = key[0].as_py(), key[1].as_py(), key[2].as_py()
    number = terms.column("term").combine_chunks().dictionary_encode().indices  # equal numbers are equal terms
    terms = terms.set_column(terms.column_names.index("term"), "term", number)
    side = {}
    for tile in {i, j}:
        own = sources.filter(pc.equal(sources.column("tile"), tile)).sort_by("place")
        rows = terms.filter(pc.equal(terms.column("tile"), tile)).sort_by("term")
        base = np.asarray(own.column("base").fill_null(1))
        at = np.searchsorted(np.asarray(own.column("place")), np.asarray(rows.column("place")))
        side[tile] = own.column("source").to_pylist(), base, np.asarray(rows.column("term")), at, np.asarray(rows.column("p")), own
    (names_a, base_a, term_a, at_a, p_a, own), (names_b, base_b, term_b, at_b, p_b, _) = side[i], side[j]
    flat = _f(base_a[:, None], base_b[None, :])
    total = np.zeros((len(base_a), len(base_b)), np.int64)
    for one, at, p, mine, others in ((0, at_a, p_a, base_a, base_b), (1, at_b, p_b, base_b, base_a)):
        for k in range(len(mine)):
            values, n = np.unique(p[at == k], return_counts=True)
            alone = (n[:, None] * (_f(values[:, None], others[None, :]) - _f(mine[k], others)[None, :])).sum(axis=0)
            if one == 0:
                total[k] += alone
            else:
                total[:, k] += alone
    low, high = np.searchsorted(term_b, term_a, "left"), np.searchsorted(term_b, term_a, "right")
    ends = np.cumsum(high - low)
    start = 0
    while start < len(term_a):  # partners of consecutive rows, about a million at a time
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), "right")))
        n = (high - low)[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)
        x, y, p, q = at_a[a], at_b[b], p_a[a], p_b[b]
        np.add.at(total, (x, y), _f(p, q) - _f(p, base_b[y]) - _f(base_a[x], q) + flat[x, y])
        start = stop
    x, y = (np.triu_indices(len(names_a), 1) if i == j else tuple(v.ravel() for v in np.indices(total.shape)))
    n = len(x)
    kept = own.column("kept")[0].as_py() if len(own) else 0
    return pa.table(
        {
            "lang": pa.array([lang] * n, pa.string()), "source": pa.array([names_a[k] for k in x], pa.string()),
            "item": pa.array([names_b[k] for k in y], pa.string()), "value": pa.array(total[x, y], pa.int64()),
            "flat": pa.array(flat[x, y] * kept, pa.int64()),
        }
    )


def pair_divergence(groups: DataFrame, terms: DataFrame, tile: int = TILE, slices: int = SLICES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """lang, source, item, value: f summed over all kept terms of the lang, for every two sources of a lang, both ways."""
    slices = max(slices, terms.count() // slice_rows + 1)
    placed = rank_in_groups(groups.select(*GROUP, "kept", "base"), "lang", [F.col("source")], "place")
    placed = materialize(placed.withColumn("tile", F.floor((F.col("place") - 1) / tile).cast("int")), "audit-places")
    tiles = placed.groupBy("lang").agg(F.max("tile").alias("last"))
    placed = materialize(joined_few(placed, tiles, ["lang"]), "audit-tiles")
    dealt = {"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}
    others = F.explode(F.sequence(F.lit(0), "last"))
    rows = joined_few(terms.select(*GROUP, "term", "p"), placed.select(*GROUP, "place", "tile", "last"), GROUP)
    rows = rows.withColumn("other", others).withColumns(dealt)
    rows = rows.select("lang", "i", "j", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice"), "term", "tile", "place", "p")
    sources = materialize(placed, "audit-sides")  # the cogroup tells its sides apart by where they are read
    sources = sources.withColumn("other", others).withColumns(dealt).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    by = ["lang", "i", "j", "slice"]
    sums = rows.groupBy(*by).cogroup(sources.select(*by, "source", "tile", "place", "base", "kept").groupBy(*by))
    sums = sums.applyInArrow(_tile_sums, "lang string, source string, item string, value long, flat long")
    pairs = sums.groupBy(*GROUP, "item").agg((F.sum("value") + F.max("flat")).alias("value"))
    pairs = materialize(pairs, "audit-pairs")
    return pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def source_audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, k: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank.

    Null texts, langs and sources count as ''.  Ties in value are ranked by the UTF-8 bytes of the item.  Repeated rows
    are documents like others.  Very long texts are counted in pieces, and count as one document.  A group without terms
    has pairs but no term rows; a lang without kept terms has pairs of value 0.  An empty table gives no rows.  Other
    columns are not read, whatever their names.
    """
    groups, terms = shares(materialize(term_counts(docs), "audit-counts"), least)
    over = terms.where("p > q").select(*GROUP, "term", divergence(F.col("p"), F.col("q")).alias("value"))
    top = top_ranked(over, k).select(*GROUP, F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    pairs = pair_divergence(groups, terms).withColumn("group", F.struct(*GROUP))
    pairs = rank_in_groups(pairs, "group", [F.desc("value"), F.col("item")])
    return pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", "rank").unionByName(top)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
lt AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  (1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (coalesce(gt.n, 0) + 2 * lt.v)::HUGEINT)::BIGINT AS p,
  (1 + 1000000000 * (k.n + 2)::HUGEINT // (lt.n + 2 * lt.v)::HUGEINT)::BIGINT AS q
  FROM g JOIN kept k USING (lang) JOIN lt USING (lang) LEFT JOIN gt USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""

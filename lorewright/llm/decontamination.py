"""Benchmark decontamination by a prefix-filtered join of word shingles. DataFrame functions only.

Windows are the runs of WINDOW words of every benchmark item; an item of fewer words is one window.  A document can hold
a window only if it holds all shingles of it, so one is enough to look for: the rarest.  Shingles of documents meet
those of the benchmark once, by hash and then as words; what met is counted over all documents, and each window takes its
rarest shingle as prefix.  Windows with a shingle that no document has are out.  A place of a prefix gives the place where its
window would start, by the shingle's offset; it must lie within the document (positional and length bounds).  The words at
such places are put together from the shingles met there, and compared with the windows.

Many windows may share a prefix: places are met with (offset, length), not with windows, so a common shingle gives at most
a few starts a place.  Items are listed once for every distinct set of windows, not once a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm.common import joined_few, materialize, table, text_or_empty

WINDOW, SHINGLE = 10, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the contract before A-Z are lower-cased; single letters are looked up in one step, ranges are not.
RAW_WORD = rf"[0123456789{UPPER}{LOWER}\x{{80}}-\x{{10FFFF}}]+"
#: Shingles of the benchmark that a pass over the documents broadcasts; more take more passes.
PASS_SHINGLES = 1_000_000
KEY = ["k1", "k2"]


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; words of ASCII alone take the short way."""
    low = lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), low)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, words, n_words; rows that share doc_id and text share a key and have one result."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, "doc_id").alias("k2"), words_of(text).alias("words"))
    return rows.withColumn("n_words", F.size("words"))


def shingles(words: Column, size: int) -> Column:
    """A hash for every place; near the end fewer words are left, and what they meet is compared as words."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)]))


def said(words: Column, at: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(words, at, size), " ")


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """item (its id as string, null: empty), part (the window's words), len."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_or_empty()).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))))
    return items.select("item", F.slice("words", F.col("at"), window).alias("part")).withColumn("len", F.size("part"))


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """content, len, size, offset, token, shingle (its words): every shingle of every distinct window."""
    distinct = windows.select(said(F.col("part"), F.lit(1), F.col("len")).alias("content"), "part", "len").dropDuplicates(["content"])
    found = None
    for size in range(1, shingle + 1):
        own = distinct.where(F.least("len", F.lit(shingle)) == size).withColumn("size", F.lit(size))
        own = own.select("content", "part", "len", "size", F.posexplode(shingles(F.col("part"), size)).alias("offset", "token"))
        own = own.where(F.col("offset") <= F.col("len") - size).withColumn("shingle", said(F.col("part"), F.col("offset") + 1, size)).drop("part")
        found = own if found is None else found.unionByName(own)
    return found


def shingle_places(rows: DataFrame, tokens: DataFrame, sizes: list[int], most: int = PASS_SHINGLES) -> DataFrame:
    """doc_id, k1, k2, n_words, pos, size, shingle: places of documents with a shingle of the benchmark, and pos -1 for every row.

    tokens (token, size, shingle) are broadcast in slices of at most so many, a pass over the documents each.
    """
    every = rows.select("doc_id", *KEY, "n_words", F.lit(-1).alias("pos"), F.lit(0).alias("size"), F.lit("").alias("shingle"))
    slices = tokens.count() // most + 1
    found = every if slices > 1 else None
    for k in range(slices):
        part = tokens if slices == 1 else tokens.where(F.pmod(F.xxhash64("token"), F.lit(slices)) == k)
        for size in sizes:
            hashes = shingles(F.col("words"), size)
            if found is None:  # one pass tells the rows and their places: a row's first hash is none
                hashes, first = F.concat(F.array(F.lit(None).cast("long")), hashes), 1
            else:
                first = 0
            placed = rows.select("doc_id", *KEY, "n_words", "words", F.posexplode(hashes).alias("pos", "token")).withColumn("pos", F.col("pos") - first)
            own = F.broadcast(part.where(F.col("size") == size).select(F.col("token").alias("t"), F.col("shingle")))
            words = said(F.col("words"), F.greatest(F.col("pos") + 1, F.lit(1)), size)
            near = (F.col("token") == F.col("t")) & words.between(F.col("shingle"), F.col("shingle"))  # no join key: only rows of equal hash are compared
            met = placed.join(own, near, "left" if first else "inner")
            met = met.where(F.col("t").isNotNull() | (F.col("pos") == -1)) if first else met
            met = met.select("doc_id", *KEY, "n_words", "pos", F.lit(size).alias("size"), F.coalesce("shingle", F.lit("")).alias("shingle"))
            found = met if found is None else found.unionByName(met)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, passes: int = PASS_SHINGLES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items: a row per row of docs.

    Null texts have no words, and items without words no windows.  Null item_ids count as ''; rows that share an
    item_id are one item with the windows of all.  Repeated documents have a row each with one result.  Very long texts
    are read whole; their hits are one row's arrays, as their text is.  Empty tables: no documents, no rows; no items, no
    hits.  Shingles are met in passes of so many at a time.  Other columns are not read, whatever their names.
    """
    rows = keyed(docs)
    windows = materialize(windows_of(benchmark, window), "leak-windows")
    parts = materialize(window_shingles(windows, shingle), "leak-shingles")
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # shingle numbers at most
    none = F.lit(0).cast("long")
    if not sizes:
        counted = rows.select("doc_id", *KEY, "n_words")
        found = counted.limit(0).select(*KEY, none.alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        everywhere = materialize(shingle_places(rows, parts.select("token", "size", "shingle").distinct(), sizes, passes), "leak-places")
        counted, places = everywhere.where("pos = -1"), everywhere.where("pos >= 0")
        starts = materialize(_starts(places, _prefixes(places, parts)), "leak-starts")
        hits = materialize(_hits(places, starts, parts.select("content").distinct(), shingle), "leak-hits")
        found = _by_document(hits, windows)
    joined = counted.join(found, KEY, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", none).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"), items.alias("items"),
    )


def _prefixes(places: DataFrame, parts: DataFrame) -> DataFrame:
    """shingle, at: the (offset, len) of windows whose rarest shingle it is, of windows with all shingles in documents."""
    rarity = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", "shingle", "offset")).alias("first")
    met = parts.join(rarity, "shingle").groupBy("content", "len", "size").agg(F.count(F.lit(1)).alias("met"), rarest)
    whole = met.where(F.col("met") == F.col("len") - F.col("size") + 1).select("first.shingle", "first.offset", "len")
    return whole.groupBy("shingle").agg(F.collect_set(F.struct("offset", "len")).alias("at"))  # window^2 at most


def _starts(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """k1, k2, start, len: where a prefix and the bounds allow a window."""
    near = joined_few(places.select(*KEY, "n_words", "pos", "shingle"), prefixes, ["shingle"]).withColumn("at", F.explode("at"))
    near = near.select(*KEY, "n_words", (F.col("pos") - F.col("at.offset")).alias("start"), F.col("at.len").alias("len"))
    near = near.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    return near.select(*KEY, "start", "len").distinct()


def _hits(places: DataFrame, starts: DataFrame, contents: DataFrame, shingle: int) -> DataFrame:
    """k1, k2, start, stop, content of every start whose words are a window.

    The words come from the shingles at every shingle-th place and the last one; where one of these is missing, no window is.
    """
    size = F.col("size")
    steps = F.array_union(F.sequence(F.lit(0), F.col("len") - size, size), F.array(F.col("len") - size))
    asked = starts.withColumn("size", F.least("len", F.lit(shingle))).withColumn("step", F.explode(steps)).withColumn("pos", F.col("start") + F.col("step"))
    rest = F.col("len") % size  # words that the last shingle alone tells
    last = F.array_join(F.slice(F.split("shingle", " "), size - rest + 1, rest), " ")
    told = F.when(F.col("step") % size == 0, F.col("shingle")).otherwise(last)
    pieces = asked.join(places.select(*KEY, "pos", "size", "shingle").distinct(), [*KEY, "pos", "size"]).select(*KEY, "start", "len", F.struct("step", told.alias("told")).alias("piece"))
    cut = pieces.groupBy(*KEY, "start", "len").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    cut = cut.where(F.size("pieces") == F.ceil(F.col("len") / F.least("len", F.lit(shingle))))
    cut = materialize(cut.select(*KEY, "start", "len", F.array_join("pieces.told", " ").alias("content")), "leak-cut")
    return joined_few(cut, contents, ["content"]).select(*KEY, "start", (F.col("start") + F.col("len")).alias("stop"), "content")


def _by_document(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """k1, k2, n_hit, items."""
    per = hits.groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.sort_array(F.collect_set(F.md5("content"))).alias("held")
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    more = lambda s, x: F.greatest(x["stop"] - F.greatest(x["start"], s["reach"]), F.lit(0))
    step = lambda s, x: F.struct((s["n"] + more(s, x)).alias("n"), F.greatest(s["reach"], x["stop"]).alias("reach"))
    n_hit = F.aggregate("spans", zero, step, lambda s: s["n"].cast("long"))
    per = materialize(per.select(*KEY, n_hit.alias("n_hit"), "held", F.md5(F.array_join("held", ",")).alias("set")), "leak-documents")
    sets = per.groupBy("set").agg(F.first("held").alias("held")).select("set", F.explode("held").alias("one"))
    listed = windows.groupBy(F.md5(F.array_join("part", " ")).alias("one")).agg(F.sort_array(F.collect_set("item")).alias("list"))
    lists = joined_few(sets, listed, ["one"]).groupBy("set").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("list")))).alias("items"))
    return joined_few(per.select(*KEY, "n_hit", "set"), materialize(lists, "leak-lists"), ["set"]).select(*KEY, "n_hit", "items").dropDuplicates(KEY)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bs AS (SELECT item, ws, unnest(range(greatest(len(ws) - 9, 1))) AS s FROM b WHERE len(ws) > 0),
w AS MATERIALIZED (SELECT DISTINCT item, array_to_string(ws[s + 1:s + 10], ' ') AS c, least(len(ws), 10) AS l FROM bs),
ds AS (SELECT id, ws, l, unnest(range(len(ws) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM w) WHERE len(ws) >= l),
dc AS (SELECT id, s, l, array_to_string(ws[s + 1:s + l], ' ') AS c FROM ds),
h AS MATERIALIZED (SELECT * FROM dc WHERE c IN (SELECT c FROM w)),
n AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(s, s + l)) AS p FROM h) GROUP BY id),
i AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT h.id, w.item FROM h JOIN w ON w.c = h.c) GROUP BY id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (id) LEFT JOIN i USING (id)
"""

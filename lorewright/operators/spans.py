"""Source spans of bounded length: sentences joined while short, cut where long, a short tail joined to the span before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A span takes further sentences below LEAST characters, and never has over MOST.
LEAST, MOST = 200, 600


def _cut_long(sentence: Column) -> Column:
    """A sentence in parts of MOST characters at most, cut at the last space of those if it is not before LEAST."""
    start = F.struct(F.trim(sentence).alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        rest = s["rest"]
        space = F.char_length(F.regexp_replace(F.substr(rest, F.lit(1), F.lit(MOST + 1)), "[^ ]*$", "")) - 1
        cut = F.when(space >= LEAST, space).otherwise(MOST)
        more = F.struct(F.trim(F.substr(rest, cut + 1, F.char_length(rest))).alias("rest"), F.concat(s["out"], F.array(F.trim(F.substr(rest, F.lit(1), cut)))).alias("out"))
        return F.when(F.char_length(rest) > MOST, more).otherwise(s)

    steps = F.sequence(F.lit(0), F.floor(F.char_length(sentence) / LEAST))
    return F.aggregate(steps, start, step, lambda s: F.filter(F.concat(s["out"], F.array(s["rest"])), lambda x: x != ""))


def source_spans(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, span (from 1), text of pages (keys, text); white space counts as one space, empty and null pages have none."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    sentences = F.split(F.regexp_replace(said, r"([.!?]) ", "$1\n"), "\n")
    parts = pages.select(*keys, F.flatten(F.transform(sentences, _cut_long)).alias("parts"))
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        now, fits = s["now"], (F.char_length(s["now"]) < LEAST) & (F.char_length(s["now"]) + 1 + F.char_length(x) <= MOST)
        grown = F.struct(F.concat(now, F.lit(" "), x).alias("now"), s["done"].alias("done"))
        moved = F.struct(x.alias("now"), F.concat(s["done"], F.array(now)).alias("done"))
        return F.when(now == "", F.struct(x.alias("now"), s["done"].alias("done"))).when(fits, grown).otherwise(moved)

    def end(s: Column) -> Column:
        last = F.try_element_at(s["done"], F.lit(-1))
        joins = (F.char_length(s["now"]) < LEAST) & (F.char_length(last) + 1 + F.char_length(s["now"]) <= MOST)
        before = F.slice(s["done"], F.lit(1), F.greatest(F.size(s["done"]) - 1, F.lit(0)))
        whole = F.when(F.coalesce(joins, F.lit(False)), F.concat(before, F.array(F.concat(last, F.lit(" "), s["now"])))).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.when(s["now"] == "", F.array().cast("array<string>")).otherwise(whole)

    spans = parts.select(*keys, F.aggregate("parts", start, step, end).alias("spans"))
    return spans.select(*keys, F.posexplode("spans").alias("span", "text")).withColumn("span", F.col("span") + 1)

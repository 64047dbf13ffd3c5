"""Mentions of names in texts by an index of token runs, and identities that a text implies without naming them.

A text's tokens are its runs of letters and digits, each with what follows it.  Runs of tokens as long as a name meet the
names by an equi-join, separators included, so no text is compared with every name and names may be many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import is_safe_mention, tokens_of
from lorewright.storage import materialize

TOKEN, TOKEN_AND_GAP = r"[\p{L}\p{N}]+", r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"
#: Code points of an excerpt, and of what stands before the mention in it.
EXCERPT, BEFORE = 480, 220
#: What names say of rank, kind and number, and the verbs of the kinds of events.
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth",
    "1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "9th", "10th", "11th", "12th",
)
ORGANIZATIONS = ("army", "fleet", "guard", "legion", "order", "regiment")
TITLES = ("baron", "baroness", "duchess", "duke", "emperor", "empress", "king", "prince", "princess", "queen")
EVENT_VERBS = {
    "assassination": r"assassinat\p{L}*|kill\p{L}*|murder\p{L}*|slain|slew",
    "death": r"dead|death|die\p{L}*|kill\p{L}*|slain|slew",
    "killing": r"kill\p{L}*|murder\p{L}*|slain|slew",
    "murder": r"assassinat\p{L}*|kill\p{L}*|murder\p{L}*|slain|slew",
}
#: Rows of a text, on average, from which texts are read once each.
REPEATED = 4
#: Words that may stand between an ordinal and its organisation; letters of a plural and of a telling word.
APART, PLURAL, TELLING = 3, 6, 5


def _flat(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def safe_names(entities: DataFrame, every: bool = False) -> DataFrame:
    """id, name of entities (id, names: array) that are safe to look for (or of all), white space as one space, lower case."""
    own = entities.select("id", F.explode("names").alias("name")).where(F.lit(every) | is_safe_mention(F.col("name")))
    return own.select("id", F.trim(_flat(F.col("name"))).alias("name")).where(F.col("name").rlike(rf"^{TOKEN}") & F.col("name").rlike(rf"{TOKEN}$")).distinct()


def name_spans(texts: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    """keys, id, name, start, stop of every place where a text (keys, text) holds a name (id, name), in tokens from 0.

    Names are written first, so that Spark knows their size: few are brought to the texts, and no run of tokens is exchanged.
    """
    names = materialize(names, "names")
    widths = names.select(F.size(F.regexp_extract_all("name", F.lit(TOKEN), F.lit(0))).alias("w")).distinct()
    widths = sorted(r.w for r in widths.collect())  # words of a name: a handful
    flat = texts.select(*keys, _flat(F.col("text")).alias("t"))
    parts = flat.select(*keys, F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("bare"), F.regexp_extract_all("t", F.lit(TOKEN_AND_GAP), F.lit(0)).alias("full"))
    none = F.array().cast("array<struct<start:int,stop:int,name:string>>")

    def runs(w: int) -> Column:
        said = lambda i: F.concat(F.array_join(F.slice("full", i, w - 1), ""), F.element_at("bare", i + (w - 1)))
        one = lambda i: F.struct((i - 1).alias("start"), (i + (w - 1)).alias("stop"), said(i).alias("name"))
        return F.when(F.size("bare") >= w, F.transform(F.sequence(F.lit(1), F.size("bare") - (w - 1)), one)).otherwise(none)

    every = F.concat(*[runs(w) for w in widths]) if widths else none
    return parts.select(*keys, F.explode(every).alias("r")).select(*keys, "r.*").join(names, "name")


def by_text(texts: DataFrame, keys: list[str], find: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """find(texts, keys), which says something of each text (keys, text) alone.

    Lines of a kind repeat.  Where a text has REPEATED rows on average, find is asked about each distinct text once, and rows
    take what it says of theirs; where texts differ, they are not exchanged for it.
    """
    size = texts.agg(F.count("text").alias("rows"), F.approx_count_distinct("text").alias("texts")).first()
    if size.rows < REPEATED * size.texts or not size.rows:
        return find(texts, keys)
    each = materialize(texts.where("text IS NOT NULL").select(F.col("text").alias("said"), "text").distinct(), "texts")
    found = materialize(find(each, ["said"]), "found")
    return texts.select(*keys, F.col("text").alias("said")).join(found, "said").drop("said")


def free_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, mentions, name, start: the spans of an entity in a text without overlap, and the first of its longest name.

    Earlier spans come first, of one start the longer one; a span counts if it starts after the last that counts.
    """
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    free = lambda s, x: x["start"] >= s["end"]
    step = lambda s, x: F.when(free(s, x), F.struct((s["n"] + 1).alias("n"), (-x["stop"]).alias("end"))).otherwise(s)
    order = F.sort_array(F.collect_set(F.struct("start", (-F.col("stop")).alias("stop"))))  # a text's own spans
    first = F.min(F.struct((-F.char_length("name")).alias("l"), "name", "start"))
    found = spans.groupBy(*keys, "id").agg(order.alias("s"), first.alias("f"))
    return found.select(*keys, "id", F.aggregate("s", zero, step)["n"].alias("mentions"), F.col("f.name").alias("name"), F.col("f.start").alias("start"))


def source_occurrences(entities: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, mentions, excerpt: how often a text (keys, text) names an entity (id, names), and where it first does.

    Case and white space do not matter, other separators do.  The excerpt shows the first place of the longest name found.
    Null texts and names hold nothing; runs that a name shares with itself are counted once each where they do not overlap.
    """
    found = free_spans(name_spans(texts, keys, safe_names(entities)), keys)
    at = F.col("start")
    head = F.char_length(F.regexp_extract("text", r"^[^\p{L}\p{N}]*", 0))
    before = head + F.char_length(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(TOKEN_AND_GAP), F.lit(0)), F.lit(1), at), ""))
    met = found.join(texts.select(*keys, "text"), keys).withColumn("at", before)
    start = F.greatest(F.lit(0), F.least(F.col("at") - BEFORE, F.greatest(F.lit(0), F.char_length("text") - EXCERPT)))
    return met.select(*keys, "id", "mentions", F.regexp_replace(F.substr("text", start + 1, F.lit(EXCERPT)), r"^\s+|\s+$", "").alias("excerpt"))


def _first(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.get(F.filter(tokens, lambda t: t.isin(*words)), 0)


def bounded_context(entities: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, rules: entities (id, name, type, aliases) that a text (keys, text) implies and does not name.

    plural: the last word of a faction's name without its s.  organisation: an ordinal and a kind of organisation at most
    APART words apart, if one faction has both in its name.  title: a title that one npc has.  event: a verb of the event's
    kind, and a word of TELLING letters of whom it befell.  Rules meet texts by words and pairs of words.
    """
    tokens = tokens_of(F.col("name"))
    own = entities.select("id", "type", tokens.alias("t")).where(F.size("t") > 0)
    own = own.withColumns({"ordinal": _first(F.col("t"), ORDINALS), "organisation": _first(F.col("t"), ORGANIZATIONS), "title": _first(F.col("t"), TITLES)})
    last = F.element_at("t", -1)
    of = F.array_position("t", "of").cast("int")
    subject = F.filter(F.slice("t", of + 1, F.size("t")), lambda t: F.char_length(t) >= TELLING)
    plural = own.where((F.col("type") == "faction") & (F.char_length(last) >= PLURAL) & last.endswith("s"))
    pairs = own.where((F.col("type") == "faction") & F.col("ordinal").isNotNull() & F.col("organisation").isNotNull()).groupBy("ordinal", "organisation")
    # a name with a title twice is counted twice, so it is no single holder
    holders = own.where("type = 'npc'").select("id", "title", F.explode(F.filter("t", lambda t: t.isin(*TITLES))).alias("held")).groupBy("held")
    titles = holders.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("title").alias("title")).where("n = 1 AND held = title")
    events = own.where((F.col("type") == "event") & F.get("t", F.lit(0)).isin(*EVENT_VERBS) & (of > 0)).select("id", F.get("t", F.lit(0)).alias("kind"), F.explode(subject).alias("w"))

    said = texts.select(*keys, "text", tokens_of(F.col("text")).alias("t"))
    words = said.select(*keys, F.explode(F.array_distinct("t")).alias("w"))
    near = F.flatten(F.transform("t", lambda w, i: F.when(w.isin(*ORDINALS), F.transform(F.filter(F.slice("t", i + 2, APART + 1), lambda o: o.isin(*ORGANIZATIONS)), lambda o: F.struct(w.alias("ordinal"), o.alias("organisation")))).otherwise(F.array().cast("array<struct<ordinal:string,organisation:string>>"))))
    close = said.select(*keys, F.explode(F.array_distinct(near)).alias("p")).select(*keys, "p.*")
    unique = pairs.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    verb = lambda kind: F.col("text").rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{EVENT_VERBS[kind]})(?![\p{{L}}\p{{N}}_])")
    acts = said.select(*keys, F.explode(F.filter(F.array(*[F.when(verb(k), F.lit(k)) for k in EVENT_VERBS]), lambda k: k.isNotNull())).alias("kind"))
    rule = lambda df, name: df.select(*keys, "id", F.lit(name).alias("rule"))
    # Spark takes rows made of texts for as few as the texts' columns are narrow; none of them may be brought to the driver
    least = lambda n: words.where(F.char_length("w") >= n)
    stem = plural.select("id", F.expr("left(element_at(t, -1), char_length(element_at(t, -1)) - 1)").alias("w"))
    found = (
        rule(least(PLURAL - 1).join(stem.hint("merge"), "w"), "plural")
        .unionByName(rule(close.join(F.broadcast(unique), ["ordinal", "organisation"]), "organisation"))
        .unionByName(rule(words.where(F.col("w").isin(*TITLES)).join(F.broadcast(titles.select("id", F.col("held").alias("w"))), "w"), "title"))
        .unionByName(rule(least(TELLING).join(events.hint("merge"), "w").join(acts.hint("merge"), [*keys, "kind"]), "event"))
    )
    # names are looked for in the texts that imply their entities, in no others
    names = safe_names(entities.select("id", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names")))
    names = names.groupBy("id").agg(F.collect_list("name").alias("names"))  # an entity's own names
    flat = texts.select(*keys, _flat(F.col("text")).alias("flat"))
    met = found.join(names.hint("merge"), "id", "left").join(flat.hint("merge"), keys, "left")
    named = F.coalesce(F.exists("names", lambda n: F.contains(F.col("flat"), n) & _stands(F.col("flat"), n)), F.lit(False))
    told = met.groupBy(*keys, "id").agg(F.concat_ws(",", F.sort_array(F.collect_set("rule"))).alias("rules"), F.max(named).alias("named"))
    return told.where("NOT named").drop("named")


def _stands(text: Column, name: Column) -> Column:
    """Whether text holds name from the start of a token to the end of one; name is lower case, so it ends no quotation."""
    return F.rlike(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}])")))

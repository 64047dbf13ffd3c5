"""What a text's own forms say of a mention: a class of things without a name, or the one named thing that it refers to.

Both look at the scope of a cited unit: the units before it, without a gap, whose context is the unit's or holds it.  Words of
units meet mentions by their noun, and each use of a noun is judged once by the tokens around it, whoever asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import normalize_name
from lorewright.operators.mentions import TOKEN, TOKEN_AND_GAP, by_text, name_spans, safe_names
from lorewright.storage import materialize

#: Words that count or single out, words before a class, and nouns that refer to named things of a type.
DETERMINERS = (
    "a", "an", "any", "each", "every", "some", "several", "many", "few", "all", "both", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
)
PREPOSITIONS = ("by", "of", "with", "from", "against")
NAMING = ("named", "called", "known")
PRONOUNS = ("it", "they", "he", "she", "him", "her", "them")
SIZES = ("small", "large", "ordinary", "unnamed")
HEADS = {
    "tower": ("location",), "spire": ("location",), "house": ("location",), "cave": ("location",), "stronghold": ("location",), "island": ("location",), "complex": ("location",),
    "site": ("location",), "disease": ("other",), "fever": ("other",), "academy": ("faction", "location"), "guild": ("faction",), "council": ("faction",), "organization": ("faction",),
    "ritual": ("event", "other"), "artifact": ("item",), "relic": ("item",), "object": ("item",), "construct": ("item",),
}
LEAST_HEAD, BETWEEN, SHORT_SCOPE = 3, 2, 4


def scopes(cited: DataFrame, units: DataFrame) -> DataFrame:
    """The columns of cited, place, first: the places first to place are the scope of a cited unit (doc, unit).

    units: doc, unit, place, context.  Contexts are met as runs of equal ones, of which a document has few.
    """
    along = Window.partitionBy("doc").orderBy("place")
    new = F.coalesce((~F.col("context").eqNullSafe(F.lag("context").over(along))).cast("int"), F.lit(1))
    runs = units.select("doc", "place", "context", new.alias("new")).withColumn("run", F.sum("new").over(along)).groupBy("doc", "run")
    runs = runs.agg(F.max(F.struct("place", "context")).alias("r")).groupBy("doc").agg(F.collect_list(F.struct(F.col("r.place").alias("last"), F.col("r.context").alias("context"))).alias("runs"))
    at = cited.distinct().join(units.select("doc", "unit", "place", "context"), ["doc", "unit"])
    # a document's runs come as one row, so no unit is multiplied by them
    holds = lambda r: F.col("context").eqNullSafe(r["context"]) | F.coalesce(F.col("context").startswith(F.concat(r["context"], F.lit(" > "))), F.lit(False))
    stops = F.filter("runs", lambda r: (r["last"] < F.col("place")) & ~holds(r))
    met = at.join(runs, "doc").withColumn("stop", F.array_max(F.transform(stops, lambda r: r["last"])))
    return met.select(*cited.columns, "place", (F.coalesce("stop", F.lit(-1)) + 1).alias("first")).distinct()


def scoped(mentions: DataFrame, cited: DataFrame, units: DataFrame) -> DataFrame:
    """mentions (claim) with scopes: the scopes (doc, unit, place, first) of their claim's own citations, null if there are none."""
    reach = scopes(cited.select("claim", "doc", "unit"), units).groupBy("claim").agg(F.collect_set(F.struct("doc", "unit", "place", "first")).alias("scopes"))
    return mentions.join(reach, "claim", "left")


def _nouns(mention: Column) -> dict[str, Column]:
    """words, head, singular and plural of a mention without its article."""
    words = F.filter(F.split(F.regexp_replace(normalize_name(mention), "^the ", ""), " "), lambda w: w != "")
    head = F.try_element_at(words, F.lit(-1))
    cut = lambda n: F.substr(head, F.lit(1), F.char_length(head) - n)
    singular = F.when(head.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(head.endswith("s") & ~head.rlike("(?:ss|us|is)$"), cut(1)).otherwise(head)
    plural = F.when(singular.endswith("y"), F.concat(F.substr(singular, F.lit(1), F.char_length(singular) - 1), F.lit("ies"))).otherwise(F.concat(singular, F.lit("s")))
    return {"words": words, "head": head, "singular": singular, "plural": plural}


def noun_uses(units: DataFrame, nouns: DataFrame) -> DataFrame:
    """doc, unit, place, noun, upper (title case within a sentence), lower (has a small letter), exact (has no other), counted, after_of, acts, named of each use of nouns.

    counted: a determiner stands before it with BETWEEN lower-case words at most between; after_of: a preposition does; acts:
    a lower-case word that ends in s follows; named: the text gives it a name ("a guard called Vess").
    """
    # texts meet the nouns of their document before they are cut into tokens, so no token is exchanged
    wanted = nouns.groupBy("doc").agg(F.collect_set("noun").alias("nouns"))  # at most the words of a document
    rows = units.select("doc", "unit", "place", "text").join(wanted, "doc")
    own = ["doc", "unit", "place", "nouns"]
    asks = materialize(nouns.select("noun").distinct(), "nouns")
    uses = by_text(rows, own, lambda each, keys: _noun_uses(each, keys) if keys == own else _noun_uses(each, keys).join(asks, "noun", "left_semi"))
    return uses.where(F.array_contains("nouns", F.col("noun"))).drop("nouns")


def _noun_uses(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and what noun_uses says of the tokens of texts (keys, text): those in nouns, where that is a key, else all."""
    parts = texts.select(*keys, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("t"), F.regexp_extract_all("text", F.lit(TOKEN_AND_GAP), F.lit(0)).alias("g"))
    at = F.transform("t", lambda w, i: F.struct(i.alias("i"), w.alias("w"), F.lower(w).alias("noun")))
    if "nouns" in keys:
        at = F.filter(at, lambda x: F.array_contains(F.col("nouns"), x["noun"]))
    each = parts.select(*keys, "t", "g", F.explode(at).alias("x")).select(*keys, "t", "g", "x.*")
    tail = lambda n: F.slice("t", F.greatest(F.lit(1), F.col("i") + 1 - n), F.least(F.col("i"), F.lit(n)))
    near = each.select(
        *keys, "w", "noun", "i", tail(BETWEEN + 1).alias("before"), F.slice("t", F.col("i") + 2, F.lit(BETWEEN + 2)).alias("after"),
        F.get("g", F.col("i") - 1).alias("last"), F.get("g", F.col("i")).alias("own"),
    )
    low = lambda x: x.rlike(r"^[\p{Ll}-]+$")
    # a determiner at distance k, and lower-case words from it on
    at = lambda k: F.get(F.reverse("before"), F.lit(k))
    after = lambda k: F.get("after", F.lit(k))
    counts = lambda x: F.lower(x).isin(*DETERMINERS) | x.rlike(r"^\d+$")
    steps = [counts(at(0)), counts(at(1)) & low(at(0)), counts(at(2)) & low(at(1)) & low(at(0))]
    opens = (F.col("i") == 0) | F.col("last").rlike(r"[.!?]\s*$")
    plain = F.col("own").rlike(r"^\p{L}+\s+$")  # only white space between it and the next word
    names = [F.lower(after(0)).isin(*NAMING), F.lower(after(1)).isin(*NAMING) & low(after(0)), F.lower(after(2)).isin(*NAMING) & low(after(1)) & low(after(0))]
    no = lambda x: F.coalesce(x, F.lit(False))
    either = lambda xs: no(xs[0]) | no(xs[1]) | no(xs[2])
    said_so = no(F.lower(at(0)).isin("named", "called")) | no((F.lower(at(0)) == "as") & (F.lower(at(1)) == "known"))
    return near.select(
        *keys, "noun", (F.col("w").rlike(r"\p{Lu}") & ~opens).alias("upper"), F.col("w").rlike(r"\p{Ll}").alias("lower"), (F.col("w") == F.col("noun")).alias("exact"), either(steps).alias("counted"),
        no(F.lower(at(0)).isin(*PREPOSITIONS)).alias("after_of"), (plain & no(after(0).rlike(r"^[\p{Ll}-]+s$"))).alias("acts"), (either(names) | said_so).alias("named"),
    )


def generic_mentions(mentions: DataFrame, cited: DataFrame, units: DataFrame, entities: DataFrame) -> DataFrame:
    """mention, proof (a unit) of mentions (mention, claim, text) that the cited texts use as a class, without a name.

    cited: claim, doc, unit; units: doc, unit, place, context, text; entities: id, name, aliases.  No mention that an entity
    answers to, that begins with an entity's name, or that is a pronoun is a class; nor one whose noun the scope names,
    or writes in title case within a sentence.  Mentions may be scoped already.  A use proves a class by a determiner, by a plural that is used twice or after a
    preposition, or by a verb of the class after the singular.  A qualified singular needs modifiers of form or size.
    """
    n = _nouns(F.col("text"))
    mentions = mentions if "scopes" in mentions.columns else scoped(mentions, cited, units)
    named = entities.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    keys = materialize(named.select(F.regexp_replace(normalize_name(F.col("n")), "^the ", "").alias("key")).where("key <> ''").distinct(), "keys")
    begins = F.transform(F.sequence(F.lit(1), F.size("words")), lambda k: F.array_join(F.slice("words", F.lit(1), k), " "))
    fits = F.forall(F.slice("words", F.lit(1), F.size("words") - 1), lambda w: w.endswith("ed") | w.isin(*SIZES))

    def classes(each: DataFrame, by: list[str]) -> DataFrame:
        own = each.select(*by, *[c.alias(k) for k, c in n.items()]).where((F.char_length("head") >= LEAST_HEAD) & ~F.array_join("words", " ").isin(*PRONOUNS))
        known = materialize(own.select(by[0], F.explode(begins).alias("key")).join(keys, "key").select(by[0]).distinct(), "known")
        return own.join(known, by[0], "left_anti").where((F.size("words") == 1) | (F.col("head") != F.col("singular")) | fits)

    own = by_text(mentions.select("mention", "scopes", "text"), ["mention", "scopes"], classes)
    own = materialize(own, "classes")
    asked = own.select("mention", "head", "plural", "singular", F.explode("scopes").alias("s"))
    asked = asked.select("mention", "s.*", "plural", "singular", F.explode(F.array_distinct(F.array("head", "singular", "plural"))).alias("noun"))
    asked = materialize(asked.withColumns({"plural": F.col("noun") == F.col("plural"), "singular": F.col("noun") == F.col("singular")}), "asked")
    uses = materialize(noun_uses(units, asked.select("doc", "noun").distinct()), "uses")
    held = asked.select("mention", "doc", F.col("unit").alias("direct"), F.col("place").alias("at"), "first", "plural", "singular", "noun").join(uses, ["doc", "noun"])
    held = held.where("place BETWEEN first AND at")
    # scopes of several cited units overlap: a use counts once
    once = held.groupBy("mention", "doc", "unit", "place", "noun", "plural", "singular", "upper", "lower", "exact", "counted", "after_of", "acts", "named").agg(
        F.max(F.col("unit") == F.col("direct")).alias("here"), F.count(F.lit(1)).alias("times"), F.countDistinct("direct").alias("by")
    )
    many = F.col("plural")
    totals = once.groupBy("mention").agg(
        F.max("upper").alias("upper"), F.max("named").alias("named"), F.max("here").alias("here"), F.sum(F.when(many & F.col("exact"), F.col("times") / F.col("by")).otherwise(0)).alias("plurals"),
        F.min(F.when(F.col("lower") & F.col("counted") | F.col("lower") & many & F.col("after_of") | F.col("exact") & F.col("singular") & F.col("acts"), F.struct("place", "unit"))).alias("shown"),
        F.min(F.when(many & F.col("lower"), F.struct("place", "unit"))).alias("first_plural"),
    )
    proof = F.when(F.col("shown").isNotNull() & (F.col("first_plural").isNull() | (F.col("plurals") < 2) | (F.col("shown") <= F.col("first_plural"))), F.col("shown")).when(F.col("plurals") >= 2, F.col("first_plural")).otherwise(F.col("shown"))
    return totals.where(~F.col("upper") & ~F.col("named") & F.col("here")).withColumn("proof", proof["unit"]).where("proof IS NOT NULL").select("mention", "proof")


def referred_entities(mentions: DataFrame, cited: DataFrame, units: DataFrame, entities: DataFrame) -> DataFrame:
    """mention, id, anchor (a unit) of mentions "the NOUN" (mention, claim, text) that refer to one named entity of their scope.

    The noun is one of HEADS.  Entities (id, name, aliases, type) of a fitting type answer if the scope names them before or
    in the cited unit and the noun stands in their name.  Two that answer leave it open, and so does "another NOUN" or "a
    different, second or new NOUN" in the scope after the first of them.  Mentions may be scoped already.
    """
    noun = F.regexp_extract(F.lower(F.trim("text")), r"^the\s+(?:[\p{Ll}-]+\s+){0,2}([\p{Ll}-]+)$", 1)
    types = F.create_map(*[x for h, ts in HEADS.items() for x in (F.lit(h), F.array(*[F.lit(t) for t in ts]))])
    mentions = mentions if "scopes" in mentions.columns else scoped(mentions, cited, units)
    own = mentions.select("mention", "scopes", noun.alias("noun")).where(F.col("noun").isin(*HEADS)).withColumn("types", types[F.col("noun")])
    asked = own.select("mention", "noun", "types", F.explode("scopes").alias("s"))
    asked = materialize(asked.select("mention", "noun", "types", "s.doc", F.col("s.place").alias("at"), "s.first"), "asked")
    every = safe_names(entities.select("id", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names")), every=True)
    headed = entities.select("id", "type", F.explode(F.array_distinct(F.split(normalize_name(F.col("name")), " "))).alias("noun")).where(F.col("noun").isin(*HEADS))
    every = every.join(headed.select("id").distinct(), "id", "left_semi")
    named = by_text(units.select("doc", "unit", "place", "text"), ["doc", "unit", "place"], lambda each, keys: name_spans(each, keys, every).select(*keys, "id").distinct()).distinct()
    anchors = materialize(named.join(headed, "id"), "anchors")
    met = asked.join(anchors, ["doc", "noun"]).where("place BETWEEN first AND at AND array_contains(types, type)")
    one = met.groupBy("mention", "noun", "doc", "at", "first").agg(F.min("id").alias("id"), F.max("id").alias("top"), F.min(F.struct("place", "unit")).alias("a")).where("id = top")
    rival = F.regexp_extract_all(F.lower("text"), F.lit(r"(?:^|[^\p{L}\p{N}])(?:another|a different|a second|a new)\s+(\p{L}+)"), F.lit(1))
    rivals = units.select("doc", F.col("place").alias("r_place"), F.explode(F.array_distinct(rival)).alias("noun")).where(F.col("noun").isin(*HEADS))
    blocked = one.join(rivals, ["doc", "noun"]).where((F.col("r_place") > F.col("a.place")) & (F.col("r_place") <= F.col("at"))).select("mention", "at", "doc")
    open_ = one.join(blocked.distinct(), ["mention", "at", "doc"], "left_anti")
    return open_.groupBy("mention").agg(F.min("id").alias("id"), F.max("id").alias("top"), F.min("a").alias("a")).where("id = top").select("mention", "id", F.col("a.unit").alias("anchor"))

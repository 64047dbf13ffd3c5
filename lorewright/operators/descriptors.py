"""Descriptors: roles that a text gives to a named parent ("Ari's guards", "the second army of Vess"), and what they resolve.

A registry lists each role that a unit of text states of an entity.  Names are found by token runs; what stands around a name
is then held against one fixed rule table, so no pattern is made per name.  A mention such as "the guards" has the one parent
that the registry knows for its role and number: among the units that a claim cites, then next to them, and a numbered role
also among all earlier units of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.operators.mentions import TOKEN, TOKEN_AND_GAP, by_text, name_spans, safe_names
from lorewright.storage import materialize

#: Pieces of text on each side of a name that rules look at; units before and after a cited one that are near it.
AROUND, NEAR = 8, (-2, 1)
#: What may be subordinate to a named parent, those that need a verb after them, numbers, and what may follow.
ROLES = (
    "diplomatic envoys?", "guards?", "agents?", "students?", "staff", "army", "armies", "fleets?", "envoys?", "messengers?", "priests?", "clergy", "servants?", "followers?",
    "nobles?", "loyalists?", "forces?", "citizens?", "inhabitants?", "bookkeepers?", "rooms?", "chambers?", "storerooms?", "gates?", "siege engines?",
)
AMBIGUOUS = ("guards?", "forces?")
ORDINAL = r"(?:first|second|third|fourth|\d+(?:st|nd|rd|th))"
_ANY, _CLEAR = "|".join(ROLES), "|".join(r for r in ROLES if r not in AMBIGUOUS)
_END = r"(?![\p{L}\p{N}_])"
_ROLE = rf"(?:{ORDINAL}\s+)?(?:diplomatic\s+|imperial\s+)?(?:{_ANY}){_END}"
_VERB = rf"\s+(?:(?:is|are|was|were|has|have|had|will|can|must){_END}|[a-zà-ÿ]+ed(?=\s*(?:[.;!?]|$)|\s+(?:the|a|an|to|from|beside|near|at|in|on|with|toward){_END}))"
_TAIL = rf"(?:{_VERB}|\s*(?:[,.;!?]|$)|\s+(?!(?:the|a|an|his|her|its|their){_END})\p{{L}}+\s+(?:the|a|an|at|in|on|to|from|beside|near|with){_END})"
_OPEN = r"(?:^|[^\p{L}\p{N}])"
#: (rule, what ends before the name, what begins after it); an empty pattern asks for nothing.  source: units; else mentions.
RULES = (
    ("possessive", "", rf"^['’]s\s+{_ROLE}"),
    ("of", rf"{_OPEN}{_ROLE}\s+of\s+(?:the\s+)?$", ""),
    ("and_their", "", rf"^\s+and\s+(?:his|her|their|its)\s+{_ROLE}"),
    ("clear", "", rf"^\s+(?:{ORDINAL}\s+)?(?:diplomatic\s+)?(?:{_CLEAR}){_END}"),
)
SOURCE_RULES = (
    *RULES,
    ("with_verb", "", rf"^\s+{_ROLE}(?={_VERB})"),
    ("determined", rf"{_OPEN}(?:a|an|the|these|those|some|several|many|both|all)\s+$", rf"^\s+{_ROLE}(?={_TAIL})"),
    ("numbered", rf"{_OPEN}{ORDINAL}\s+$", rf"^\s+(?:imperial\s+)?(?:{_ANY}){_END}(?={_VERB})"),
)
MENTION_RULES = (*RULES, ("plain", "", rf"^\s+{_ROLE}"))
ROLE_ONLY = rf"(?i)^(?:(?:the|a|an|both|his|her|their|its)\s+)?(?:{ORDINAL}\s+)?(?:diplomatic\s+)?(?:{_ANY})$"
SHORT = rf"(?:the|a|an|both|his|her|their|its)\s+(?:{ORDINAL}\s+)?(?:diplomatic\s+)?(?:{_ANY}){_END}"


def role_key(text: Column) -> Column:
    """role and ordinal that a phrase states; role null where it states none."""
    said = F.regexp_replace(F.regexp_extract(F.lower(text), rf"{_OPEN}({_ANY}){_END}", 1), r"^diplomatic\s+", "")
    one = F.when(said == "armies", "army").when(said.endswith("s"), F.substr(said, F.lit(1), F.char_length(said) - 1)).otherwise(said)
    number = F.regexp_extract(F.lower(text), rf"{_OPEN}({ORDINAL}){_END}", 1)
    return F.struct(F.when(said != "", one).alias("role"), F.when(number != "", number).alias("ordinal"))


def _names(entities: DataFrame) -> DataFrame:
    """id, name of entities (id, name, aliases), and the adjective that a one-word name makes (Vostria: vostrian)."""
    named = safe_names(entities.select("id", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names")), every=True)
    word = entities.where(F.col("name").rlike(r"^\p{L}+$")).select("id", F.lower("name").alias("n"))
    made = F.when(F.col("n").endswith("a"), F.concat("n", F.lit("n"))).when(F.col("n").endswith("e"), F.concat(F.substr("n", F.lit(1), F.char_length("n") - 1), F.lit("ian")))
    return named.unionByName(word.select("id", made.alias("name")).where("name IS NOT NULL")).distinct()


def _alike(entities: DataFrame) -> DataFrame:
    """id, names, several: of entities that have all their names in common, which no text tells apart, the least id."""
    each = _names(entities).groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("names"))  # an entity's own names
    return each.groupBy("names").agg(F.min("id").alias("id"), (F.min("id") < F.max("id")).alias("several"))


def stated_roles(texts: DataFrame, keys: list[str], names: DataFrame, rules: tuple) -> DataFrame:
    """keys, id, role, ordinal, rule of what texts (keys, text) state of those that have names (id, name)."""
    return by_text(texts, keys, lambda each, own: _stated_roles(each, own, names, rules))


def _stated_roles(texts: DataFrame, keys: list[str], names: DataFrame, rules: tuple) -> DataFrame:
    texts = texts.where(F.lower("text").rlike(_ANY))  # others state no role
    spans = name_spans(texts, keys, names).select(*keys, "id", "start", "stop").distinct()
    # texts are cut into tokens after the exchange
    met = spans.join(texts.select(*keys, "text"), keys).withColumns({"full": F.regexp_extract_all("text", F.lit(TOKEN_AND_GAP), F.lit(0)), "bare": F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))})
    first = F.greatest(F.lit(1), F.col("start") - (AROUND - 1))
    head = F.when(F.col("start") < AROUND, F.regexp_extract("text", r"^[^\p{L}\p{N}]*", 0)).otherwise("")
    before = F.concat(head, F.array_join(F.slice("full", first, F.col("start") + 1 - first), ""))
    last = F.element_at("full", F.col("stop"))
    after = F.concat(F.substr(last, F.char_length(F.element_at("bare", F.col("stop"))) + 1, F.char_length(last)), F.array_join(F.slice("full", F.col("stop") + 1, F.lit(AROUND)), ""))
    met = met.select(*keys, "id", before.alias("before"), after.alias("after"))

    def phrase(rule: tuple) -> Column:
        name, left, right = rule
        fits = (F.col("before").rlike(f"(?iu){left}") if left else F.lit(True)) & (F.col("after").rlike(f"(?iu){right}") if right else F.lit(True))
        said = F.concat_ws(" ", *([F.regexp_extract("before", f"(?iu){left}", 0)] if left else []), *([F.regexp_extract("after", f"(?iu){right}", 0)] if right else []))
        return F.when(fits, F.struct(F.lit(name).alias("rule"), said.alias("said")))

    each = met.select(*keys, "id", F.explode(F.array_compact(F.array(*[phrase(r) for r in rules]))).alias("p"))
    return each.select(*keys, "id", "p.rule", role_key(F.col("p.said")).alias("k")).select(*keys, "id", "rule", "k.*").where("role IS NOT NULL")


def _short_forms(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, short_forms (roles that a text repeats in short), numbers (ordinals before a role) of all texts (keys, text)."""
    said = F.transform(F.regexp_extract_all("text", F.lit(f"(?iu){_OPEN}({SHORT})"), F.lit(1)), role_key)
    numbers = F.regexp_extract_all(F.lower("text"), F.lit(rf"{_OPEN}({ORDINAL})\s+(?:{_ANY}){_END}"), F.lit(1))
    return texts.select(*keys, said.alias("short_forms"), numbers.alias("numbers"))


def registry(units: DataFrame, entities: DataFrame) -> DataFrame:
    """doc, unit, place, context, id, role, ordinal: a row per role that a unit (doc, unit, place, context, text) states of an entity."""
    return _registry(units, _names(entities))


def _registry(units: DataFrame, names: DataFrame) -> DataFrame:
    keys = ["doc", "unit", "place", "context"]
    return stated_roles(units.select(*keys, "text"), keys, names, SOURCE_RULES).drop("rule").distinct()


def resolve_descriptors(mentions: DataFrame, cited: DataFrame, units: DataFrame, entities: DataFrame) -> DataFrame:
    """mention, id, how, unit of mentions (mention, claim, text) that descriptors resolve.

    cited: claim, doc, unit.  how: cited (the role is stated in a cited unit), near (stated in a unit of the same context near
    one, and a cited unit repeats it in short: "the guards"), earlier (a numbered role that the document gives to one parent
    alone and has stated before; a cited unit repeats the number).  Each needs one parent; a mention that names a parent takes
    no other.  unit is the last that states it.
    """
    # parents of the same names are stated and named together: one row stands for them, and several are no one parent
    alike = materialize(_alike(entities), "parents")
    names = alike.select("id", F.explode("names").alias("name"))
    known = materialize(_registry(units, names).join(alike.select("id", "several"), "id"), "registry")
    asks = lambda each, keys: each.select(*keys, F.col("text").alias("t"), role_key(F.col("text")).alias("k"), F.col("text").rlike(ROLE_ONLY).alias("bare")).select(*keys, F.col("t").alias("text"), "k.*", "bare").where("role IS NOT NULL")
    own = materialize(by_text(mentions.select("mention", "claim", "text"), ["mention", "claim"], asks), "descriptors")
    declared = stated_roles(own.where("NOT bare").select("mention", "text"), ["mention"], names, MENTION_RULES).select("mention", F.col("id").alias("own_id")).distinct()
    declared = materialize(declared, "declared")
    # what a unit says in short is read from its text before a claim cites it; texts are not exchanged
    place = by_text(units.select("doc", "unit", "place", "context", "text"), ["doc", "unit", "place", "context"], _short_forms)
    direct = cited.select("claim", "doc", "unit").distinct().join(place, ["doc", "unit"])
    same_key = lambda df: df.where((F.col("k_role") == F.col("role")) & F.col("k_ordinal").eqNullSafe(F.col("ordinal")))
    asked = own.select("mention", "claim", "bare", F.col("role").alias("k_role"), F.col("ordinal").alias("k_ordinal"))
    at = asked.join(direct.select("claim", "doc", F.col("unit").alias("d_unit"), F.col("place").alias("d_place"), "short_forms", "numbers"), "claim")
    shorthand = F.exists("short_forms", lambda k: (k["role"] == F.col("k_role")) & k["ordinal"].eqNullSafe(F.col("k_ordinal")))
    number = F.col("k_ordinal").isNotNull() & F.exists("numbers", lambda x: x == F.col("k_ordinal"))
    at = at.withColumn("short", F.coalesce(shorthand, F.lit(False)) | number).withColumn("number", number).drop("short_forms", "numbers")
    at = materialize(at, "asked")

    def alone(found: DataFrame, how: str, unnamed: bool) -> DataFrame:
        """Of found (mention, bare, id, several, unit, place) the one parent, of those that the mention itself names."""
        fits = found.join(declared, "mention", "left").withColumn("names", F.col("own_id").isNotNull())
        free = F.col("bare") | (~F.col("names") if unnamed else F.lit(False))
        fits = fits.where(free | (F.col("own_id") == F.col("id")))
        one = fits.groupBy("mention").agg(F.min("id").alias("id"), F.max("id").alias("top"), F.max("several").alias("several"), F.max(F.struct("place", "unit"))["unit"].alias("unit"))
        return one.where("id = top AND NOT several").select("mention", "id", F.lit(how).alias("how"), "unit")

    records = known.select("doc", "unit", "place", "context", "id", "several", "role", "ordinal")
    here = same_key(at.withColumn("unit", F.col("d_unit")).join(records.drop("context"), ["doc", "unit"]))
    first = alone(here, "cited", unnamed=False)
    repeats = at.where("short").withColumn("step", F.explode(F.sequence(F.lit(NEAR[0]), F.lit(NEAR[1])))).withColumn("place", F.col("d_place") + F.col("step"))
    # units between a near unit and the cited one have its context as well
    along = Window.partitionBy("doc").orderBy("place")
    stretches = units.select("doc", "unit", "place", "context").withColumn("new", F.coalesce((~F.col("context").eqNullSafe(F.lag("context").over(along))).cast("int"), F.lit(1)))
    stretches = materialize(stretches.select("doc", "unit", "place", F.sum("new").over(along).alias("stretch")), "stretches")
    near = repeats.join(stretches.select("doc", "place", "stretch"), ["doc", "place"]).join(stretches.select("doc", F.col("place").alias("d_place"), F.col("stretch").alias("d_stretch")), ["doc", "d_place"])
    near = near.where("stretch = d_stretch AND step <> 0").join(records.drop("context"), ["doc", "place"])
    second = alone(same_key(near), "near", unnamed=True)
    parents = records.where("ordinal IS NOT NULL").groupBy("doc", "role", "ordinal").agg(F.min("id").alias("low"), F.max("id").alias("id"), F.max("several").alias("several")).where("low = id AND NOT several").drop("low", "several")
    numbered = records.join(parents, ["doc", "role", "ordinal", "id"], "left_semi")
    asks = at.where("number").groupBy("mention", "bare", "doc", "k_role", "k_ordinal").agg(F.min("d_place").alias("d_place"))
    before = asks.join(numbered.select("doc", F.col("role").alias("k_role"), F.col("ordinal").alias("k_ordinal"), "unit", "place", "id", "several"), ["doc", "k_role", "k_ordinal"]).where("place < d_place")
    third = alone(before, "earlier", unnamed=True)
    taken = first.select("mention")
    second = second.join(taken, "mention", "left_anti")
    third = third.join(taken.unionByName(second.select("mention")), "mention", "left_anti")
    return first.unionByName(second).unionByName(third)

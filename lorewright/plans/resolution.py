"""Entity resolution: identities, components, duplicate candidates, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.functions.text import normalize_name, tokens_of
from lorewright.operators.components import connected_components
from lorewright.operators.ranking import rank_in_groups
from lorewright.plans.base import PARTS, parts, registrar, table
from lorewright.storage import in_tasks, materialize, spread, tasks_for

QUERIES: dict = {}
register = registrar(QUERIES)

#: Fixed values.
ARTICLES = ("a", "an", "the")
TOKEN_STOPWORDS = ("a", "an", "the", "of")
POLITY_SUFFIXES = ("empire", "kingdom", "republic", "nation", "realm")
ORGANIZATION_QUALIFIERS = ("army", "church", "cult", "empire", "guard", "guild", "inquisitors", "kingdom", "knights", "nation", "order", "realm", "republic")
NPC_TITLES = (
    "baron", "baroness", "captain", "chancellor", "chief", "commander", "count", "countess", "doctor", "duchess", "duke", "emperor", "empress",
    "general", "governor", "high", "inquisitor", "king", "lady", "lord", "marshal", "master", "mayor", "prince", "princess", "professor",
    "queen", "saint", "sir", "supreme",
)


def identities(entities: DataFrame) -> DataFrame:
    """(id, identity): type with name and brand, type with brand and size; both normalised."""
    one = F.concat_ws(":", "type", normalize_name(F.concat_ws(" ", "name", "brand")))
    two = F.concat_ws(":", "type", normalize_name(F.concat_ws(" ", "brand", F.col("size").cast("string"))))
    return entities.select("id", F.explode(F.array(one, two)).alias("identity"))


def identity_edges(ids: DataFrame) -> DataFrame:
    """Each entity linked to the smallest of each of its identities, never all pairs."""
    first = ids.groupBy(F.col("identity").alias("f_identity")).agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return ids.join(first, F.col("identity") == F.col("f_identity")).select(F.col("id").alias("a"), "b")


def groups(entities: DataFrame) -> DataFrame:
    """(id, component) of entities that share an identity, directly or through others; singles stand alone."""
    parts_ = connected_components(identity_edges(identities(entities)))
    return entities.select("id").join(parts_, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


IDS_SQL = (
    f"{PARTS}, ids AS (SELECT id, type || ':' || trim(regexp_replace(lower(name || ' ' || brand), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS identity FROM pt "
    "UNION ALL SELECT id, type || ':' || trim(regexp_replace(lower(brand || ' ' || size), '[^\\p{L}\\p{N}]+', ' ', 'g')) FROM pt)"
).replace("{{", "{").replace("}}", "}")
COMPONENT_SQL = (
    f"WITH RECURSIVE {IDS_SQL}, e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM ids x JOIN ids y USING (identity)), "
    "r AS (SELECT id AS a, id AS b FROM pt UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), comp AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a)"
)


@register(f"WITH {IDS_SQL} SELECT id, identity FROM ids")
def candidate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities(parts(spark, sf_dir))


@register(f"{COMPONENT_SQL} SELECT id, component FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(parts(spark, sf_dir))


@register(f"{COMPONENT_SQL}, g AS (SELECT identity, count(DISTINCT component) AS n_groups, count(DISTINCT type) AS types FROM (SELECT trim(regexp_replace(lower(name || ' ' || size), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS identity, type, component FROM pt JOIN comp USING (id)) GROUP BY identity) SELECT identity, n_groups, types FROM g WHERE n_groups > 1 AND types > 1".replace("{{", "{").replace("}}", "}"))
def cross_type_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that stand in several groups and types."""
    p = parts(spark, sf_dir)
    own = p.join(groups(p), "id").select(normalize_name(F.concat_ws(" ", "name", F.col("size").cast("string"))).alias("identity"), "type", "component")
    return own.groupBy("identity").agg(F.countDistinct("component").alias("n_groups"), F.countDistinct("type").alias("types")).where("n_groups > 1 AND types > 1")


@register(f"""{COMPONENT_SQL} SELECT component, count(*) AS members, arg_min(name, id) AS first_name, arg_max(brand, (length(brand), -id)) AS longest, list_sort(list(DISTINCT name)) AS names, max(size) AS size
  FROM pt JOIN comp USING (id) GROUP BY component""")
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a group: first name, longest description (first of equals), all names."""
    p = parts(spark, sf_dir)
    return p.join(groups(p), "id").groupBy("component").agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct("id", "name")).getField("name").alias("first_name"),
        F.max(F.struct(F.length("brand"), -F.col("id"), "brand")).getField("brand").alias("longest"), F.sort_array(F.collect_set("name")).alias("names"), F.max("size").alias("size"),
    )


@register(f"""WITH {PARTS}, g AS (SELECT type || ':' || trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k, min(name) AS name, list_sort(list(id)) AS members FROM pt GROUP BY 1)
  SELECT k, name, len(members) AS members, members[1] AS first_member FROM g""".replace("{{", "{").replace("}}", "}"))
def final_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by type and normalised name, the least spelling as name."""
    k = F.concat_ws(":", "type", normalize_name(F.col("name")))
    return parts(spark, sf_dir).groupBy(k.alias("k")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("members"), F.min("id").alias("first_member"))


@register("""WITH RECURSIVE e0 AS (SELECT DISTINCT l_partkey AS a, l_partkey - l_partkey % CASE l_linenumber % 2 WHEN 0 THEN 4 ELSE 6 END AS b FROM lineitem), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
  r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS canonical FROM r GROUP BY a""")
def explicit_identity_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of explicit identity claims: every line item claims its part to be the first of its four or of its six."""
    width = F.when(F.col("l_linenumber") % 2 == 0, 4).otherwise(6)
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_partkey") - F.col("l_partkey") % width).alias("b"))
    return connected_components(claims.distinct()).select(F.col("node").alias("id"), F.col("component").alias("canonical"))


def meaningful(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(t, lambda x: ~x.isin(*TOKEN_STOPWORDS))))


def bare(t: Column) -> Column:
    return F.when(t[0].isin(*ARTICLES), F.slice(t, 2, F.greatest(F.lit(1), F.size(t)))).otherwise(t)


def core(t: Column) -> Column:
    return F.array_join(F.filter(t, lambda x: ~x.isin(*TOKEN_STOPWORDS) & ~x.isin(*ORGANIZATION_QUALIFIERS)), " ")


def distinctive(t: Column) -> Column:
    return F.filter(meaningful(t), lambda x: F.length(x) >= 5)


def stem(x: Column) -> Column:
    return F.when((F.length(x) >= 7) & x.endswith("an"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x)


def stems(t: Column) -> Column:
    return F.transform(F.filter(distinctive(t), lambda x: ~x.isin(*ORGANIZATION_QUALIFIERS)), stem)


def untitled(t: Column) -> Column:
    """Without the honorifics in front."""
    lead = F.size(F.filter(F.sequence(F.lit(1), F.size(t)), lambda k: F.forall(F.slice(t, 1, k), lambda x: x.isin(*NPC_TITLES))))
    return F.slice(t, lead + 1, F.greatest(F.lit(1), F.size(t)))


def features(pairs: DataFrame) -> Column:
    """Why a pair (l, r: struct of type, name, tokens) may be one entity; pairs with none have an empty array."""
    lt, rt = F.col("l.tokens"), F.col("r.tokens")

    ml, mr = meaningful(lt), meaningful(rt)
    short = F.when(F.size(ml) <= F.size(mr), ml).otherwise(mr)
    long = F.when(F.size(ml) <= F.size(mr), mr).otherwise(ml)
    same_type, same = F.col("l.type") == F.col("r.type"), F.array_join(lt, " ") == F.array_join(rt, " ")
    inside = F.size(F.array_except(short, long)) == 0
    reorder = same_type & ~same & (F.size(ml) >= 2) & (ml == mr)
    both = (F.size(ml) >= 2) & (F.size(mr) >= 2)
    # one stripped name may have one word more if a title was there
    ul, ur = untitled(lt), untitled(rt)
    us, ug = F.when(F.size(ul) <= F.size(ur), ul).otherwise(ur), F.when(F.size(ul) <= F.size(ur), ur).otherwise(ul)
    titled = (F.size(ul) < F.size(lt)) | (F.size(ur) < F.size(rt))
    npc = (F.col("l.type") == "npc") & (F.col("r.type") == "npc")
    variant = npc & ((ul == ur) | titled & (F.size(us) >= 1) & (F.size(ug) == F.size(us) + 1) & (F.size(F.array_except(us, ug)) == 0))
    # "X" and "Xian empire": one word against a stem of it and a word for a polity
    ts, tg = F.when(F.size(lt) <= F.size(rt), lt).otherwise(rt), F.when(F.size(lt) <= F.size(rt), rt).otherwise(lt)
    factions = (F.col("l.type") == "faction") & (F.col("r.type") == "faction") & (F.size(ts) == 1) & (F.size(tg) == 2)
    polity = factions & F.get(tg, F.lit(1)).isin(*POLITY_SUFFIXES) & (F.length(ts[0]) >= 5) & (tg[0].startswith(ts[0]) | ts[0].startswith(tg[0]))
    rules = [
        ("exact_name", same),
        ("article_variant", ~same & (bare(lt) == bare(rt))),
        ("token_reorder", reorder),
        ("conservative_subset", same_type & both & inside & (F.size(long) == F.size(short) + 1)),
        ("npc_title_variant", variant),
        ("polity_formal_variant", polity),
        ("name_contains_distinctive", (F.size(short) >= 1) & inside & F.exists(short, lambda x: F.length(x) >= 5) & (short != long)),
        ("organization_qualifier_variant", (F.length(core(lt)) >= 5) & (core(lt) == core(rt)) & ~same),
        ("shared_distinctive_stem", F.arrays_overlap(stems(lt), stems(rt)) & ~same & ~reorder),
    ]
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules]))


_WORDS = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"
_BLOCKED = (
    r"""nm AS (SELECT id, type, trim(regexp_replace(lower(brand || ' of the ' || name), '[^\p{L}\p{N}]+', ' ', 'g')) AS name FROM pt),
  tk AS (SELECT *, string_split(name, ' ') AS t FROM nm),
  m AS (SELECT *, list_sort(list_distinct(list_filter(t, lambda x: x NOT IN STOP))) AS mt, array_to_string(list_filter(t, lambda x: x NOT IN STOP AND x NOT IN QUAL), ' ') AS core,
    array_to_string(CASE WHEN t[1] IN ARTS THEN t[2:] ELSE t END, ' ') AS bare FROM tk),
  ms AS (SELECT *, list_filter(mt, lambda x: length(x) >= 5) AS d FROM m),
  st AS (SELECT *, list_transform(list_filter(d, lambda x: x NOT IN QUAL), lambda x: CASE WHEN length(x) >= 7 AND x LIKE '%an' THEN x[1:length(x) - 1] ELSE x END) AS s,
    list_transform(d, lambda x: CASE WHEN length(x) >= 7 AND x LIKE '%an' THEN x[1:length(x) - 1] ELSE x END) AS ds FROM ms),
  ks AS (SELECT id, unnest([{'f': 0, 'k': name}, {'f': 1, 'k': bare}, {'f': 2, 'k': type || ':' || array_to_string(mt, '|')}, {'f': 3, 'k': core}, {'f': 5, 'k': array_to_string(list_sort(ds), '|')}]) AS u FROM st
    UNION ALL SELECT id, unnest(list_transform(d, lambda x: {'f': 7, 'k': x})) FROM st UNION ALL SELECT id, unnest(list_transform(list_distinct(s), lambda x: {'f': 8, 'k': x})) FROM st),
  b AS (SELECT DISTINCT id, u.f AS f, u.k AS k FROM ks WHERE length(u.k) >= 3), blk AS (SELECT *, count(*) OVER (PARTITION BY f, k) AS n FROM b),
  dr AS (SELECT id, type || ':' || array_to_string(list_concat(mt[1:i - 1], mt[i + 1:]), '|') AS k FROM (SELECT *, unnest(range(1, len(mt) + 1)) AS i FROM st WHERE len(mt) >= 3)),
  ids AS (SELECT x.id AS left_id, y.id AS right_id FROM blk x JOIN blk y ON x.f = y.f AND x.k = y.k AND x.id < y.id WHERE x.n <= 40
    UNION SELECT least(dr.id, y.id), greatest(dr.id, y.id) FROM dr JOIN blk y ON y.f = 2 AND y.k = dr.k AND y.id <> dr.id WHERE y.n <= 40),
  pw AS (SELECT left_id, right_id, x.name = y.name AS same, x.type = y.type AS st, x.mt AS lm, y.mt AS rm, x.core AS lc, y.core AS rc, x.s AS ls, y.s AS rs, x.bare = y.bare AS bares,
    CASE WHEN len(x.mt) <= len(y.mt) THEN x.mt ELSE y.mt END AS sh, CASE WHEN len(x.mt) <= len(y.mt) THEN y.mt ELSE x.mt END AS lg FROM ids JOIN st x ON x.id = left_id JOIN st y ON y.id = right_id),
  fe AS (SELECT left_id, right_id, same AS exact, NOT same AND bares AS article, st AND NOT same AND len(lm) >= 2 AND lm = rm AS reorder,
    st AND len(lm) >= 2 AND len(rm) >= 2 AND len(lg) = len(sh) + 1 AND len(list_intersect(sh, lg)) = len(sh) AS subset,
    len(sh) >= 1 AND len(list_intersect(sh, lg)) = len(sh) AND len(list_filter(sh, lambda x: length(x) >= 5)) > 0 AND sh <> lg AS contained,
    length(lc) >= 5 AND lc = rc AND NOT same AS core, len(list_intersect(ls, rs)) > 0 AS stems FROM pw),
  pr AS (SELECT * REPLACE (stems AND NOT exact AND NOT reorder AS stems) FROM fe WHERE exact OR article OR reorder OR subset OR contained OR core OR stems)""".replace("STOP", _WORDS(TOKEN_STOPWORDS))
    .replace("QUAL", _WORDS(ORGANIZATION_QUALIFIERS)).replace("ARTS", _WORDS(ARTICLES))
)


def block_keys(entities: DataFrame) -> DataFrame:
    """(id, f, k): the keys under which an entity meets others, by family: 0 name, 1 without its article, 2 type and sorted
    meaningful words, 3 without qualifiers of organisations, 4 without titles (people), 5 sorted stems, 7 a longer word, 8 its
    stem.  Family 6, the key of family 2 less one word, meets only whole keys of that family."""
    t = F.col("tokens")
    whole = {
        0: F.col("name"), 1: F.array_join(bare(t), " "), 2: F.concat_ws(":", "type", F.array_join(meaningful(t), "|")), 3: core(t),
        4: F.when(F.col("type") == "npc", F.array_join(untitled(t), " ")), 5: F.array_join(F.array_sort(F.transform(distinctive(t), stem)), "|"),
    }
    key = lambda f, k: F.struct(F.lit(f).alias("f"), k.alias("k"))
    each = [F.transform(distinctive(t), lambda x: key(7, x)), F.transform(F.array_distinct(stems(t)), lambda x: key(8, x))]
    return entities.select("id", F.explode(F.concat(F.array(*[key(f, k) for f, k in whole.items()]), *each)).alias("u")).select("id", "u.f", "u.k").where(F.length("k") >= 3)


#: Entities of a task, each of which gives some fifteen keys; pairs of a task.
ENTITIES, PAIRS = 20_000, 200_000


def with_ends(pairs: DataFrame, entities: DataFrame, tasks: int) -> DataFrame:
    """pairs (left_id, right_id, ...) with both entities as l and r (type, name, tokens), each exchange in that many tasks."""
    of = entities.select("id", F.struct("type", "name", "tokens").alias("e"))
    side = lambda end, e: of.select(F.col("id").alias(end), F.col("e").alias(e)).repartition(tasks, end).hint("merge")
    left = pairs.repartition(tasks, "left_id").join(side("left_id", "l"), "left_id")
    return left.repartition(tasks, "right_id").join(side("right_id", "r"), "right_id")


def blocked_pairs(entities: DataFrame, most: int = 40) -> DataFrame:
    """Distinct pairs with a reason that share a block key of at most that many entities; entities: id, type, name (normalised).

    Keys and pairs carry ids only; what the reasons need is joined to the distinct pairs.
    """
    own = materialize(entities.withColumn("tokens", F.split("name", " ")), "named")
    # a key's first entities, one more than it may have, come from each task, so no task gets a frequent word's entities
    block = Window.partitionBy("f", "k")
    first = block_keys(spread(own, ENTITIES, "id")).withColumn("place", F.dense_rank().over(block.orderBy("id"))).where(F.col("place") <= most + 1)
    small = first.withColumn("n", F.max("place").over(block)).where(F.col("n") <= most)
    tasks = tasks_for(own, ENTITIES)
    with in_tasks(own.sparkSession, tasks):
        keys = materialize(small.select("id", "f", "k").distinct(), "blocks")
    other = keys.select("f", "k", F.col("id").alias("right_id"))
    met = keys.join(other.hint("merge"), ["f", "k"]).where("id < right_id").select(F.col("id").alias("left_id"), "right_id")
    words = own.select("id", "type", meaningful(F.col("tokens")).alias("m")).where(F.size("m") >= 3)
    less = F.transform(F.sequence(F.lit(1), F.size("m")), lambda i: F.concat_ws(":", "type", F.array_join(F.concat(F.slice("m", F.lit(1), i - 1), F.slice("m", i + 1, F.size("m"))), "|")))
    fewer = words.select("id", F.explode(less).alias("k")).join(other.where("f = 2").hint("merge"), "k").where("id <> right_id")
    met = met.unionByName(fewer.select(F.least("id", "right_id").alias("left_id"), F.greatest("id", "right_id").alias("right_id"))).distinct()
    with in_tasks(own.sparkSession, tasks):
        met = materialize(met, "met")
    pairs = with_ends(met, own, max(tasks, tasks_for(met, PAIRS)))
    return pairs.withColumn("reasons", features(pairs)).where(F.size("reasons") > 0).select("left_id", "right_id", "l", "r", "reasons")


@register(f"WITH {PARTS}, {_BLOCKED} SELECT left_id, right_id, exact, article, reorder, subset, contained, core, stems FROM pr")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked pairs with their signals (names of parts hold no titles and no polities)."""
    own = parts(spark, sf_dir).select("id", "type", normalize_name(F.concat_ws(" of the ", "brand", "name")).alias("name"))
    signals = {
        "exact": "exact_name", "article": "article_variant", "reorder": "token_reorder", "subset": "conservative_subset", "contained": "name_contains_distinctive",
        "core": "organization_qualifier_variant", "stems": "shared_distinctive_stem",
    }
    return blocked_pairs(own).select("left_id", "right_id", *[F.array_contains("reasons", reason).alias(name) for name, reason in signals.items()])


@register(f"""WITH RECURSIVE {PARTS}, {_BLOCKED}, e AS (SELECT left_id AS a, right_id AS b FROM pr UNION ALL SELECT right_id, left_id FROM pr), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a) SELECT component, count(*) AS members FROM c GROUP BY component""")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = parts(spark, sf_dir).select("id", "type", normalize_name(F.concat_ws(" of the ", "brand", "name")).alias("name"))
    found = connected_components(blocked_pairs(own).select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))


@register(f"""{COMPONENT_SQL}, d AS (SELECT a AS x, b AS y, (a + b) % 5 = 0 AS merges FROM e WHERE a < b), bad AS (SELECT DISTINCT component FROM d JOIN comp ON id = x WHERE NOT merges),
  u AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS pages, count(*) AS sources FROM lineitem GROUP BY 1)
  SELECT component, arg_min(id, (-coalesce(pages, 0), -coalesce(sources, 0), size % 3 = 0, name, id)) AS canonical, count(*) AS members FROM comp JOIN pt USING (id) LEFT JOIN u USING (id)
  WHERE component NOT IN (SELECT component FROM bad) GROUP BY component HAVING count(*) > 1""")
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose decisions are all to merge, and their canonical member: most pages, most sources, no fallback type (here every third size), then name, id."""
    p = parts(spark, sf_dir)
    ids = identities(p)
    of = materialize(groups(p), "groups")
    # two ids of an identity merge if their sum is a multiple of 5: all pairs do if all residues r are opposite each other,
    # which residues by identity tell without any pair (only r = 0 is its own opposite; two ids at most meet otherwise)
    residues = ids.groupBy("identity").agg(F.count_distinct("id").alias("n"), F.max(F.col("id") % 5).alias("high"), F.min(F.col("id") % 5).alias("low"))
    all_merge = (F.col("n") == 1) | (F.col("high") == 0) | (F.col("n") == 2) & (F.col("high") + F.col("low") == 5)
    refused = residues.where(~all_merge).select("identity")
    bad = ids.join(refused, "identity", "left_semi").select("id").distinct().join(of, "id").select("component").distinct()
    use = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.countDistinct("l_orderkey").alias("pages"), F.count(F.lit(1)).alias("sources"))
    own = of.join(bad, "component", "left_anti").join(p, "id").join(use, "id", "left").na.fill(0, ["pages", "sources"])
    best = F.min(F.struct(-F.col("pages"), -F.col("sources"), (F.col("size") % 3 == 0).alias("other"), "name", "id")).getField("id")
    return own.groupBy("component").agg(best.alias("canonical"), F.count(F.lit(1)).alias("members")).where("members > 1")


@register(f"""{COMPONENT_SQL}, n AS (SELECT component, trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k, name, id FROM comp JOIN pt USING (id))
  SELECT component, list_sort(list(alias)) AS aliases FROM (SELECT component, k, arg_max(name, id) AS alias FROM n GROUP BY ALL) GROUP BY component""".replace("{{", "{").replace("}}", "}"))
def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of merged entities by normalised key; the last spelling of a key stays."""
    p = parts(spark, sf_dir)
    own = p.join(groups(p), "id").groupBy("component", normalize_name(F.col("name")).alias("k")).agg(F.max(F.struct("id", "name")).getField("name").alias("alias"))
    return own.groupBy("component").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))


@register(f"""WITH {PARTS}, n AS (SELECT id, type, string_split(trim(regexp_replace(lower('lord ' || name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS t FROM pt WHERE size <= 25
  UNION ALL SELECT id, type, string_split(trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') FROM pt WHERE size > 25)
  SELECT a.id AS titled, min(b.id) AS plain FROM n a JOIN n b ON a.type = b.type AND len(b.t) < len(a.t) AND a.t[len(a.t) - len(b.t) + 1:] = b.t AND a.t[1] = 'lord' GROUP BY a.id""".replace("{{", "{").replace("}}", "}"))
def title_stripped_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are another's suffix after honorifics only: every honorific-stripped suffix is a join key."""
    p = parts(spark, sf_dir)
    titled = p.where("size <= 25").select("id", "type", tokens_of(F.concat(F.lit("lord "), "name")).alias("t"))
    plain = p.where("size > 25").select("id", "type", tokens_of(F.col("name")).alias("t"))
    lead = F.filter(F.sequence(F.lit(1), F.size("t") - 1), lambda k: F.forall(F.slice("t", 1, k), lambda x: x.isin(*NPC_TITLES)))
    cut = titled.select(F.col("id").alias("titled"), "type", F.explode(F.transform(lead, lambda k: F.array_join(F.slice("t", k + 1, F.size("t")), " "))).alias("k"))
    # equal names of a type meet as one row, so rows do not grow with the product of how many bear it on each side
    least = plain.groupBy("type", F.array_join("t", " ").alias("k")).agg(F.min("id").alias("id"))
    return cut.join(least, ["type", "k"]).groupBy("titled").agg(F.min("id").alias("plain"))


@register(f"""WITH {PARTS}, g AS (SELECT trim(regexp_replace(regexp_replace(lower(name), '^the ', ''), '[^a-z0-9]+', ' ', 'g')) AS k, type, brand, min(id) AS id, count(*) AS n FROM pt GROUP BY ALL)
  SELECT k, brand, count(*) AS types, sum(n) AS entities, count_if(n > 1) AS crowded FROM g GROUP BY k, brand HAVING count(*) > 1""")
def collision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names modulo "the" that several types share."""
    k = F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), "^the ", ""), "[^a-z0-9]+", " "))
    g = parts(spark, sf_dir).groupBy(k.alias("k"), "type", "brand").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("k", "brand").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("entities"), F.count_if(F.col("n") > 1).alias("crowded")).where("types > 1")


@register(f"""WITH {PARTS}, s AS (SELECT brand, type, count(*) AS n FROM pt GROUP BY ALL) SELECT p.id, s.type AS specific FROM pt p JOIN (SELECT brand, min(type) AS type FROM s WHERE n > 12 GROUP BY brand HAVING count(*) = 1) s USING (brand)
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.id AND l_discount < 0.005)""")
def fallback_retyping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a single specific type, only where every source proves it."""
    p = parts(spark, sf_dir)
    one = p.groupBy("brand", "type").agg(F.count(F.lit(1)).alias("n")).where("n > 12").groupBy("brand").agg(F.min("type").alias("specific"), F.count(F.lit(1)).alias("types")).where("types = 1")
    against = table(spark, sf_dir, "lineitem").where("l_discount < 0.005").select(F.col("l_partkey").alias("id"))
    return p.join(one, "brand").join(against, "id", "left_anti").select("id", "specific")


@register(f"""WITH {PARTS}, r AS (SELECT id, row_number() OVER (PARTITION BY type ORDER BY size, id) AS r FROM pt) SELECT id, CAST(floor((r - 1) / 24) AS BIGINT) AS batch FROM r""")
def bounded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each type in batches of 24 by order."""
    own = rank_in_groups(parts(spark, sf_dir).select("id", "type", "size"), "type", [F.col("size"), F.col("id")])
    return own.select("id", F.floor((F.col("rank") - 1) / 24).alias("batch"))



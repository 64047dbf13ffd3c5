"""Mentions without overlap, and identities that texts imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.operators import harvest as H
from lorewright.operators import mentions as M
from lorewright.plans.base import pages, registrar, table

QUERIES: dict = {}
register = registrar(QUERIES)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, names): benchmark passages named by their words 1-2, 1-3, 2-4 and 4, which overlap one another."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    name = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array(name(1, 2), name(1, 3), name(2, 3), name(4, 1)).alias("names"))


_GENERIC = "('captain','commander','duke','duchess','emperor','empress','general','king','knight','lady','lord','master','prince','princess','queen','sergeant','sir')"
_SAFE = rf"""bw AS (SELECT item_id AS id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
  b0 AS (SELECT DISTINCT id, trim(lower(unnest([array_to_string(w[1:2], ' '), array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' '), coalesce(w[4], '')]))) AS name FROM bw),
  nm AS MATERIALIZED (SELECT id, name, len(tk) AS w FROM (SELECT id, name, list_filter(string_split(trim(regexp_replace(name, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS tk FROM b0)
    WHERE regexp_matches(name, '^[\p{{L}}\p{{N}}]') AND regexp_matches(name, '[\p{{L}}\p{{N}}]$') AND CASE WHEN len(tk) = 1 THEN length(tk[1]) >= 4 AND tk[1] NOT IN {_GENERIC}
    ELSE len(list_filter(tk, lambda t: length(t) >= 3 AND t NOT IN {_GENERIC} AND t <> 'the')) > 0 END)""".replace("{{", "{").replace("}}", "}")


@register(rf"""WITH RECURSIVE {_SAFE}, tx AS (SELECT doc_id, text, lower(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents),
  tk AS (SELECT doc_id, text, regexp_extract_all(f, '[\p{{L}}\p{{N}}]+') AS bare, regexp_extract_all(f, '[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*') AS full_, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*') AS raw,
    length(regexp_extract(text, '^[^\p{{L}}\p{{N}}]*')) AS head FROM tx),
  rn AS (SELECT doc_id, s, w, array_to_string(full_[s + 1:s + w - 1], '') || bare[s + w] AS name FROM (SELECT doc_id, full_, bare, w, unnest(range(len(bare) - w + 1)) AS s FROM tk, (SELECT DISTINCT w FROM nm) WHERE len(bare) >= w)),
  sp AS MATERIALIZED (SELECT doc_id, id, s, s + w AS e, name FROM rn JOIN nm USING (name, w)),
  od AS MATERIALIZED (SELECT doc_id, id, s, max(e) AS e FROM sp GROUP BY ALL),
  nx AS MATERIALIZED (SELECT a.doc_id, a.id, a.s, min(b.s) AS nxt FROM od a LEFT JOIN od b ON a.doc_id = b.doc_id AND a.id = b.id AND b.s >= a.e GROUP BY ALL),
  ch AS (SELECT doc_id, id, min(s) AS s FROM od GROUP BY doc_id, id UNION ALL SELECT nx.doc_id, nx.id, nx.nxt FROM ch JOIN nx USING (doc_id, id, s) WHERE nx.nxt IS NOT NULL),
  mc AS (SELECT doc_id, id, count(*) AS mentions FROM ch GROUP BY doc_id, id),
  fs AS (SELECT doc_id, id, arg_min(s, (-length(name), name, s)) AS s FROM sp GROUP BY doc_id, id),
  ex AS (SELECT doc_id, id, mentions, text, head + length(array_to_string(raw[1:s], '')) AS p FROM mc JOIN fs USING (doc_id, id) JOIN tk USING (doc_id))
  SELECT doc_id, id, mentions, regexp_replace(substring(text, (greatest(0, least(p - 220, greatest(0, length(text) - 480))) + 1)::INT, 480), '^\s+|\s+$', '', 'g') AS excerpt FROM ex""".replace("{{", "{").replace("}}", "}"))
def source_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of benchmark passages' names in documents, without overlap, with an excerpt of each document."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.source_occurrences(passages(spark, sf_dir), texts, ["doc_id"])


def armies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, parts and customers as factions, events and npcs whose names have ordinals, titles and subjects."""
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    none = F.array().cast("array<string>")
    s, p, c = F.col("s_suppkey"), F.col("p_partkey"), F.col("c_custkey")
    army = F.concat_ws(" ", F.lit("The"), pick(M.ORDINALS, s), F.regexp_replace("s_name", "#", " "), pick((*M.ORGANIZATIONS, "riders"), F.floor(s / 24)))
    event = F.concat_ws(" ", pick((*M.EVENT_VERBS, "feast"), p), F.lit("of"), F.concat(F.lit("part"), p.cast("string")))
    npc = F.concat_ws(" ", pick((*M.TITLES, *(f"sage{k}" for k in range(200))), c), F.regexp_replace("c_name", "#", " "))
    return (
        table(spark, sf_dir, "supplier").select((s * 10).alias("id"), army.alias("name"), F.lit("faction").alias("type"), none.alias("aliases"))
        .unionByName(table(spark, sf_dir, "part").select((p * 10 + 1).alias("id"), event.alias("name"), F.lit("event").alias("type"), none.alias("aliases")))
        .unionByName(table(spark, sf_dir, "customer").select((c * 10 + 2).alias("id"), npc.alias("name"), F.lit("npc").alias("type"), none.alias("aliases")))
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts: their number picks an ordinal, an organisation, a title, a verb and how far apart words stand."""
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    k = F.col("o_orderkey")
    text = F.concat_ws(
        " ", F.lit("The"), pick(M.ORDINALS, k), F.trim(F.repeat(F.lit("grey "), (k % 6).cast("int"))), pick((*M.ORGANIZATIONS, "riders"), F.floor(k / 5)), F.lit("and the"), pick((*M.TITLES, "clerk", "cook"), F.floor(k / 3)),
        pick(("slew", "met", "murdered", "praised"), F.floor(k / 2)), F.concat(F.lit("part"), F.col("o_custkey").cast("string")), F.lit("at noon."),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_VERBS = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({v})($|[^\\p{{L}}\\p{{N}}_])') THEN '{k}' END" for k, v in M.EVENT_VERBS.items())


@register(rf"""WITH en AS (SELECT s_suppkey * 10 AS id, 'faction' AS type, string_split(lower('the ' || {_LIST(M.ORDINALS)}[s_suppkey % 24 + 1] || ' ' || replace(s_name, '#', ' ') || ' ' || {_LIST((*M.ORGANIZATIONS, "riders"))}[(s_suppkey // 24) % 7 + 1]), ' ') AS t FROM supplier
    UNION ALL SELECT p_partkey * 10 + 1, 'event', string_split({_LIST((*M.EVENT_VERBS, "feast"))}[p_partkey % 5 + 1] || ' of part' || p_partkey, ' ') FROM part
    UNION ALL SELECT c_custkey * 10 + 2, 'npc', string_split(lower({_LIST((*M.TITLES, *(f"sage{k}" for k in range(200))))}[c_custkey % 210 + 1] || ' ' || replace(c_name, '#', ' ')), ' ') FROM customer),
  tx AS (SELECT o_orderkey, 'The ' || {_LIST(M.ORDINALS)}[o_orderkey % 24 + 1] || ' ' || repeat('grey ', (o_orderkey % 6)::INT) || {_LIST((*M.ORGANIZATIONS, "riders"))}[(o_orderkey // 5) % 7 + 1] || ' and the ' || {_LIST((*M.TITLES, "clerk", "cook"))}[(o_orderkey // 3) % 12 + 1]
    || ' ' || ['slew', 'met', 'murdered', 'praised'][(o_orderkey // 2) % 4 + 1] || ' part' || o_custkey || ' at noon.' AS text FROM orders),
  tk AS (SELECT o_orderkey, text, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM tx),
  ws AS (SELECT DISTINCT o_orderkey, unnest(t) AS w FROM tk), ps AS (SELECT o_orderkey, t, unnest(range(1, len(t) + 1)) AS i FROM tk),
  pr AS (SELECT DISTINCT o_orderkey, t[i] AS o, unnest(t[i + 1:i + 4]) AS g FROM ps WHERE t[i] IN (SELECT unnest({_LIST(M.ORDINALS)}))),
  fo AS (SELECT id, list_filter(t, lambda x: list_contains({_LIST(M.ORDINALS)}, x))[1] AS o, list_filter(t, lambda x: list_contains({_LIST(M.ORGANIZATIONS)}, x))[1] AS g FROM en WHERE type = 'faction'),
  uq AS (SELECT o, g, min(id) AS id FROM fo WHERE o IS NOT NULL AND g IS NOT NULL GROUP BY o, g HAVING count(*) = 1),
  ti AS (SELECT h AS w, min(id) AS id FROM (SELECT id, unnest(list_filter(t, lambda x: list_contains({_LIST(M.TITLES)}, x))) AS h FROM en WHERE type = 'npc') GROUP BY h HAVING count(*) = 1),
  ac AS (SELECT o_orderkey, k FROM (SELECT o_orderkey, unnest([{_VERBS}]) AS k FROM tx) WHERE k IS NOT NULL),
  fd AS (SELECT o_orderkey, id, 'plural' AS rule FROM (SELECT id, left(t[-1], length(t[-1]) - 1) AS w FROM en WHERE type = 'faction' AND length(t[-1]) >= 6 AND t[-1] LIKE '%s') JOIN ws USING (w)
    UNION SELECT o_orderkey, id, 'organisation' FROM pr JOIN uq USING (o, g) UNION SELECT o_orderkey, id, 'title' FROM ws JOIN ti USING (w)
    UNION SELECT ws.o_orderkey, id, 'event' FROM (SELECT id, t[1] AS k, t[3] AS w FROM en WHERE type = 'event' AND length(t[3]) >= 5) JOIN ws USING (w) JOIN ac ON ac.o_orderkey = ws.o_orderkey AND ac.k = en_k.k)
  SELECT o_orderkey, id, string_agg(rule, ',' ORDER BY rule) AS rules FROM fd GROUP BY o_orderkey, id""".replace("WHERE type = 'event' AND length(t[3]) >= 5) JOIN ws", "WHERE type = 'event' AND length(t[3]) >= 5) en_k JOIN ws"))
def implied_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that orders' texts imply by plural, organisation, title or event, and do not name."""
    return M.bounded_context(armies(spark, sf_dir), reports(spark, sf_dir), ["o_orderkey"])


def _quoted(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _pattern(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CAPS = "(regexp_matches({0}, '\\p{{L}}') AND upper({0}) = {0} AND lower({0}) <> {0})"
_NORM = r"trim(regexp_replace(lower(surface), '[^\p{L}\p{N}]+', ' ', 'g'))"


@register(rf"""WITH pg AS (SELECT conv_id AS document_id, turn + 1 AS page, coalesce(text, '') AS text FROM conversations),
  l0 AS (SELECT document_id, page, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM pg),
  l1 AS (SELECT *, unnest(range(len(parts))) AS no FROM l0),
  ln AS (SELECT document_id, page, no, parts[no + 1] AS line, right(array_to_string(parts[greatest(1, no - 3):no], chr(10)) || CASE WHEN no > 0 THEN chr(10) ELSE '' END, {H.AROUND}) AS before,
    left(chr(10) || array_to_string(parts[no + 2:no + 5], chr(10)), {H.AROUND}) AS after FROM l1),
  pc AS (SELECT *, regexp_extract_all(line, {_pattern(H.TOKEN_AND_GAP)}) AS fl, regexp_extract_all(line, {_pattern(H.TOKEN)}) AS br, regexp_replace(line, '^\s+|\s+$', '', 'g') AS said FROM ln),
  nm AS (SELECT *, list_filter(range(1, len(br) + 1), lambda i: regexp_matches(br[i], '{H.NAMED}')) AS pos FROM pc),
  hd AS (SELECT *, length(said) BETWEEN 1 AND {H.HEADING_LENGTH} AND len(br) BETWEEN 1 AND {H.HEADING_WORDS} AND (NOT regexp_matches(said, '{H.HEADING_END}') OR {_CAPS.format('said')}) AND 2 * len(pos) >= len(br) AS heading,
    list_transform(range(1, len(pos) + 1), lambda j: coalesce(pos[j + 1] - pos[j] = 1 OR pos[j + 1] - pos[j] = 2 AND lower(br[pos[j] + 1]) IN {_quoted(H.CONNECTORS)}, false)) AS lk FROM nm WHERE len(pos) > 0),
  sj AS (SELECT *, unnest(range(1, len(pos) + 1)) AS j FROM hd), sk AS (SELECT *, unnest(range({H.MOST_NAMED})) AS k FROM sj),
  sp AS (SELECT *, pos[j] AS a, pos[j + k] AS b, lk[j] OR j > 1 AND lk[j - 1] AS several FROM sk WHERE j + k <= len(pos) AND NOT list_contains(lk[j:j + k - 1], false)),
  sx AS (SELECT *, array_to_string(fl[a:b - 1], '') || br[b] AS surface, CASE WHEN a <= 3 THEN before || regexp_extract(line, '^[^\p{{L}}]*') ELSE '' END || array_to_string(fl[greatest(1, a - 3):a - 1], '') AS near,
    substr(fl[b], length(br[b]) + 1, {H.AROUND}) || array_to_string(fl[b + 1:b + 2], '') || CASE WHEN b + 2 >= len(fl) THEN after ELSE '' END AS rest FROM sp),
  low AS (SELECT document_id, page, unnest(list_filter(regexp_extract_all(text, {_pattern(H.TOKEN)}), lambda t: length(t) >= {H.LEAST_LOWER} AND regexp_matches(t, '^\p{{Ll}}'))) AS surface FROM pg),
  lw AS (SELECT *, {_NORM} AS n FROM low), often AS (SELECT document_id, page, n FROM lw GROUP BY ALL HAVING count(*) >= {H.LEAST_REPEATS} AND n NOT IN {_quoted(H.COMMON)}),
  oc AS (SELECT document_id, page, 0 AS kind, no AS line, a, b, surface, list_filter([CASE WHEN several THEN 'title-case-span' ELSE 'capitalized-token' END, CASE WHEN heading THEN 'heading' END, CASE WHEN {_CAPS.format('surface')} THEN 'all-caps' END,
      CASE WHEN regexp_matches(near, {_pattern(H.CUE)}) THEN 'naming-cue' END, CASE WHEN regexp_matches(left(rest, 32), {_pattern(H.PREDICATE)}) THEN 'predicate-naming-cue' END, CASE WHEN regexp_matches(left(rest, 3), {_pattern(H.POSSESSIVE)}) THEN 'possessive' END], lambda x: x IS NOT NULL) AS signals,
      near = '' OR regexp_matches(near, '{H.SENTENCE_END}') AS opens FROM sx
    UNION ALL SELECT document_id, page, 1, 0, i, i, regexp_replace(xs[i + 1], '\s+', ' ', 'g'), ['wrapped-title-case-span'], false FROM (SELECT document_id, page, xs, unnest(range(len(xs))) AS i FROM (SELECT document_id, page, regexp_extract_all(text, {_pattern(H.WRAPPED)}) AS xs FROM pg))
    UNION ALL SELECT document_id, page, 2, 0, i, i, xs[i + 1], ['article-name-cue'], false FROM (SELECT document_id, page, xs, unnest(range(len(xs))) AS i FROM (SELECT document_id, page, regexp_extract_all(text, {_pattern(H.ARTICLE)}, 1) AS xs FROM pg))
    UNION ALL SELECT document_id, page, 3, 0, 0, 0, surface, ['repeated-lowercase-term'], false FROM lw SEMI JOIN often USING (document_id, page, n)),
  nz AS (SELECT *, {_NORM} AS normalized FROM oc), ok AS (SELECT *, len(regexp_extract_all(surface, {_pattern(H.TOKEN)})) > 1 OR NOT opens OR len(list_filter(signals, lambda x: x <> 'capitalized-token')) > 0 AS clear FROM nz WHERE normalized <> '' AND normalized NOT IN {_quoted(H.GENERIC)})
  SELECT document_id, normalized, list_sort(list_distinct(list(page))) AS pages, count(*) AS occurrences, list_sort(list_distinct(flatten(list(signals)))) AS signals FROM ok GROUP BY document_id, normalized HAVING count(*) > 1 OR bool_or(clear)""")
def name_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate names of every conversation, with the pages that offer them and why."""
    return H.harvest(pages(spark, sf_dir).select("document_id", "page", "text"), ["document_id"], "page").drop("surface")

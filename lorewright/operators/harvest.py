"""Lexical harvest of candidate names: a grammar of named tokens, connectors and cues over the tokens of lines.

A token is a letter and the letters, marks, apostrophes and hyphens after it; it is named if its first letter is upper
case.  Named tokens of a line are linked if they are neighbours or one connector stands between them; every run of up to
MOST_NAMED linked ones is a span.  All of it is array columns over a line and what stands around it: no text leaves its row
before it has become candidates, and no step looks further than the tokens next to a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import normalize_name

MOST_NAMED, HEADING_LENGTH, HEADING_WORDS, LEAST_LOWER, LEAST_REPEATS, AROUND = 8, 100, 10, 6, 3, 70
#: The connectors within names, words that are no names alone, common long words, words that announce a name.
CONNECTORS = ("and", "of", "the", "for", "from", "in", "into", "on", "at", "to", "with", "without", "beneath", "beyond", "de", "du", "la", "le", "von")
GENERIC = ("a", "an", "the", "this", "that", "these", "those", "chapter", "part", "page", "level", "adventure", "campaign", "contents", "introduction")
COMMON = (
    "about", "after", "again", "against", "another", "because", "before", "being", "between", "campaign", "could", "during", "every", "first", "heroes", "however",
    "other", "should", "their", "there", "these", "those", "through", "under", "until", "where", "which", "while", "would",
)
CUES = (
    "called", "named", "known as", "emperor", "empress", "king", "queen", "prince", "princess", "lord", "lady", "duke", "duchess", "city", "nation", "empire", "academy",
    "monastery", "castle", "forest", "artifact", "item", "faction", "order", "army", "inquisitor", "god", "goddess", "deity",
)
LETTERS = r"[\p{L}\p{M}'’\-]"
TOKEN, TOKEN_AND_GAP = rf"\p{{L}}{LETTERS}*", rf"\p{{L}}{LETTERS}*[^\p{{L}}]*"
NAMED = r"^[\p{Lu}\p{Lt}]"
NAMED_WORD = rf"\p{{Lu}}{LETTERS}*"
WRAPPED = rf"{NAMED_WORD}(?:\s+(?:(?:{'|'.join(CONNECTORS)})\s+)*{NAMED_WORD})+"
ARTICLE = rf"(?:^|[^A-Za-z0-9_])((?:the|a|an)\s+{NAMED_WORD})"
CUE = rf"(?i)(?:^|[^A-Za-z0-9_])(?:{'|'.join(CUES)})\s+(?:of\s+)?$"
PREDICATE = r"(?i)^\s+(?:is|was|became)\s+(?:a|an|the)(?:[^A-Za-z0-9_]|$)"
POSSESSIVE, SENTENCE_END, HEADING_END = r"^.?.?[’']s(?:[^A-Za-z0-9_]|$)", r"[.!?]\s+$", r"[.!?]$"


def _all_caps(x: Column) -> Column:
    return x.rlike(r"\p{L}") & (F.upper(x) == x) & (F.lower(x) != x)


def _heading(line: Column, tokens: Column) -> Column:
    said = F.regexp_replace(line, r"^\s+|\s+$", "")
    named = F.size(F.filter(tokens, lambda t: t.rlike(NAMED)))
    plain = F.char_length(said).between(1, HEADING_LENGTH) & F.size(tokens).between(1, HEADING_WORDS)
    return plain & (~said.rlike(HEADING_END) | _all_caps(said)) & (2 * named >= F.size(tokens))


def _spans(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind 0, line, left, right, surface, signals, opens (first of a sentence) of every span of linked named tokens."""
    pieces = lines.withColumns({"full": F.regexp_extract_all("line", F.lit(TOKEN_AND_GAP), F.lit(0)), "bare": F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))})
    pieces = pieces.withColumn("heading", _heading(F.col("line"), F.col("bare")))
    numbered = F.transform("bare", lambda t, i: F.when(t.rlike(NAMED), i + 1))  # places from 1
    pieces = pieces.withColumn("at", F.filter(numbered, lambda i: i.isNotNull())).where(F.size("at") > 0)
    joins = lambda i: F.lower(F.get("bare", i - 1)).isin(*CONNECTORS)
    follows = lambda a, b: (b - a == 1) | (b - a == 2) & joins(a + 1)
    pieces = pieces.withColumn("linked", F.transform("at", lambda p, j: F.coalesce(follows(p, F.get("at", j + 1)), F.lit(False))))
    stretch = lambda j, k: F.forall(F.slice("linked", j + 1, k), lambda x: x)
    reach = lambda j: F.filter(F.sequence(F.lit(0), F.least(F.lit(MOST_NAMED - 1), F.size("at") - 1 - j)), lambda k: stretch(j, k))
    several = lambda j: F.element_at("linked", j + 1) | F.coalesce(F.get("linked", j - 1), F.lit(False))
    span = lambda p, j, k: F.struct(p.alias("left"), F.get("at", j + k).alias("right"), several(j).alias("several"))
    spans = F.flatten(F.transform("at", lambda p, j: F.transform(reach(j), lambda k: span(p, j, k))))
    each = pieces.select(*keys, "line_no", "line", "before", "after", "heading", "full", "bare", F.explode(spans).alias("s"))
    left, right = F.col("s.left"), F.col("s.right")
    surface = F.concat(F.array_join(F.slice("full", left, right - left), ""), F.element_at("bare", right))
    head = F.regexp_extract("line", r"^[^\p{L}]*", 0)
    first = F.greatest(F.lit(1), left - 3)
    near = F.concat(F.when(left <= 3, F.concat("before", head)).otherwise(""), F.array_join(F.slice("full", first, left - first), ""))
    gap = F.substr(F.element_at("full", right), F.char_length(F.element_at("bare", right)) + 1, F.lit(AROUND))
    rest = F.concat(gap, F.array_join(F.slice("full", right + 1, F.lit(2)), ""), F.when(right + 2 >= F.size("full"), F.col("after")).otherwise(""))
    found = each.select(*keys, F.lit(0).alias("kind"), F.col("line_no").alias("line"), left.alias("left"), right.alias("right"), surface.alias("surface"), "heading", "s.several",
                        near.alias("near"), rest.alias("rest"))
    signal = lambda cond, name: F.when(cond, F.lit(name))
    signals = F.array(
        F.when(F.col("several"), "title-case-span").otherwise("capitalized-token"), signal(F.col("heading"), "heading"), signal(_all_caps(F.col("surface")), "all-caps"),
        signal(F.col("near").rlike(CUE), "naming-cue"), signal(F.substring("rest", 1, 32).rlike(PREDICATE), "predicate-naming-cue"), signal(F.substring("rest", 1, 3).rlike(POSSESSIVE), "possessive"),
    )
    opens = (F.col("near") == "") | F.col("near").rlike(SENTENCE_END)
    return found.select(*keys, "kind", "line", "left", "right", "surface", F.array_compact(signals).alias("signals"), opens.alias("opens"))


def occurrences(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, line, left, right, surface, signals, opens of all that a page (keys, text) offers as a name."""
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, r"\r?\n")
    around = pages.select(*keys, parts.alias("parts"), F.posexplode(parts).alias("line_no", "line"))
    # what stands just before and after a line is looked for in the four lines next to it
    first = F.greatest(F.lit(1), F.col("line_no") - 3)
    before = F.concat(F.array_join(F.slice("parts", first, F.col("line_no") + 1 - first), "\n"), F.when(F.col("line_no") > 0, F.lit("\n")).otherwise(""))
    after = F.concat(F.lit("\n"), F.array_join(F.slice("parts", F.col("line_no") + 2, F.lit(4)), "\n"))
    lines = around.select(*keys, "line_no", "line", before.alias("before"), F.substring(after, 1, AROUND).alias("after"))
    lines = lines.withColumn("before", F.expr(f"right(before, {AROUND})"))
    rows = [_spans(lines, keys)]

    def whole(kind: int, found: Column, signal: str) -> DataFrame:
        own = pages.select(*keys, F.posexplode(found).alias("left", "surface"))
        return own.select(*keys, F.lit(kind).alias("kind"), F.lit(0).alias("line"), "left", F.col("left").alias("right"), "surface", F.array(F.lit(signal)).alias("signals"), F.lit(False).alias("opens"))

    compact = lambda xs: F.transform(xs, lambda x: F.regexp_replace(x, r"\s+", " "))
    rows.append(whole(1, compact(F.regexp_extract_all(text, F.lit(WRAPPED), F.lit(0))), "wrapped-title-case-span"))
    rows.append(whole(2, F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(1)), "article-name-cue"))
    lower = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: (F.char_length(t) >= LEAST_LOWER) & t.rlike(r"^\p{Ll}"))
    terms = whole(3, lower, "repeated-lowercase-term").withColumn("n", normalize_name(F.col("surface")))
    often = terms.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("times")).where((F.col("times") >= LEAST_REPEATS) & ~F.col("n").isin(*COMMON)).drop("times")
    rows.append(terms.join(often, [*keys, "n"], "left_semi").select(*rows[0].columns))
    found = rows[0]
    for part in rows[1:]:
        found = found.unionByName(part)
    return found


def harvest(pages: DataFrame, chunk: list[str], page: str) -> DataFrame:
    """chunk, normalized, surface, pages, occurrences, signals of the candidates of every chunk of pages (chunk, page, text).

    Names of one word that open a sentence need a second occurrence or a signal; words of GENERIC are no names alone.  The
    surface is that of the first accepted occurrence: by page, kind, line and place.  Null texts offer nothing.
    """
    raw = occurrences(pages, [*chunk, page]).withColumn("normalized", normalize_name(F.col("surface"))).where("normalized <> ''")
    raw = raw.where(~F.col("normalized").isin(*GENERIC))
    words = F.size(F.regexp_extract_all("surface", F.lit(TOKEN), F.lit(0)))
    clear = (words > 1) | ~F.col("opens") | F.exists("signals", lambda s: s != "capitalized-token")
    place = F.struct(page, "kind", "line", "left", "right", "surface")
    # one that is not clear counts if it is not the only one, so groups of two or more are whole
    counted = raw.groupBy(*chunk, "normalized").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(clear).alias("clear"), F.min(place).alias("first"),
        F.sort_array(F.collect_set(page)).alias("pages"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals"),
    )
    return counted.where((F.col("all") > 1) | (F.col("clear") > 0)).select(*chunk, "normalized", F.col("first.surface").alias("surface"), "pages", F.col("all").alias("occurrences"), "signals")

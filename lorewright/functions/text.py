"""Normalisers and text predicates as columns. The normalisers differ on purpose; none replaces another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Titles that are no safe mention by themselves.
GENERIC_TITLES = (
    "captain", "commander", "duke", "duchess", "emperor", "empress", "general", "king", "knight",
    "lady", "lord", "master", "prince", "princess", "queen", "sergeant", "sir",
)

#: The wordings and bounds of purchaser marks, page numbers and lines that are no titles.
WATERMARK = r"(?i)\b(?:order\s*#?\s*\d+\)?\s*$|customer\s*(?:id|number|#)\s*[:#]?\s*\d+\s*$|downloaded\s+(?:by|for)|purchased\s+by|copyright|all rights reserved)"
WATERMARK_LENGTH, TITLE_LENGTHS, TITLE_WORDS, NO_TITLE_SIGNS = 180, (8, 100), 10, r"[.!?;:,()#]"
PAGE_NUMBER = r"(?i)^(?:[-–—•·*]\s*)?(?:page\s*)?\d{1,4}(?:\s*(?:of|/|\|)\s*\d{1,4})?(?:\s*[-–—•·*])?$"
NO_TITLE = r"(?i)^(?:a|an|if|when|while|each|any|some|many|several)\s"


def _gaps_to_space(x: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(x, pattern, " "))


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKC")


@F.pandas_udf(StringType())
def _nfkd(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKD")


def compatible(x: Column) -> Column:
    """NFKC: ligatures, full-width and other compatibility forms become plain, accents are composed.  Spark has no
    built-in for it, so Arrow batches go through Python: apply it where names and quotes come in, not in every join."""
    return _nfkc(x)


def normalize_evidence(x: Column) -> Column:
    """Compatibility decomposition without accents, lower case, runs of punctuation and signs to single spaces."""
    bare = F.lower(F.regexp_replace(_nfkd(x), r"[\x{300}-\x{36F}]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[\p{P}\p{S}]+", " "), r"\s+", " "))


def snake_key(x: Column) -> Column:
    """Lower case, runs of other characters as _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")


def once(tokens: Column) -> Column:
    """A token list without its repeats: a list has a period if it equals itself moved on by it.  The least period of two
    or more tokens that divides the list is kept; a list without one stays."""
    n = F.size(tokens)
    fits = lambda w: (n % w == 0) & (F.slice(tokens, F.lit(1), n - w) == F.slice(tokens, w + 1, n - w))
    periods = F.when(n >= 4, F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(n / 2).cast("int"))), fits))
    return F.when(F.size(periods) > 0, F.slice(tokens, F.lit(1), periods[0])).otherwise(tokens)


def normalize_name(x: Column) -> Column:
    """Lower case; every run of characters that are no letters or digits becomes a space. Null stays null."""
    return _gaps_to_space(F.lower(x), r"[^\p{L}\p{N}]+")


def normalize_fact(x: Column) -> Column:
    """Like a name, but ' + - stay, curly apostrophes become straight, and a leading a/an goes."""
    straight = F.regexp_replace(F.lower(x), "[’']", "'")
    return F.regexp_replace(_gaps_to_space(straight, r"[^\p{L}\p{N}'+-]+"), r"^(?:a|an)\s+", "")


def normalize_spaces(x: Column) -> Column:
    """Lower case and single spaces; punctuation stays."""
    return _gaps_to_space(F.lower(x), r"\s+")


def compact(line: Column) -> Column:
    return _gaps_to_space(line, r"[\t ]+")


def recurrence_key(line: Column) -> Column:
    """Compact lower-case line with whole numbers as #, to compare lines of different pages."""
    return F.regexp_replace(F.regexp_replace(F.lower(compact(line)), r"\b\d+\b", "#"), r"\s+", " ")


def normalize_page(x: Column) -> Column:
    """NUL and blanks before line ends go, three line ends or more become two, the ends are trimmed."""
    clean = F.regexp_replace(F.translate(x, "\0", ""), r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(clean, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def display_name(x: Column) -> Column:
    """The first letter in upper case, all else as it is."""
    head = F.regexp_extract(x, r"^([^\p{L}]*)(\p{L}?)", 1)
    letter = F.regexp_extract(x, r"^([^\p{L}]*)(\p{L}?)", 2)
    return F.concat(head, F.upper(letter), F.substr(x, F.length(head) + F.length(letter) + 1))


def relationship_key(source: Column, target: Column, type_: Column) -> Column:
    """Directional: no inverse is folded in."""
    return F.concat_ws("|", source.cast("string"), target.cast("string"), F.concat(F.lit("literal:"), normalize_name(type_)))


def fact_key(field: Column, content: Column) -> Column:
    digest = F.sha2(F.concat(field, F.lit("\0"), normalize_fact(content)), 256)
    return F.concat(field, F.lit(":"), F.substring(digest, 1, 24))


def is_watermark(line: Column) -> Column:
    """Purchaser marks: short lines without ! or ? that name an order, a customer, a download or a copyright."""
    return (F.length(line) <= WATERMARK_LENGTH) & ~line.rlike("[!?]") & line.rlike(WATERMARK)


def is_title_like(line: Column) -> Column:
    """8 to 100 characters, at most ten words, no digits or sentence signs, no leading article or condition word."""
    return (
        F.length(line).between(*TITLE_LENGTHS) & (F.size(F.split(line, r"\s+")) <= TITLE_WORDS) & ~line.rlike(NO_TITLE_SIGNS) & ~line.rlike(r"\d")
        & line.rlike(r"\p{L}") & ~line.rlike(NO_TITLE)
    )


def is_page_ornament(line: Column) -> Column:
    """A bare page number, perhaps with "page", "of n" and a dash or bullet."""
    return compact(line).rlike(PAGE_NUMBER)


def is_safe_mention(name: Column) -> Column:
    """One token of 4 letters or more that is no title, or any token of 3 or more that is neither title nor "the"."""
    tokens = F.split(normalize_name(name), " ")
    generic = F.array(*[F.lit(t) for t in GENERIC_TITLES])
    one = (F.length(tokens[0]) >= 4) & ~F.array_contains(generic, tokens[0])
    many = F.exists(tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(generic, t) & (t != "the"))
    return F.when(normalize_name(name) == "", False).when(F.size(tokens) == 1, one).otherwise(many)


def tokens_of(x: Column) -> Column:
    return F.filter(F.split(normalize_name(x), " "), lambda t: t != "")


def quote_matches(quote: Column, page: Column) -> Column:
    """Whether a quote is grounded in a page; both normalised.

    8 characters at least, and contained exactly; or 3 distinct tokens of 3 letters or more, of which 4 in 5 occur on
    the page and some 3 in a row stand there together.
    """
    long = F.filter(F.split(quote, " "), lambda t: F.length(t) > 2)
    distinct = F.array_distinct(long)
    shared = F.size(F.array_intersect(distinct, F.split(page, " ")))
    runs = F.transform(F.sequence(F.lit(0), F.size(long) - 3), lambda k: F.array_join(F.slice(long, k + 1, 3), " "))
    run = F.when(F.size(long) >= 3, F.exists(runs, lambda r: F.contains(page, r))).otherwise(False)
    loose = (F.size(distinct) >= 3) & run & (shared >= 0.8 * F.size(distinct))
    return (F.length(quote) >= 8) & (page != "") & (F.contains(page, quote) | loose)

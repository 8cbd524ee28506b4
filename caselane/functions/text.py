"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# Patterns that define the results. Each reads the same in Java and in RE2.
WHITESPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"
SLOT = r"\{\{[^}]+\}\}"
SLOT_NAME = r"\{\{([^}]+)\}\}"
WORD = r"[\p{L}\p{N}_]{2,}"
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
HANDLE = r"@[A-Za-z0-9_]+"
URL = r"https?://[^\s<>\x{22}']+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
HTML_ENTITY = r"&(?:[A-Za-z]+|#[0-9]+);"
HASHTAG = r"#[\p{L}\p{N}_]+"
HUMAN_REQUEST = (
    r"(?i)(?:speak|talk) (?:to|with) (?:a |an |the |your )?(?:human|person|agent|manager|representative|supervisor)",
    r"(?i)(?:real|live) (?:human|person|agent)",
)


def clean(text: Column) -> Column:
    """Missing text reads as the empty string."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.filter(F.split(clean(text), WHITESPACE), lambda w: w != "")


def char_len(text: Column) -> Column:
    return F.length(clean(text)).cast("int")


def word_len(text: Column) -> Column:
    return F.size(words(text)).cast("int")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(clean(text), F.lit(pattern)).cast("int")


def slot_count(text: Column) -> Column:
    return count_matches(text, SLOT)


def slot_names(text: Column) -> Column:
    return F.regexp_extract_all(clean(text), F.lit(SLOT_NAME), F.lit(1))


def has_all_caps(text: Column) -> Column:
    """Whether some word longer than three characters is written in capitals."""
    return F.exists(
        words(text),
        lambda w: (F.length(w) > 3) & (F.upper(w) == w) & (F.lower(w) != w),
    ).cast("int")


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(clean(text)), F.lit(WORD), F.lit(0))


def pieces(text: Column, lower: bool = True) -> Column:
    """Words and single punctuation marks, the unit that length budgets are counted in."""
    base = F.lower(clean(text)) if lower else clean(text)
    return F.regexp_extract_all(base, F.lit(PIECE), F.lit(0))


def without(items: Column, stop: list[str]) -> Column:
    """Drop the listed words, keeping order and repeats."""
    return F.filter(items, lambda w: ~w.isin(*stop)) if stop else items


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Spark repeats an expression wherever it is mentioned inside a lambda-taking function, and tokenizing a text
    again for every mention is most of the cost of building n-grams.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unigrams_and_bigrams(items: Column) -> Column:
    """The words followed by their neighbouring pairs."""

    def both(words: Column) -> Column:
        starts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        pairs = F.transform(starts, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
        return F.concat(words, pairs)

    return let(items, both)


def folded(items: Column) -> Column:
    """The distinct items in order, each a struct of ``term`` and ``tf``, how often it occurs.

    The items are sorted and runs of equals counted in place, so a row is folded before anything moves.
    """

    def runs(ordered: Column) -> Column:
        starts = F.array_compact(F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1) != x), i)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("long").alias("tf"))))

    return let(F.sort_array(items), runs)


def normalize(text: Column) -> Column:
    """Handles and links become single tokens."""
    linked = F.regexp_replace(clean(text), URL, "HTTPURL")
    return F.regexp_replace(linked, HANDLE, "@USER")


def matches_any(text: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a | b, [clean(text).rlike(p) for p in patterns])

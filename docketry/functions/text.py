"""Text hygiene, language tests and word overlap as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import vocab

# White space as Python's str methods see it; the (?U) flag alone misses 0x1c-0x1f.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
NON_WORD = r"[^\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_ws(col: Column) -> Column:
    """Every run of white space becomes one blank; ends are trimmed; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), SPACE + "+", " "))


def strip_ws(col: Column) -> Column:
    """Ends without white space of any kind."""
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words_of(col: Column) -> Column:
    """White-space separated words; NULL gives an empty array."""
    return F.filter(F.split(normalize_ws(col), " "), lambda w: w != "")


def terms_of(col: Column) -> Column:
    """Distinct lower-case word tokens longer than two characters."""
    tokens = F.split(F.lower(F.coalesce(col, F.lit(""))), NON_WORD)
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) > 2))


def term_intersection(a: Column, b: Column) -> Column:
    """Terms two term arrays share."""
    return F.array_intersect(F.array_distinct(a), F.array_distinct(b))


def keyword_overlap(query: Column, content: Column) -> Column:
    """Share of the query's terms found in the content; 0 for a query without terms."""
    return overlap_of_terms(terms_of(query), terms_of(content))


def overlap_of_terms(query: Column, content: Column) -> Column:
    """The same over term arrays."""
    return let(query, lambda q: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(q, content)) / F.size(q)))


def without_repeats(lines: Column) -> Column:
    """Drop each element equal, ignoring case, to the one before it."""
    return let(lines, lambda all_: F.filter(
        all_,
        lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.coalesce(F.get(all_, i - 1), F.lit("")))),
    ))


def tidy_lines(col: Column, drop_marks: bool) -> Column:
    """Lines with white space collapsed, without blank and page-number lines."""
    raw = F.split(F.coalesce(col, F.lit("")), LINE_BREAK)

    def tidy(line: Column) -> Column:
        if drop_marks:
            line = F.regexp_replace(line, "(?U)" + vocab.CITATION_MARK, "")
        return normalize_ws(line)

    return F.filter(
        F.transform(raw, tidy),
        lambda x: (x != "") & ~F.rlike(x, F.lit("(?U)" + vocab.PAGE_NUMBER_LINE)),
    )


def clean_context(col: Column) -> Column:
    """Text without citation marks, page-number lines, blank and repeated lines."""
    return F.array_join(without_repeats(tidy_lines(col, drop_marks=True)), "\n")


def strip_scaffold(col: Column) -> Column:
    """Answer text without prompt scaffolding and citation marks."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), "(?iU)" + vocab.SCAFFOLD, " ")
    return F.regexp_replace(text, "(?U)" + vocab.CITATION_MARK, "")


def sentences_of(col: Column) -> Column:
    """Non-blank sentences of a text."""
    parts = F.split(strip_scaffold(col), "(?U)" + vocab.SENTENCE_BREAK)
    return F.filter(F.transform(parts, strip_ws), lambda s: s != "")


def has_content(col: Column, minimum: int = 8) -> Column:
    """At least `minimum` Latin, Hebrew or Arabic letters."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(vocab.CONTENT_LETTER)) >= minimum


def detect_language(col: Column) -> Column:
    """'ar' with any Arabic character, else 'he' with any Hebrew one, else 'en'."""
    text = F.coalesce(col, F.lit(""))
    return (
        F.when(F.rlike(text, F.lit(vocab.ARABIC)), "ar")
        .when(F.rlike(text, F.lit(vocab.HEBREW)), "he")
        .otherwise("en")
    )


def contains_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found

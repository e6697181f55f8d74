"""Personal-data masking and release categories as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions.text import let


def _java(pattern: str, ignore_case: bool) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def sanitize_text(col: Column, patterns: list[tuple] = vocab.PII_PATTERNS) -> Column:
    """Mask each kind of personal data in turn -> struct(text, counts).

    A stage counts its matches on the text the stage before it produced, so an
    already masked span is never counted again. A text without the characters that
    a pattern cannot do without is not searched, and one without matches not rewritten.
    """
    kinds = [p[0] for p in patterns]

    def stage(i: int) -> Callable[[Column], Column]:
        kind, placeholder, pattern, ignore_case = patterns[i]
        regex = _java(pattern, ignore_case)

        def masked(s: Column) -> Column:
            found = F.regexp_count(s["text"], F.lit(regex))
            if pattern in vocab.PII_SIGNS:
                found = F.when(F.contains(s["text"], F.lit(vocab.PII_SIGNS[pattern])), found).otherwise(F.lit(0))
            elif pattern in vocab.PII_OF_DIGITS and plain:
                found = F.when(s["digits"], found).otherwise(F.lit(0))
            return let(F.struct(s.alias("s"), found.alias("n")), lambda x: F.struct(
                F.when(x["n"] > 0, F.regexp_replace(x["s"]["text"], regex, placeholder)).otherwise(x["s"]["text"]).alias("text"),
                x["s"]["digits"].alias("digits"), *[x["s"][k].alias(k) for k in kinds[:i]], x["n"].alias(kind)))

        return masked

    # a stage that puts digits in would make the answer for the given text useless
    plain = not any(c.isdigit() for p in patterns for c in p[1])
    state = F.struct(col.alias("text"), F.rlike(col, F.lit(r"(?U)\d")).alias("digits"))
    for i in range(len(patterns)):
        state = let(state, stage(i))

    def result(s: Column) -> Column:
        counts = F.create_map(*[v for k in kinds for v in (F.lit(k), s[k])])
        return F.struct(s["text"].alias("text"), F.map_filter(counts, lambda _, n: n > 0).alias("counts"))

    return let(state, result)


def mask_text(col: Column, patterns: list[tuple] = vocab.PII_PATTERNS) -> Column:
    """Only the text of `sanitize_text`: one replacement per kind, nothing is counted."""
    for _, placeholder, pattern, ignore_case in patterns:
        col = F.regexp_replace(col, _java(pattern, ignore_case), placeholder)
    return col


def pii_counts(col: Column, patterns: list[tuple] = vocab.PII_PATTERNS) -> Column:
    """Kind -> number of masked spans; only kinds that occur."""
    return sanitize_text(col, patterns)["counts"]


def sensitivity_level(counts: Column) -> Column:
    """low without findings, high with an id, card or account number, else medium."""
    grave_types = F.array(*[F.lit(t) for t in vocab.HIGH_SENSITIVITY_TYPES])
    return let(counts, lambda c: F.when(F.size(c) == 0, "low").when(
        F.arrays_overlap(F.map_keys(c), grave_types), "high").otherwise("medium"))


def merge_counts(*counts: Column) -> Column:
    """Sum several kind -> number maps."""
    total = counts[0]
    for other in counts[1:]:
        total = F.map_zip_with(
            total, other,
            lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        )
    return total


def prompt_type_union(*counts: Column) -> Column:
    """Sorted kinds found in any of the parts."""
    return F.array_sort(F.map_keys(merge_counts(*counts)))


def redact_text(col: Column, enabled: bool = True) -> Column:
    """Masked text that also hides 8-digit numbers -> struct(text, types)."""
    none = F.array().cast("array<string>")
    if not enabled:
        return F.struct(col.alias("text"), none.alias("types"))
    eight = F.lit(vocab.EIGHT_DIGIT_ID)

    def hide(m: Column) -> Column:
        masked, found = m["masked"], m["found"]
        more = F.when(found, F.array(F.lit("id"))).otherwise(none)
        types = F.array_sort(F.array_union(F.map_keys(masked["counts"]), more))
        return F.struct(
            F.when(found, F.regexp_replace(masked["text"], eight, "[ID]")).otherwise(masked["text"]).alias("text"),
            F.coalesce(types, none).alias("types"),
        )

    searched = let(sanitize_text(col), lambda m: F.struct(m.alias("masked"), F.rlike(m["text"], eight).alias("found")))
    return let(searched, hide)


def blocked_category(col: Column, categories: list[str] = vocab.BLOCKED_CATEGORIES) -> Column:
    """First configured category whose pattern occurs, else NULL."""
    text = F.coalesce(col, F.lit(""))
    return F.coalesce(*[
        F.when(F.rlike(text, F.lit(_java(vocab.BLOCKED_PATTERNS[c], True))), F.lit(c))
        for c in categories if c in vocab.BLOCKED_PATTERNS
    ], F.lit(None).cast("string"))


def prompt_build(problem: Column, context: Column, question: Column) -> Column:
    """The copy-and-paste request over three already masked parts."""
    return F.format_string(vocab.PROMPT_FORMAT, problem, context, question)


def truncate_context(col: Column, n: int = vocab.EXTERNAL_CONTEXT_CHARS) -> Column:
    return F.substring(col, 1, n)

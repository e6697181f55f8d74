"""Numbers, dates and small codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import vocab


# --- registration numbers and label text --------------------------------------
def normalize_registration(col: Column) -> Column:
    """Digits only; NULL becomes ''."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\D+", "")


def registration_matches(a: Column, b: Column) -> Column:
    na, nb = normalize_registration(a), normalize_registration(b)
    return (na != "") & (na == nb)


def fix_ocr_digits(col: Column) -> Column:
    """Letters that OCR confuses with digits become those digits."""
    return F.translate(col, *vocab.OCR_DIGITS)


def normalize_label(col: Column) -> Column:
    """Label text without quote variants and direction marks, ends cleaned."""
    bare = F.regexp_replace(col, "[" + vocab.LABEL_QUOTES + r"\x{200e}\x{200f}]", "")
    tidy = F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.regexp_replace(tidy, r"^[ :.\-]+|[ :.\-]+$", "")


def token_shape_flags(col: Column) -> Column:
    """struct(year, phone, money, date) of tests on one token."""
    digits = normalize_registration(col)
    n = F.length(digits)
    return F.struct(
        ((n == 4) & digits.between("1950", "2099")).alias("year"),
        (n.isin(9, 10) & F.startswith(digits, F.lit("0"))).alias("phone"),
        (F.rlike(col, F.lit(r"(?U)\d[\d,]*\.\d{2}\b")) | F.contains(col, F.lit("₪"))).alias("money"),
        F.rlike(col, F.lit(r"(?U)\b" + vocab.DAY_FIRST_TOKEN + r"\b")).alias("date"),
    )


# --- dates ---------------------------------------------------------------------
def parse_day_first(col: Column) -> Column:
    """Day-first date (d/M/yyyy or d/M/yy with / . -) or ISO date; else NULL."""
    token = F.regexp_replace(F.trim(col), "[.-]", "/")
    return F.coalesce(
        F.when(F.rlike(token, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}$")), F.try_to_date(token, "d/M/yyyy")),
        F.when(F.rlike(token, F.lit(r"^\d{1,2}/\d{1,2}/\d{2}$")), two_digit_year(token)),
        F.when(F.rlike(token, F.lit(r"^\d{4}/\d{1,2}/\d{1,2}$")), F.try_to_date(token, "yyyy/M/d")),
    )


def two_digit_year(token: Column) -> Column:
    """d/M/yy with 69-99 in the 1900s and 00-68 in the 2000s."""
    year = F.substring_index(token, "/", -1)
    century = F.when(year >= "69", "19").otherwise("20")
    full = F.concat(F.regexp_replace(token, r"\d{2}$", ""), century, year)
    return F.try_to_date(full, "d/M/yyyy")


def days_until_expiry(end: Column, today: Column) -> Column:
    return F.datediff(end, today)


def expiring_within(end: Column, today: Column, days: int) -> Column:
    return F.coalesce(days_until_expiry(end, today).between(0, days), F.lit(False))


def is_expired(end: Column, today: Column) -> Column:
    return F.coalesce(days_until_expiry(end, today) < 0, F.lit(False))


def period_starts(now: Column) -> Column:
    """struct(day, month): starts of the UTC day and month."""
    return F.struct(F.date_trunc("day", now).alias("day"), F.date_trunc("month", now).alias("month"))


# --- codes ---------------------------------------------------------------------
def coerce_classification(col: Column) -> Column:
    upper = F.upper(col)
    return F.when(upper.isin(*vocab.CLASSIFICATIONS), upper).otherwise("INTERNAL")


def confidence_band(conf: Column) -> Column:
    return F.when(conf >= 0.85, "high").when(conf >= 0.5, "medium").otherwise("low")


def confidence_gate(value: Column, conf: Column, minimum: float = 0.6) -> Column:
    return F.when(conf >= minimum, value)


def candidate_confidence(score: Column) -> Column:
    """Score on a scale of about 180 -> confidence; 150 and more give at least 0.9."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(0.99), score / 180.0))
    return F.when(score >= 150, F.greatest(base, F.lit(0.9))).otherwise(base)


def relation_confidence(score: Column, label_score: Column, token_conf: Column) -> Column:
    geometry = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 100.0))
    value = (F.lit(0.05) + F.lit(0.93) * geometry) * label_score * F.greatest(token_conf, F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), value))


def client_ip(forwarded: Column, peer: Column) -> Column:
    """First entry of a forwarding header, else the peer address."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(peer)


def document_status_label(processing: Column, indexing: Column) -> Column:
    return (
        F.when(indexing == "indexed", "indexed")
        .when(indexing == "skipped_needs_ocr", "needs OCR")
        .when(processing == "FAILED", "failed")
        .otherwise("processing")
    )


def conversation_title(title: Column, question: Column) -> Column:
    """A default title gives way to the first 60 characters of the first question."""
    current = F.coalesce(F.when(title != "", title), F.lit(vocab.DEFAULT_TITLE))
    asked = F.substring(F.trim(question), 1, 60)
    fresh = F.coalesce(F.when(asked != "", asked), F.lit(vocab.DEFAULT_TITLE))
    return F.when(current == vocab.DEFAULT_TITLE, fresh).otherwise(current)


# --- vectors -------------------------------------------------------------------
def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; 0 when either has no length."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, zero, lambda acc, p: acc + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(zero)

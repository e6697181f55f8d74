"""Fields of vehicle documents: found in text, stored, corrected, asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions.text import contains_any, detect_language, let, normalize_ws
from docketry.functions.values import normalize_registration, parse_day_first
from docketry.operators.common import top_per
from docketry.operators.policies import match_or_create_vehicle



# --- found in running text ------------------------------------------------------------
def document_type_scores(docs: DataFrame, terms: list = vocab.DOCUMENT_TERMS) -> DataFrame:
    """docs(document_id, text) -> (document_id, class, type, hits, confidence).

    The class with the most distinct terms wins, the earlier one on a tie.
    """
    def hits(words: list[str]) -> Column:
        total = F.lit(0)
        for word in words:
            total = total + F.contains(F.col("text"), F.lit(word)).cast("int")
        return total

    rated = F.array(*[
        F.struct(hits(words).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("class"),
                 F.lit(kind).alias("type"))
        for i, (name, kind, words) in enumerate(terms)])
    best = docs.select("document_id", F.array_max(rated).alias("b"))
    known = F.col("b.hits") > 0
    return best.select(
        "document_id", F.when(known, F.col("b.class")).otherwise("unknown").alias("class"),
        F.when(known, F.col("b.type")).otherwise(vocab.UNKNOWN_DOCUMENT).alias("type"),
        F.col("b.hits").alias("hits"),
        F.when(known, F.least(F.lit(0.99), F.lit(0.7) + F.lit(0.1) * F.col("b.hits"))).otherwise(0.3)
        .alias("confidence"))


def insurer_of(text: Column, signatures: list = vocab.INSURER_SIGNATURES) -> Column:
    """First insurer in list order with a signature phrase in the text, else NULL."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    return let(folded, lambda t: F.coalesce(*[
        F.when(contains_any(t, [p.lower() for p in phrases]), name) for name, phrases in signatures]))


def detect_insurer(texts: DataFrame, signatures: list = vocab.INSURER_SIGNATURES) -> DataFrame:
    """texts(doc_id, text) -> (doc_id, insurer, confidence) where one is named."""
    return texts.select("doc_id", insurer_of(F.col("text"), signatures).alias("insurer")).filter(
        "insurer is not null").withColumn("confidence", F.lit(0.95))


def _first(pattern: str, text: Column, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def detect_policy_number(text: Column) -> Column:
    return _first("(?U)" + vocab.POLICY_NUMBER, text)


def labelled_date(text: Column, labels: list[str]) -> Column:
    """struct(date, label) of the first label with a date right before or after it."""
    def named(day: Column, label: str) -> Column:
        return let(day, lambda x: F.when(
            x.isNotNull(), F.struct(x.alias("date"), F.lit(label).alias("label"))))

    tries = []
    for label in labels:
        for pattern in (
            rf"(?U)({vocab.DAY_FIRST_TOKEN})\s*:?\s*\Q{label}\E",
            rf"(?U)\Q{label}\E\s*:?\s*({vocab.DAY_FIRST_TOKEN})",
        ):
            tries.append(named(parse_day_first(_first(pattern, text, 1)), label))
    return F.coalesce(*tries)


def labelled_premium(text: Column) -> Column:
    found = F.coalesce(*[_first("(?U)" + p, text, 1) for p in vocab.PREMIUM_PATTERNS])
    return F.replace(found, F.lit(","), F.lit(""))


def extract_fields_from_text(docs: DataFrame, column: str = "text") -> DataFrame:
    """Flat-text fields in long form (document_id, field, value, confidence)."""
    text = F.coalesce(F.col(column), F.lit(""))

    def first_of(rules: list[tuple], value) -> Column:
        return F.coalesce(*[
            F.when(contains_any(text, exact) | contains_any(F.lower(text), folded), value(rule))
            for rule in rules for exact, folded in [(rule[-2], rule[-1])]])

    known = F.coalesce(
        first_of(vocab.FLAT_CLASSES, lambda r: F.struct(F.lit(r[0]).alias("value"), F.lit(r[1]).alias("confidence"))),
        F.struct(F.lit(vocab.UNKNOWN_DOCUMENT).alias("value"), F.lit(0.3).alias("confidence")))
    days = F.array_compact(F.transform(
        F.regexp_extract_all(text, F.lit("(?U)" + vocab.FLAT_DATE), F.lit(0)), parse_day_first))
    found = docs.select(
        "document_id", known.alias("kind"), _first("(?U)" + vocab.FLAT_PLATE, text).alias("plate"),
        _first("(?U)" + vocab.FLAT_VIN, text).alias("vin"),
        _first("(?iU)" + vocab.FLAT_POLICY, text, 1).alias("policy"),
        F.coalesce(*[F.when(F.contains(text, F.lit(n)), n) for n in vocab.FLAT_INSURERS]).alias("insurer"),
        first_of(vocab.FLAT_INSURANCE_TYPES, lambda r: F.lit(r[0])).alias("insurance"), days.alias("days"))

    def row(field: str, value: Column, confidence) -> Column:
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"),
                        confidence.alias("confidence"))

    rows = F.array(
        row("document_type", F.col("kind.value"), F.col("kind.confidence")),
        row("registration_number", F.when(F.col("plate").isNotNull(), normalize_registration(F.col("plate"))), 0.7),
        row("vin", F.col("vin"), 0.7), row("policy_number", F.col("policy"), 0.6),
        row("insurer", F.col("insurer"), 0.6), row("insurance_type", F.col("insurance"), 0.6),
        row("start_date", F.array_min("days"), 0.4), row("end_date", F.array_max("days"), 0.4))
    return found.select("document_id", F.explode(rows).alias("r")).select(
        "document_id", "r.field", "r.value", "r.confidence").filter("value is not null")


# --- questions for a field ---------------------------------------------------------------
def intent_of(question: Column, patterns: list = vocab.INTENT_PATTERNS,
              aliases: dict[str, str] = vocab.INTENT_ALIASES) -> Column:
    """struct(field, confidence) a question asks for; NULL field when it asks for none."""
    norm = normalize_ws(F.regexp_replace(
        F.coalesce(question, F.lit("")), vocab.QUESTION_PUNCTUATION, " "))
    lookup = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])

    def alias_of(token: Column) -> Column:
        bare = F.when(F.length(token) > 3, F.regexp_replace(token, vocab.HEBREW_PREFIX, "")).otherwise(token)
        return F.coalesce(*[F.try_element_at(lookup, t) for t in (token, F.lower(token), bare)])

    def decide(q: Column) -> Column:
        low = F.lower(q)
        full = F.coalesce(*[
            F.when(F.rlike(low, F.lit("(?iU)" + "|".join(options))), field) for field, options in patterns])
        tokens = F.filter(F.split(q, " "), lambda t: t != "")
        short = F.when(F.size(tokens) <= 3, F.get(F.array_compact(F.transform(tokens, alias_of)), F.lit(0)))
        return F.struct(
            F.coalesce(full, short).alias("field"),
            F.when(full.isNotNull(), 0.97).when(short.isNotNull(), 0.9).otherwise(0.0).alias("confidence"))

    return let(norm, decide)


def structured_intent(questions: DataFrame, patterns: list = vocab.INTENT_PATTERNS,
                      aliases: dict[str, str] = vocab.INTENT_ALIASES) -> DataFrame:
    return questions.select("question_id", intent_of(F.col("question"), patterns, aliases).alias("i")).select(
        "question_id", "i.field", "i.confidence")


FIELD_STRUCT = "struct<value:string,confidence:double,page:int,label_detected:string,source:string>"


def extraction_field(json: Column, field: Column) -> Column:
    """struct(value, confidence, page, label, source) of one stored field; NULL when empty."""
    fields = F.from_json(json, f"struct<fields:map<string,{FIELD_STRUCT}>>")["fields"]
    return let(F.try_element_at(fields, field), lambda f: F.when(
        F.coalesce(f["value"], F.lit("")) != "",
        F.struct(
            F.trim(f["value"]).alias("value"), F.coalesce(f["confidence"], F.lit(0.0)).alias("confidence"),
            F.coalesce(F.nullif(f["page"], F.lit(0)), F.lit(1)).alias("page"),
            f["label_detected"].alias("label"), f["source"].alias("source"))))


def _by_language(tables: dict[str, dict[str, str]], language: Column, key: Column) -> Column:
    flat = [F.lit(x) for code, names in tables.items() for k, v in names.items() for x in (f"{code}:{k}", v)]
    known = F.when(language.isin(*tables), language).otherwise("en")
    return F.try_element_at(F.create_map(*flat), F.concat(known, F.lit(":"), key))


def display_value(field: Column, value: Column) -> Column:
    date = F.regexp_replace(value, r"^(\d{4})-(\d{2})-(\d{2})$", "$3/$2/$1")
    amount = F.concat(F.trim(F.replace(value, F.lit("₪"), F.lit(""))), F.lit(" ₪"))
    return (
        F.when(field.isin("insurance_start", "insurance_end"), date)
        .when(field == "premium", amount).otherwise(value)
    )


def field_answer(field: Column, value: Column, language: Column) -> Column:
    label = F.coalesce(_by_language(vocab.FIELD_LABELS, language, field), field)
    return F.concat(label, F.lit(" **"), display_value(field, value), F.lit("**"))


def format_field_answer(answers: DataFrame) -> DataFrame:
    """answers(field, value, language, ...) with the sentence that states the value."""
    return answers.withColumn("content", field_answer(F.col("field"), F.col("value"), F.col("language")))


def type_label(kind: Column, language: Column) -> Column:
    return F.coalesce(_by_language(vocab.TYPE_LABELS, language, kind), kind)


def document_type_label(types: DataFrame) -> DataFrame:
    """types(type, language, ...) with the name of the type in that language."""
    return types.withColumn("label", type_label(F.col("type"), F.col("language")))


def type_answer(kind: Column, language: Column) -> Column:
    lead = F.try_element_at(F.create_map(*[F.lit(x) for p in vocab.TYPE_LEAD.items() for x in p]), language)
    return F.concat(F.coalesce(lead, F.lit(vocab.TYPE_LEAD["en"])), F.lit(" **"),
                    type_label(kind, language), F.lit("**"))


# --- which document a question is about ------------------------------------------------------
def latest_vehicle_document(users: DataFrame, docs: DataFrame, window: int = 10,
                            share_latest: bool = True) -> DataFrame:
    """(user_id, document_id): the newest document with fields among the user's `window`
    newest, else among the `window` newest of all (share_latest)."""
    newest = [F.desc("created_at"), F.desc("document_id")]
    thin = docs.select("user_id", "document_id", "created_at", "has_fields")
    own = top_per(thin, ["user_id"], newest, window).filter("has_fields").groupBy("user_id").agg(
        F.min_by("document_id", "rank").alias("own_id"))
    picked = users.select("user_id").join(own, "user_id", "left")
    if not share_latest:
        return picked.select("user_id", F.col("own_id").alias("document_id")).filter("document_id is not null")
    latest = thin.orderBy(*newest).limit(window).filter("has_fields").agg(
        F.max_by("document_id", F.struct("created_at", "document_id")).alias("any_id"))
    return picked.select("user_id", F.coalesce("own_id", latest.scalar()).alias("document_id")).filter(
        "document_id is not null")


def resolve_document_by_hash(ids: DataFrame, vehicle_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """ids(document_id) -> vehicle_document_id: the id itself, or the vehicle document with
    the same content as the document of that id; only with stored fields."""
    direct = vehicle_docs.filter("has_fields").select("document_id", F.col("document_id").alias("direct_id"))
    by_hash = vehicle_docs.groupBy("content_hash").agg(
        F.min_by(F.struct("document_id", "has_fields"), "document_id").alias("v"))
    through = docs.select("document_id", "content_hash").join(by_hash, "content_hash").filter(
        "v.has_fields").select("document_id", F.col("v.document_id").alias("bridged_id"))
    return ids.join(direct, "document_id", "left").join(through, "document_id", "left").select(
        *ids.columns, F.coalesce("direct_id", "bridged_id").alias("vehicle_document_id"))


# --- corrections --------------------------------------------------------------------------------
def merge_corrections(extractions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Stored fields with corrections: (document_id, field_name, value, corrected, confidence, verified).

    Every stored field of a reviewed document becomes verified; a correction for a field
    that was never found is a new row with confidence 1.
    """
    reviewed = corrections.select("document_id").distinct().withColumn("reviewed", F.lit(True))
    joined = extractions.withColumn("stored", F.lit(True)).join(
        corrections, ["document_id", "field_name"], "full_outer")
    kept = joined.filter(F.col("stored") | (F.coalesce("corrected", F.lit("")) != ""))
    return kept.join(reviewed, "document_id", "left").select(
        "document_id", "field_name", "value", "corrected",
        F.when(F.col("stored"), F.col("confidence")).otherwise(1.0).alias("confidence"),
        F.coalesce("reviewed", F.lit(False)).alias("verified"))


def unseen_corrections(corrections: DataFrame, extractions: DataFrame) -> DataFrame:
    return corrections.filter(F.coalesce("corrected", F.lit("")) != "").join(
        extractions.select("document_id", "field_name"), ["document_id", "field_name"], "left_anti")


def authoritative_values(extractions: DataFrame) -> DataFrame:
    return extractions.select(
        "document_id", F.col("field_name").alias("field"), F.coalesce("corrected", "value").alias("value"))


def link_vehicle_after_review(docs: DataFrame, values: DataFrame, vehicles: DataFrame) -> DataFrame:
    """docs(document_id, vehicle_key, ...): unlinked ones get the vehicle of their number."""
    plates = values.filter("field = 'vehicle_number'").select("document_id", F.col("value").alias("plate"))
    waiting = docs.filter("vehicle_key is null").select("document_id").join(plates, "document_id")
    matched = match_or_create_vehicle(waiting, vehicles).select(
        "document_id", F.col("vehicle_key").alias("found_key"))
    return docs.join(matched, "document_id", "left").select(
        *[c for c in docs.columns if c != "vehicle_key"],
        F.coalesce("vehicle_key", "found_key").alias("vehicle_key"))


def document_extractions(extractions: DataFrame, document_id) -> DataFrame:
    return extractions.filter(F.col("document_id") == document_id)


def extraction_to_json(results: DataFrame) -> DataFrame:
    """One result per document as JSON: confidences to 3 digits, scores to 1."""
    fields = F.transform_values("fields", lambda _, f: F.struct(
        f["value"].alias("value"), F.bround(f["confidence"], 3).alias("confidence"),
        f["source"].alias("source"), f["page"].alias("page"),
        f["label_detected"].alias("label_detected"), f["reason"].alias("reason")))
    candidates = F.transform("vehicle_candidates", lambda c: F.struct(
        c["value"].alias("value"), F.bround(c["score"], 1).alias("score"), c["label"].alias("label"),
        c["reason"].alias("reason"), c["page"].alias("page"), c["selected"].alias("selected")))
    body = F.struct(
        "document_type", F.bround("document_type_confidence", 3).alias("document_type_confidence"),
        fields.alias("fields"), candidates.alias("vehicle_candidates"), "anchors_detected", "warnings",
        "ocr_engine", F.lit("2.0").alias("processing_version"))
    return results.select("document_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))

"""Vehicle documents end to end: fields, policies, review, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions.text import detect_language
from docketry.functions.values import confidence_gate
from docketry.operators import fields as fo
from docketry.operators import layout as lo
from docketry.operators import policies as po
from docketry.session import literal_table, settle, settle_by

COLUMNS = ["doc_id", "field", "value", "confidence", "source", "page", "label", "reason"]


def field_specs(spark: SparkSession) -> DataFrame:
    """(class, field, mode): what each class resolves; a fixed table of some ninety rows."""
    special = {"vehicle_registration": vocab.REGISTRATION_FIELDS}
    classes = [name for name, _, _ in vocab.DOCUMENT_TERMS] + ["unknown"]
    return literal_table(spark, [
        (name, field, mode) for name in classes
        for mode, names in special.get(name, vocab.GENERAL_FIELDS).items() for field in names
    ], "class string, field string, mode string")


def extract_by_type(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """docs(doc_id, class) -> (doc_id, field, mode): one plan serves all classes."""
    return docs.select("doc_id", "class").join(F.broadcast(specs), "class").select("doc_id", "field", "mode")


def _row(df: DataFrame, field: str, value, confidence, source: str, reason: str, label=None, page=1) -> DataFrame:
    return df.select(
        "doc_id", F.lit(field).alias("field"), value.alias("value"), confidence.alias("confidence"),
        F.lit(source).alias("source"), F.lit(page).alias("page"),
        (F.lit(None).cast("string") if label is None else label).alias("label"),
        F.lit(reason).alias("reason")).filter("value is not null")


def extract_vehicle_fields(
    words: DataFrame, texts: DataFrame, anchors: dict[str, list[str]] = vocab.ANCHORS,
    terms: list = vocab.DOCUMENT_TERMS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words and texts(doc_id, text) -> fields in long form, vehicle candidates, classes.

    Where several ways give one field, the strongest wins: `rank` of a source is
    layout 2, signature or pattern by its own rule, explicit text rules 0.

    Words are settled once, by document, and not moved again: whatever reads them is settled in
    place. Words made from texts that lie by document (`settle_by`) are not moved at all.
    """
    spark = words.sparkSession
    classes = fo.document_type_scores(texts.withColumnRenamed("doc_id", "document_id"), terms).withColumnRenamed(
        "document_id", "doc_id")
    rows = settle_by(lo.visual_rows(words).drop("cy", "h"), "doc_id")
    labels = settle(lo.label_hit_dedupe(lo.label_hits(rows, anchors)))
    numbers = settle(lo.best_value_per_label(labels, rows, True), in_place=True)
    modes = extract_by_type(classes, field_specs(spark))

    def picked(name: str) -> DataFrame:
        return modes.filter(F.col("mode") == name).select("doc_id", "field")

    def wanted(name: str) -> DataFrame:
        return labels.join(picked(name), ["doc_id", "field"], "left_semi")

    def chosen(name: str) -> DataFrame:
        return numbers.withColumn("field", F.col("l.field")).join(
            picked(name), ["doc_id", "field"], "left_semi").drop("field")

    resolved = (
        lo.numeric_values(chosen("numeric")).unionByName(lo.raw_values(chosen("raw")))
        .unionByName(settle(lo.resolve_date_field(wanted("date"), rows), in_place=True))
        .unionByName(lo.resolve_text_field(wanted("text"), rows, anchors))
    )
    candidates = settle(lo.best_candidate_by_value(lo.vehicle_candidate_score(rows, labels, best=numbers)), in_place=True)
    layout = lo.first_resolved_field(resolved).select(*COLUMNS).unionByName(
        lo.chosen_vehicle_number(candidates).select(*COLUMNS))

    typed = texts.join(classes, "doc_id")
    insurance = typed.filter("class <> 'vehicle_registration'")
    certificate = typed.filter("class = 'mandatory_insurance'")
    number = _row(insurance, "policy_number", fo.detect_policy_number(F.col("text")), F.lit(0.85),
                  "regex", "matched policy-number pattern")
    insurer = _row(insurance, "insurer", fo.insurer_of(F.col("text")), F.lit(0.95), "signature",
                   "strong insurer signature")
    explicit = insurer
    for field, names, reason in (
        ("insurance_start", vocab.START_LABELS, "date adjacent to explicit insurance-start label"),
        ("insurance_end", vocab.END_LABELS, "date adjacent to explicit insurance-expiry label"),
    ):
        dated = certificate.withColumn("d", fo.labelled_date(F.col("text"), names))
        explicit = explicit.unionByName(_row(
            dated, field, F.col("d.date").cast("string"), F.lit(0.98), "labelled_regex", reason, F.col("d.label")))
    explicit = explicit.unionByName(_row(
        certificate, "premium", fo.labelled_premium(F.col("text")), F.lit(0.97), "labelled_regex",
        "amount adjacent to explicit premium label", F.lit("דמי ביטוח/סכום")))
    explicit = explicit.unionByName(_row(
        certificate, "insurance_type", F.lit("COMPULSORY"), F.col("confidence"), "classifier",
        "mandatory-insurance document"))
    # An explicit rule replaces a layout value; a policy number only replaces a weaker one.
    ranked = (
        explicit.withColumn("order", F.lit(0.0))
        .unionByName(layout.withColumn("order", 2.0 - F.col("confidence")))
        .unionByName(number.withColumn("order", F.lit(2.0 - 0.85 + 1e-12)))
    )
    best = ranked.groupBy("doc_id", "field").agg(F.min_by(
        F.struct(*COLUMNS[2:]), F.struct("order", "source")).alias("best"))
    return best.select("doc_id", "field", "best.*"), candidates, classes


def policies_from_fields(docs: DataFrame, values: DataFrame) -> DataFrame:
    """Policies of documents(document_id, vehicle_key) whose insurance type is known."""
    names = {"insurance_type": "insurance_type", "policy_number": "policy_number", "insurer": "insurer",
             "insurance_start": "start_date", "insurance_end": "end_date"}
    wide = values.filter(F.col("field").isin(*names)).groupBy("document_id").agg(*[
        F.max(F.when(F.col("field") == name, F.col("value"))).alias(column) for name, column in names.items()])
    known = po.coerce_policy_types(wide).filter("insurance_type is not null")
    return docs.filter("vehicle_key is not null").join(known, "document_id").select(
        F.col("document_id").alias("id"), F.col("vehicle_key").alias("vehicle_number"), "insurance_type",
        "policy_number", "insurer", "start_date", "end_date", F.lit(None).cast("string").alias("file_hash"))


def process_vehicle_documents(
    words: DataFrame, texts: DataFrame, vehicles: DataFrame, existing: DataFrame | None = None,
    anchors: dict[str, list[str]] = vocab.ANCHORS, terms: list = vocab.DOCUMENT_TERMS,
) -> dict[str, DataFrame]:
    """Uploads to documents, fields, policies, conflicts and alerts.

    Copies of a text, among the uploads or in `existing`(content_hash), are left out first.
    """
    hashed = texts.withColumn("content_hash", F.sha2("text", 256))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    if existing is not None:
        first = first.join(existing.select("content_hash").distinct(), "content_hash", "left_anti")
    new_texts = texts.join(first.select("doc_id"), "doc_id", "left_semi")
    new_words = words.join(first.select("doc_id"), "doc_id", "left_semi")
    fields, candidates, classes = extract_vehicle_fields(new_words, new_texts, anchors, terms)
    fields = settle(fields)
    values = fields.select(F.col("doc_id").alias("document_id"), "field", "value", "confidence")
    plates = classes.select("doc_id", "type", F.col("confidence").alias("type_confidence")).join(
        fields.filter("field = 'vehicle_number'").select(
            "doc_id", confidence_gate(F.col("value"), F.col("confidence")).alias("plate")), "doc_id", "left")
    docs = po.match_or_create_vehicle(plates, vehicles).withColumnRenamed("doc_id", "document_id").withColumn(
        "review_status", F.lit("needs_review"))
    policies = policies_from_fields(docs, values)
    conflicts, alerts = po.conflict_scan(policies)
    return {"documents": docs, "fields": fields, "candidates": candidates, "policies": policies,
            "conflicts": conflicts, "alerts": alerts}


def review_loop(
    extractions: DataFrame, corrections: DataFrame, docs: DataFrame, vehicles: DataFrame,
    stored_policies: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Corrections onto fields, vehicles onto documents, conflicts scanned again.

    Policies are rebuilt from the corrected values; pass stored_policies to scan those
    as they are instead.
    """
    merged = fo.merge_corrections(extractions, corrections)
    values = fo.authoritative_values(merged)
    linked = fo.link_vehicle_after_review(docs, values, vehicles)
    policies = stored_policies if stored_policies is not None else policies_from_fields(linked, values)
    conflicts, alerts = po.conflict_scan(policies)
    return {"extractions": merged, "documents": linked, "policies": policies,
            "conflicts": conflicts, "alerts": alerts}


def structured_answers(
    questions: DataFrame, documents: DataFrame, values: DataFrame, share_latest: bool = False
) -> DataFrame:
    """Questions for one stored field -> (question_id, document_id, field, value, confidence, page, content).

    questions(question_id, user_id, question, document_id): an explicit document, else the
    user's newest one; only with share_latest the newest of anybody. documents(document_id,
    user_id, created_at, has_fields, document_type, type_confidence); values(document_id,
    field, value, confidence, page). At 0.85 the value is stated, from 0.6 hedged, below
    that the question is left to retrieval.
    """
    asked = questions.withColumn("intent", fo.intent_of(F.col("question"))).filter("intent.confidence >= 0.8")
    asked = asked.select("question_id", "user_id", "document_id", F.col("intent.field").alias("field"),
                         detect_language(F.col("question")).alias("language"))
    users = asked.select("user_id").distinct()
    latest = fo.latest_vehicle_document(users, documents, share_latest=share_latest).withColumnRenamed(
        "document_id", "latest_id")
    target = asked.join(latest, "user_id", "left").withColumn(
        "document_id", F.coalesce("document_id", "latest_id")).drop("latest_id")
    by_field = target.filter("field <> 'document_type'").join(
        values.filter("confidence >= 0.6 and value <> ''"), ["document_id", "field"])
    hedge = F.coalesce(*[F.when(F.col("language") == code, text) for code, text in vocab.HEDGE_PREFIX.items()])
    sentence = fo.field_answer(F.col("field"), F.col("value"), F.col("language"))
    stated = by_field.select(
        "question_id", "document_id", "field", "value", "confidence", "page",
        F.when(F.col("confidence") >= 0.85, sentence).otherwise(F.concat(hedge, sentence)).alias("content"))
    typed = target.filter("field = 'document_type'").join(
        documents.filter(F.col("has_fields") & (F.col("document_type") != vocab.UNKNOWN_DOCUMENT)
                         & (F.col("type_confidence") >= 0.6))
        .select("document_id", "document_type", "type_confidence"), "document_id")
    named = typed.select(
        "question_id", "document_id", "field",
        fo.type_label(F.col("document_type"), F.col("language")).alias("value"),
        F.col("type_confidence").alias("confidence"), F.lit(1).alias("page"),
        fo.type_answer(F.col("document_type"), F.col("language")).alias("content"))
    return stated.unionByName(named)

"""Queries over stored fields, questions for them, and release decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import vocab
from docketry.checks.access import keys
from docketry.checks.base import Data, common, query
from docketry.checks.retrieval import chunks, queries as question_rows
from docketry.operators import fields as op
from docketry.operators import release
from docketry.plans import answers, vehicle
from docketry.plans.ingest import ingest_documents
from docketry.operators.ingest import hashing_embedder
from docketry.session import settle

# Sentences that events are mapped to, with the field each asks for.
SENTENCES = [
    ("What is the vehicle number?", "vehicle_number", 0.97), ("policy no. please", "policy_number", 0.97),
    ("When does the insurance start", "insurance_start", 0.97), ("insurance expiry?", "insurance_end", 0.97),
    ("Who is the insurer", "insurer", 0.97), ("How much was it", "premium", 0.97),
    ("what kind of paper document is it", "document_type", 0.97), ("price", "premium", 0.9),
    ("the plate", "vehicle_number", 0.97), ("Policy", "policy_number", 0.9), ("start", "insurance_start", 0.9),
    ("what are the cancellation conditions?", None, 0.0), ("תום הביטוח", "insurance_end", 0.97),
    ("הרכב", "vehicle_number", 0.9), ("رقم السيارة", "vehicle_number", 0.97), ("بداية", "insurance_start", 0.9),
    ("the cost of all this paper", None, 0.0),
]


def case(column: str, values: list) -> str:
    whens = " ".join(f"when {i} then " + ("null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}")
                     for i, v in enumerate(values))
    return f"case {column} % {len(values)} {whens} end"


common("asked", f"""
select event_id as question_id, user_id % 15 as user_id, {case('event_id', [s[0] for s in SENTENCES])} as question,
  {case('event_id', [s[1] for s in SENTENCES])} as field, {case('event_id', [s[2] for s in SENTENCES])} as confidence,
  case when event_id % {len(SENTENCES)} in (12, 13) then 'he' when event_id % {len(SENTENCES)} in (14, 15) then 'ar' else 'en' end as language
from events""")


def asked(d: Data):
    turn = F.col("event_id") % len(SENTENCES)
    sentence = F.coalesce(*[F.when(turn == i, s[0]) for i, s in enumerate(SENTENCES)])
    return d.table("events").select(
        F.col("event_id").alias("question_id"), (F.col("user_id") % 15).alias("user_id"), sentence.alias("question"))


@query("structured_intent", """
select question_id, coalesce(field, '') as field, cast(confidence as double) as confidence from asked""")
def _(d: Data):
    return op.structured_intent(asked(d)).select("question_id", F.coalesce("field", F.lit("")).alias("field"), "confidence")


LABELS = " ".join(f"when language = '{code}' and field_name = '{k}' then '{v}'"
                  for code, names in vocab.FIELD_LABELS.items() for k, v in names.items())
LANGUAGE = "case document_id % 3 when 0 then 'he' when 1 then 'ar' else 'en' end"


def language(column="document_id"):
    return F.when(F.col(column) % 3 == 0, "he").when(F.col(column) % 3 == 1, "ar").otherwise("en")


@query("format_field_answer", f"""
select document_id, field_name, (case {LABELS} else field_name end) || ' **' || case when field_name = 'insurance_start'
  then substr(value, 9, 2) || '/' || substr(value, 6, 2) || '/' || substr(value, 1, 4) else value end || '**' as content
from (select *, {LANGUAGE} as language from extractions) e where value is not null""")
def _(d: Data):
    rows = d.extractions.filter("value is not null").select(
        "document_id", F.col("field_name").alias("field"), "value", language().alias("language"))
    return op.format_field_answer(rows).select("document_id", F.col("field").alias("field_name"), "content")


TYPE_NAMES = " ".join(f"when language = '{code}' and document_type = '{k}' then '{v.replace(chr(39), chr(39) * 2)}'"
                      for code, names in vocab.TYPE_LABELS.items() for k, v in names.items())


@query("document_type_label", f"""
select document_id, case {TYPE_NAMES} else document_type end as label
from (select *, {LANGUAGE} as language from vdocs) v""")
def _(d: Data):
    rows = d.vdocs.select("document_id", F.col("document_type").alias("type"), language().alias("language"))
    return op.document_type_label(rows).select("document_id", "label")


def stored_json(d: Data):
    one = F.struct("value", "confidence", F.when(F.col("document_id") % 2 == 0, F.lit(2)).alias("page"),
                   F.lit("x").alias("label_detected"), F.lit("regex").alias("source"))
    return d.extractions.groupBy("document_id").agg(F.to_json(F.struct(F.map_from_entries(
        F.collect_list(F.struct("field_name", one))).alias("fields"))).alias("json"))


@query("extraction_field", """
select document_id, field_name as field, value, round(confidence, 6) as confidence,
  case when document_id % 2 = 0 then 2 else 1 end as page
from extractions where value is not null""")
def _(d: Data):
    names = F.explode(F.array(*map(F.lit, ("insurer", "policy_number", "vehicle_number", "insurance_start")))).alias("field")
    asked = stored_json(d).select("document_id", "json", names)
    found = asked.select("document_id", "field", op.extraction_field(F.col("json"), F.col("field")).alias("f"))
    return found.filter("f is not null").select(
        "document_id", "field", "f.value", F.round("f.confidence", 6).alias("confidence"), "f.page")


@query("extraction_to_json")
def _(d: Data):
    one = F.struct("value", "confidence", F.lit("regex").alias("source"), F.lit(1).alias("page"),
                   F.lit(None).cast("string").alias("label_detected"), F.lit("r").alias("reason"))
    fields = d.extractions.groupBy("document_id").agg(F.map_from_entries(
        F.collect_list(F.struct("field_name", one))).alias("fields"))
    none = F.array().cast("array<struct<value:string,score:double,label:string,reason:string,page:int,selected:boolean>>")
    texts = F.array().cast("array<string>")
    results = d.vdocs.join(fields, "document_id").select(
        "document_id", "document_type", F.lit(0.8).alias("document_type_confidence"), "fields",
        none.alias("vehicle_candidates"), texts.alias("anchors_detected"), texts.alias("warnings"),
        F.lit("pdf_text").alias("ocr_engine"))
    return op.extraction_to_json(results)


# --- which document ------------------------------------------------------------------------
common("own_latest", """
select user_id, min_by(document_id, rank) as own_id from (select *, row_number() over (
  partition by user_id order by created_at desc, document_id desc) as rank from vdocs) v
where rank <= 10 and has_fields group by user_id""")
common("any_latest", """
select document_id as any_id from (select * from vdocs order by created_at desc, document_id desc limit 10) v
where has_fields order by created_at desc, document_id desc limit 1""")


@query("latest_vehicle_document", """
select u.user_id, coalesce(o.own_id, (select any_id from any_latest)) as document_id
from users u left join own_latest o on o.user_id = u.user_id""")
def _(d: Data):
    return op.latest_vehicle_document(d.users, d.vdocs)


@query("resolve_document_by_hash", """
select o.o_orderkey as document_id, cast(coalesce(v.document_id, h.vid) as varchar) as vehicle_document_id
from (select o_orderkey, 'file-' || (o_orderkey * 7 % 6000) as content_hash from orders) o
left join vdocs v on v.document_id = o.o_orderkey + 3 and v.has_fields
left join (select content_hash, min(document_id) as vid, min_by(has_fields, document_id) as ok from vdocs group by 1) h
  on h.content_hash = o.content_hash and h.ok""")
def _(d: Data):
    picks = d.table("orders").select(
        (F.col("o_orderkey") + 3).alias("document_id"), F.col("o_orderkey"),
        F.concat(F.lit("file-"), F.col("o_orderkey") * 7 % 6000).alias("content_hash"))
    found = op.resolve_document_by_hash(picks.select("document_id", "o_orderkey"), d.vdocs, picks)
    return found.select(F.col("o_orderkey").alias("document_id"),
                        F.col("vehicle_document_id").cast("string").alias("vehicle_document_id"))


# --- corrections -----------------------------------------------------------------------------
common("merged_fields", """
select coalesce(e.document_id, c.document_id) as document_id, coalesce(e.field_name, c.field_name) as field_name,
  e.value, c.corrected, case when e.document_id is null then 1.0 else e.confidence end as confidence,
  coalesce(e.document_id, c.document_id) in (select document_id from corrections) as verified
from extractions e full outer join corrections c on c.document_id = e.document_id and c.field_name = e.field_name""")
common("linked", """
select v.document_id, coalesce(v.vehicle_key, nullif(regexp_replace(coalesce(m.corrected, m.value), '\\D', '', 'g'), '')) as vehicle_key
from vdocs v left join merged_fields m on m.document_id = v.document_id and m.field_name = 'vehicle_number'""")


@query("merge_corrections", """
select document_id, field_name, value, corrected, round(confidence, 6) as confidence, verified from merged_fields""")
def _(d: Data):
    return op.merge_corrections(d.extractions, d.corrections).withColumn("confidence", F.round("confidence", 6))


@query("unseen_corrections", """
select document_id, field_name, corrected from corrections c where not exists (
  select 1 from extractions e where e.document_id = c.document_id and e.field_name = c.field_name)""")
def _(d: Data):
    return op.unseen_corrections(d.corrections, d.extractions)


@query("authoritative_values", """
select document_id, field_name as field, coalesce(corrected, value) as value from merged_fields""")
def _(d: Data):
    return op.authoritative_values(op.merge_corrections(d.extractions, d.corrections))


def values_of(d: Data):
    return op.authoritative_values(op.merge_corrections(d.extractions, d.corrections))


@query("link_vehicle_after_review", "select document_id, vehicle_key from linked")
def _(d: Data):
    return op.link_vehicle_after_review(
        d.vdocs.select("document_id", "vehicle_key"), values_of(d), d.vehicles)


@query("document_extractions", "select field_name, value from extractions where document_id = 42")
def _(d: Data):
    return op.document_extractions(d.extractions, 42).select("field_name", "value")


common("reviewed", """
select l.document_id, l.vehicle_key, p.number, lower(coalesce(i.value, '')) as insurer from linked l
left join (select document_id, coalesce(corrected, value) as number from merged_fields where field_name = 'policy_number') p
  on p.document_id = l.document_id
left join (select document_id, coalesce(corrected, value) as value from merged_fields where field_name = 'insurer') i
  on i.document_id = l.document_id where l.vehicle_key is not null""")


@query("review_loop", """
select a_id, b_id, conflict_type from (
  select a.document_id as a_id, b.document_id as b_id, 'EXACT_DUPLICATE' as conflict_type
  from reviewed a join reviewed b on a.vehicle_key = b.vehicle_key and a.document_id < b.document_id
    and a.number = b.number and a.insurer = b.insurer) f""")
def _(d: Data):
    # every document is read as a comprehensive policy without an end, so only copies conflict
    kinds = d.vdocs.select("document_id", F.lit("insurance_type").alias("field_name"),
                           F.lit("COMPREHENSIVE").alias("value"), F.lit(1.0).alias("confidence"))
    done = vehicle.review_loop(d.extractions.unionByName(kinds), d.corrections,
                               d.vdocs.select("document_id", "vehicle_key"), d.vehicles)
    return done["conflicts"].select("a_id", "b_id", "conflict_type")


# --- text rules --------------------------------------------------------------------------------
TAIL = """case order_id % 6 when 0 then ' 201-123456789-00 הראל ביטוח' when 1 then ' תחילת הביטוח: 05/03/2027'
  when 2 then ' 31.12.27 :תום הביטוח' when 3 then ' ₪ 1,234.00 :דמי ביטוח' when 4 then ' מקיף 12-345-67 policy 998877 AIG 01/02/2027 03/04/2028'
  else ' ביטוח חובה תעודת ביטוח חובה' end"""
common("notes", f"select order_id, o_orderpriority || {TAIL} as text from (select o_orderkey as order_id, o_orderpriority from orders) o")


def notes(d: Data):
    tails = [" 201-123456789-00 הראל ביטוח", " תחילת הביטוח: 05/03/2027", " 31.12.27 :תום הביטוח",
             " ₪ 1,234.00 :דמי ביטוח", " מקיף 12-345-67 policy 998877 AIG 01/02/2027 03/04/2028",
             " ביטוח חובה תעודת ביטוח חובה"]
    tail = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == i, t) for i, t in enumerate(tails)])
    return d.table("orders").select(F.col("o_orderkey").alias("order_id"), F.concat("o_orderpriority", tail).alias("text"))


@query("detect_insurer", """
select order_id, case order_id % 6 when 0 then 'הראל' else 'AIG' end as insurer, 0.95e0 as confidence
from notes where order_id % 6 in (0, 4)""")
def _(d: Data):
    return op.detect_insurer(notes(d).withColumnRenamed("order_id", "doc_id")).withColumnRenamed("doc_id", "order_id")


@query("detect_policy_number", """
select order_id, nullif(regexp_extract(text, '\\b\\d{3}-\\d{6,}-\\d{2}\\b'), '') as number from notes""")
def _(d: Data):
    return notes(d).select("order_id", op.detect_policy_number(F.col("text")).alias("number"))


@query("labelled_date", """
select order_id, case order_id % 6 when 1 then '2027-03-05' end as start_day,
  case order_id % 6 when 2 then '2027-12-31' end as end_day from notes""")
def _(d: Data):
    return notes(d).select(
        "order_id", op.labelled_date(F.col("text"), vocab.START_LABELS)["date"].cast("string").alias("start_day"),
        op.labelled_date(F.col("text"), vocab.END_LABELS)["date"].cast("string").alias("end_day"))


@query("labelled_premium", """
select order_id, case when order_id % 6 = 3 then '1234.00' end as premium from notes""")
def _(d: Data):
    return notes(d).select("order_id", op.labelled_premium(F.col("text")).alias("premium"))


@query("document_type_scores", """
select order_id, case order_id % 6 when 5 then 'mandatory_insurance' when 4 then 'comprehensive_insurance' else 'unknown' end as class,
  case order_id % 6 when 5 then 2 when 4 then 1 else 0 end as hits,
  cast(case order_id % 6 when 5 then 0.9 when 4 then 0.8 else 0.3 end as double) as confidence from notes""")
def _(d: Data):
    return op.document_type_scores(notes(d).withColumnRenamed("order_id", "document_id")).select(
        F.col("document_id").alias("order_id"), "class", "hits", F.round("confidence", 6).alias("confidence"))


@query("extract_fields_from_text", """
select order_id, unnest(['document_type', 'registration_number', 'policy_number', 'insurer', 'insurance_type', 'start_date', 'end_date']) as field,
  unnest(['COMPREHENSIVE_INSURANCE', '1234567', '998877', 'AIG', 'COMPREHENSIVE', '2027-02-01', '2028-04-03']) as value
from notes where order_id % 6 = 4""")
def _(d: Data):
    found = op.extract_fields_from_text(notes(d).filter("text like '%998877%'").withColumnRenamed("order_id", "document_id"))
    return found.select(F.col("document_id").alias("order_id"), "field", "value")


# --- release --------------------------------------------------------------------------------------
common("release_texts", """
select t.document_id as request_id, t.document_id % 150 as user_id, regexp_replace(t.text, '[^\\x00-\\x7F]', 'x', 'g') as text
from contact_texts t""")
common("release_reasons", r"""
select r.request_id, k.keys, case when regexp_matches(text, '(?i)\bpassword\b') then 'password'
  when regexp_matches(text, '(?i)\b(token|bearer\s+[\w.\-]+)\b') then 'token'
  when regexp_matches(text, '(?i)\b(api[_-]?key|sk-[A-Za-z0-9]{10,})\b') then 'api_key'
  when regexp_matches(text, '(?i)\b(credential|credentials)\b') then 'credential'
  when regexp_matches(text, '(?i)\b(secret|private\s*key|-----BEGIN)\b') then 'secret' end as found,
  list_has_any(string_split(coalesce(k.keys, ''), ','), ['*', 'GLOBAL_AI_ESCALATION:*', 'GLOBAL_AI_ESCALATION']) as permitted
from release_texts r left join action_keys k on k.user_id = r.user_id""")


def release_requests(d: Data):
    return d.contact_texts.select(
        F.col("document_id").alias("request_id"), (F.col("document_id") % 150).alias("user_id"), "text")


@query("external_release_policy", """
select request_id, permitted and found is null as allowed,
  case when not permitted then 'user_not_permitted' when found is not null then 'blocked_category' else 'ok' end as reason,
  case when permitted then found end as category from release_reasons""")
def _(d: Data):
    return release.external_release_policy(release_requests(d), keys(d), True, "manual").select(
        "request_id", "allowed", "reason", "category")


@query("needs_escalation", """
select request_id, permitted and request_id % 3 > 0 as needs_escalation from release_reasons""")
def _(d: Data):
    replies = release_requests(d).select("request_id", "user_id", (F.col("request_id") % 3 == 0).alias("ok"))
    return release.needs_escalation(replies, keys(d), True, "automatic").select("request_id", "needs_escalation")


common("prompt_parts", """
select c.conversation_id as request_id, q.t as q, coalesce(nullif(a.t, ''), '(none provided)') as c,
  q.n_email + coalesce(a.n_email, 0) as n_email, q.n_url + coalesce(a.n_url, 0) as n_url,
  q.n_iban + coalesce(a.n_iban, 0) as n_iban, q.n_credit_card + coalesce(a.n_credit_card, 0) as n_credit_card,
  q.n_phone + coalesce(a.n_phone, 0) as n_phone, q.n_vehicle + coalesce(a.n_vehicle, 0) as n_vehicle,
  q.n_id + coalesce(a.n_id, 0) as n_id, q.n_ip + coalesce(a.n_ip, 0) as n_ip
from convs c join masked q on q.document_id = c.conversation_id % 200
left join masked a on a.document_id = c.conversation_id % 200 + 1 and c.conversation_id % 2 = 0""")


def prompts(d: Data):
    texts = d.contact_texts.select("document_id", "text")
    context = texts.select((F.col("document_id") - 1).alias("document_id"), F.col("text").alias("context"))
    rows = d.convs.withColumn("document_id", F.col("conversation_id") % 200).join(
        texts.withColumnRenamed("text", "question"), "document_id").join(context, "document_id")
    return release.prepare_escalations(rows.select(
        F.col("conversation_id").alias("request_id"), "user_id", "conversation_id", "question",
        F.when(F.col("conversation_id") % 2 == 0, F.col("context")).alias("context"), F.lit("").alias("problem")))


PROMPT_SQL = "md5(format('" + vocab.PROMPT_FORMAT.replace("%s", "{}") + "', '" + vocab.DEFAULT_PROBLEM + "', c, q))"


def _register_prompt_checks() -> None:
    from docketry.checks.texts import LEVEL, TYPES, ascii_digest

    query("prepare_escalations", f"select request_id, {PROMPT_SQL} as digest, {TYPES} as types, {LEVEL} as sensitivity from prompt_parts")(
        lambda d: prompts(d).select("request_id", ascii_digest(F.col("prompt")).alias("digest"),
                                    F.array_join("types", ",").alias("types"), "sensitivity"))
    query("prompt_build", f"select request_id, {PROMPT_SQL} as digest from prompt_parts")(
        lambda d: prompts(d).select("request_id", ascii_digest(F.col("prompt")).alias("digest")))
    query("prompt_type_union", f"select request_id, {TYPES} as types from prompt_parts")(
        lambda d: prompts(d).select("request_id", F.array_join("types", ",").alias("types")))
    query("escalation_event_record", f"""
select request_id as conversation_id, {LEVEL} as data_sensitivity, {TYPES} as types, true as prompt_generated from prompt_parts""")(
        lambda d: release.escalation_event_record(prompts(d)).select(
            "conversation_id", "data_sensitivity", F.array_join("sensitive_types_detected", ",").alias("types"), "prompt_generated"))


_register_prompt_checks()


# --- whole questions ---------------------------------------------------------------------------------
@query("structured_answers", f"""
select q.question_id, e.document_id, q.field, e.value, case when e.confidence >= 0.85 then '' else
    case q.language {" ".join(f"when '{c}' then '{t}'" for c, t in vocab.HEDGE_PREFIX.items())} end end
  || case {LABELS.replace("field_name", "q.field").replace("language =", "q.language =")} end || ' **' || case when q.field = 'insurance_start'
    then substr(e.value, 9, 2) || '/' || substr(e.value, 6, 2) || '/' || substr(e.value, 1, 4) else e.value end || '**' as content
from asked q join own_latest o on o.user_id = q.user_id
join extractions e on e.document_id = o.own_id and e.field_name = q.field
where e.confidence >= 0.6 and e.value <> '' and q.confidence >= 0.8
union all
select q.question_id, v.document_id, q.field, n.label, 'Document type: **' || n.label || '**'
from asked q join own_latest o on o.user_id = q.user_id join vdocs v on v.document_id = o.own_id
join (values ('COMPULSORY_INSURANCE', 'Compulsory insurance'), ('THIRD_PARTY_INSURANCE', 'Third-party insurance'),
  ('VEHICLE_REGISTRATION', 'Vehicle registration')) n(type, label) on n.type = v.document_type
where q.field = 'document_type'""")
def _(d: Data):
    return structured(d).select("question_id", "document_id", "field", "value", "content")


def structured(d: Data, questions=None):
    values = d.extractions.select(
        "document_id", F.col("field_name").alias("field"), "value", "confidence", F.lit(1).alias("page"))
    rows = asked(d) if questions is None else questions
    return vehicle.structured_answers(
        rows.withColumn("document_id", F.lit(None).cast("long")),
        d.vdocs.withColumn("type_confidence", F.lit(0.9)), values)


def mixed_questions(d: Data):
    """Every other question asks for a stored field instead of the text it brings."""
    field = F.when(F.col("query_id") % 2 == 0, "When does the insurance start?")
    return question_rows(d).withColumn("question", F.coalesce(field, F.col("question")))


def retrieved(d: Data, rows):
    return settle(answers.retrieve(rows, chunks(d), d.vectors, d.docs, d.users, d.user_roles, d.grants))


@query("route_questions")
def _(d: Data):
    rows = mixed_questions(d)
    stored = structured(d, rows.select(F.col("query_id").alias("question_id"), "user_id", "question"))
    routed = answers.route_questions(rows, stored, retrieved(d, rows))
    return routed.select("query_id", "origin", F.md5("content").alias("digest"), "sources")


@query("escalation_context")
def _(d: Data):
    rows = question_rows(d)
    sent = answers.escalation_context(rows, retrieved(d, rows), keys(d), True, "manual")
    return sent.select("query_id", "user_id", "sources", "allowed", "reason", "redaction_applied", "context_chars")


@query("ingest_documents", r"""
select d.document_id, p.n, 'READY' as processing,
  case when p.chars < 20 * p.n then 'ocr_unavailable' else 'not_required' end as ocr,
  case when p.chars > 0 then 'indexed' else 'skipped_no_text' end as indexing
from docs d
join (select content_hash, min(document_id) as first_id from docs group by 1) f
  on f.content_hash = d.content_hash and f.first_id = d.document_id
join (select document_id, count(*) as n, sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) as chars
  from doc_pages group by 1) p on p.document_id = d.document_id
where d.content_hash not in (select content_hash from docs where not is_deleted and document_id % 4 = 0)""")
def _(d: Data):
    from docketry.checks.texts import doc_pages

    uploads = d.docs.select("document_id", "arrival", F.col("text").cast("binary").alias("content"))
    live = d.docs.filter("not is_deleted and document_id % 4 = 0").select("document_id", "content_hash")
    done = ingest_documents(uploads, doc_pages(d), live, hashing_embedder(64))
    return done["documents"].select("document_id", "n", "processing", "ocr", "indexing")

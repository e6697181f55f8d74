"""Queries over positioned words.

Words are the tokens of the contact texts laid out on a grid; labels of the checks
with SQL are words equal to one of a few English terms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import vocab
from docketry.checks.base import Data, common, query
from docketry.functions import geometry, values
from docketry.operators import layout as op
from docketry.plans import vehicle
from docketry.session import settle, settle_by

TERMS = {"car": "vehicle_number", "number": "vehicle_number", "id": "id_number",
         "call": "policy_number", "the": "agent_number", "The": "agent_number"}
ANCHORS = {"vehicle_number": ["car", "number"], "id_number": ["id"], "policy_number": ["call"],
           "agent_number": ["on the", "the one"], "policy_holder": ["see"], "insurance_start": ["pay"]}
CLASS_TERMS = [("mandatory_insurance", "COMPULSORY_INSURANCE", ["password", "secret"]),
               ("vehicle_registration", "VEHICLE_REGISTRATION", [" car ", "number"]),
               ("warranty", "WARRANTY", ["Ther"])]

common("grid_words", """
select doc_id, l * 10000 + i as word_idx, cast(1 + l // 50 as int) as page, i * 60.0e0 as x0, (l % 50) * 14.0e0 as y0,
  i * 60.0e0 + 10.0e0 * length(parts[i + 1]) as x1, (l % 50) * 14.0e0 + 12.0e0 as y1, parts[i + 1] as text, 1.0e0 as conf
from (select doc_id, l, parts, unnest(range(0, len(parts))) as i from (
  select doc_id, l, list_filter(string_split(lines[l + 1], ' '), lambda w: w <> '') as parts from (
    select document_id as doc_id, string_split(text, chr(10)) as lines,
      unnest(range(0, len(string_split(text, chr(10))))) as l from contact_texts) a) b) c""")
common("term_labels", f"""
select doc_id, page, 'w' || word_idx as label_id, case text {" ".join(
    f"when '{t}' then '{f}'" for t, f in TERMS.items())} end as field, text, 1.0e0 as score, x0, y0, x1, y1
from grid_words where text in ({", ".join(f"'{t}'" for t in TERMS)})""")
common("box_pairs", """
select l.doc_id, l.label_id, l.field, l.text as label_text, l.y0 as ly0, w.word_idx, w.text, w.conf, w.page,
  (w.y0 + w.y1) / 2 - (l.y0 + l.y1) / 2 as down, abs((w.x0 + w.x1) / 2 - (l.x0 + l.x1) / 2) as aside,
  least(l.x1, w.x1) - greatest(l.x0, w.x0) > 0 as in_column, l.y1 - l.y0 as unit, w.y0 >= l.y1 - (l.y1 - l.y0) * 0.3 as lower,
  least(l.y1, (w.y0 + w.y1) / 2 + 1) - greatest(l.y0, (w.y0 + w.y1) / 2 - 1) > 0 as touching, l.page = w.page as same_page
from term_labels l join grid_words w on w.doc_id = l.doc_id""")
common("rated_words", """
select *, case when not same_page then 0.0 when lower and in_column and down > 0 and down <= unit * 6 then 100.0 - down / unit * 6.0
    when touching or abs(down) <= unit * 0.6 then 90.0 - aside / unit * 4.0
    else greatest(0.0, 40.0 - sqrt(aside * aside + down * down) / unit * 3.0) end as rel,
  case when lower and in_column and down > 0 and down <= unit * 6 then 'below'
    when touching or abs(down) <= unit * 0.6 then 'same_row' else 'near' end as relation
from box_pairs""")


def best_sql(extra: str) -> str:
    return f"""select * from (select *, row_number() over (partition by doc_id, label_id order by rel desc, word_idx) as rn
from rated_words where rel > 0 and not (aside < 1 and abs(down) < 1) {extra}) b where rn = 1"""


common("best_words", best_sql(""))
common("best_numbers", best_sql("and regexp_matches(text, '[0-9]')"))


def texts(d: Data):
    return d.contact_texts.select(F.col("document_id").alias("doc_id"), "text")


def placed_texts(d: Data):
    """`texts` in buckets of documents, so that the words of a document are made where they are needed."""
    return d.once("placed_texts", lambda: texts(d), by="doc_id")


def words(d: Data, of=texts):
    lines = of(d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    tokens = lines.select("doc_id", "l", F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("i", "text"))
    x, y = F.col("i") * 60.0, (F.col("l") % 50) * 14.0
    return tokens.select(
        "doc_id", (F.col("l").cast("long") * 10000 + F.col("i")).alias("word_idx"),
        (F.lit(1) + F.floor(F.col("l") / 50)).cast("int").alias("page"), x.alias("x0"), y.alias("y0"),
        (x + F.length("text") * 10.0).alias("x1"), (y + 12.0).alias("y1"), "text", F.lit(1.0).alias("conf"),
        F.lit("pdf_text").alias("source"))


def term_labels(d: Data):
    field = F.coalesce(*[F.when(F.col("text") == t, f) for t, f in TERMS.items()])
    return words(d).filter(F.col("text").isin(*TERMS)).select(
        "doc_id", "page", F.concat(F.lit("w"), F.col("word_idx")).alias("label_id"), field.alias("field"), "text",
        F.lit(1.0).alias("score"), "x0", "y0", "x1", "y1")


def hits(d: Data):
    placed = words(d, placed_texts)
    return op.label_hits(op.visual_rows(placed), ANCHORS, heights=op.median_word_height(placed))


@query("median_word_height", """
select doc_id, list_sort(list(greatest(1.0, h)))[count(*) // 2 + 1] as h
from (select doc_id, (x1 - x0) / 10 as h from grid_words) g group by doc_id""")
def _(d: Data):
    tall = words(d).withColumn("y1", F.col("y0") + (F.col("x1") - F.col("x0")) / 10)
    return op.median_word_height(tall)


@query("label_word_relation", """
select doc_id, label_id, word_idx, round(rel, 6) as score, relation from rated_words where rel > 0""")
def _(d: Data):
    return op.label_word_relation(term_labels(d), words(d)).filter("score > 0").select(
        "doc_id", "label_id", "word_idx", F.round("score", 6).alias("score"), "relation")


@query("relation_score", """
select doc_id, word_idx, round(case when page <> 1 then 0.0e0 when y0 >= 17.4 and x1 > 100 and x0 < 220 and y0 + 6 > 15 and y0 - 9 <= 72
    then 100 - (y0 - 9) / 12 * 6
  when y0 + 7 > 9 and y0 + 5 < 21 then 90 - abs((x0 + x1) / 2 - 160) / 12 * 4
  else greatest(0, 40 - sqrt(((x0 + x1) / 2 - 160) ** 2 + (y0 - 9) ** 2) / 12 * 3) end, 6) as score
from grid_words""")
def _(d: Data):
    label = F.struct(F.lit(1).alias("page"), F.lit(100.0).alias("x0"), F.lit(9.0).alias("y0"),
                     F.lit(220.0).alias("x1"), F.lit(21.0).alias("y1"),
                     F.lit(160.0).alias("cx"), F.lit(15.0).alias("cy"))
    word = F.struct("page", "x0", "y0", "x1", "y1", "cx", "cy")
    return geometry.with_center(words(d)).select(
        "doc_id", "word_idx", F.round(geometry.relation_score(label, word)["score"], 6).alias("score"))


@query("best_value_per_label", "select doc_id, label_id, word_idx, round(rel, 6) as score, relation from best_words")
def _(d: Data):
    return op.best_value_per_label(term_labels(d), words(d)).select(
        "doc_id", "label_id", "word_idx", F.round("score", 6).alias("score"), "relation")


@query("resolve_numeric_field", """
select doc_id, label_id, field, regexp_replace(text, '\\D', '', 'g') as value,
  round(least(0.99, 0.05 + 0.93 * rel / 100), 6) as confidence from best_numbers""")
def _(d: Data):
    return op.resolve_numeric_field(term_labels(d), words(d)).select(
        "doc_id", "label_id", "field", "value", F.round("confidence", 6).alias("confidence"))


@query("resolve_raw_field", """
select doc_id, label_id, field, trim(text, ' :-') as value, page from best_numbers""")
def _(d: Data):
    return op.resolve_raw_field(term_labels(d), words(d)).select("doc_id", "label_id", "field", "value", "page")


@query("resolve_date_field", """
select doc_id, label_id, field, '2024-03-' || lpad(cast(1 + length(text) % 28 as varchar), 2, '0') as value
from best_words where word_idx % 3 = 0""")
def _(d: Data):
    day = F.concat(1 + F.length("text") % 28, F.lit("/3/2024"))
    dated = words(d).withColumn("text", F.when(F.col("word_idx") % 3 == 0, day).otherwise(F.col("text")))
    return op.resolve_date_field(term_labels(d), dated).select("doc_id", "label_id", "field", "value")


@query("parse_day_first", """
select o_orderkey, case when o_orderkey % 5 < 4 then cast(cast(o_orderdate as date) as varchar) end as day from orders""")
def _(d: Data):
    patterns = ["d/M/yyyy", "dd.MM.yyyy", "dd-MM-yy", "yyyy-MM-dd", "MM/dd"]
    token = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", p)) for i, p in enumerate(patterns)])
    return d.table("orders").select("o_orderkey", values.parse_day_first(token).cast("string").alias("day"))


common("candidates", """
select w.doc_id, w.word_idx, regexp_replace(w.text, '\\D', '', 'g') as value,
  case when v.word_idx is not null then 100.0 when a.assoc is not null then least(a.assoc, 60) * 0.5 else 0 end
  + case when length(regexp_replace(w.text, '\\D', '', 'g')) in (7, 8) then 50 else 0 end
  + case c.field when 'id_number' then -100 when 'policy_number' then -100 when 'agent_number' then -80 else 0 end
  - case when length(regexp_replace(w.text, '\\D', '', 'g')) in (9, 10) and regexp_replace(w.text, '\\D', '', 'g') like '0%' then 80 else 0 end
  - case when regexp_matches(w.text, '[0-9][0-9,]*\\.[0-9]{2}\\b') then 50 else 0 end
  - case when regexp_matches(w.text, '\\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\\b') then 50 else 0 end as score
from grid_words w
left join (select distinct doc_id, word_idx from best_numbers where field = 'vehicle_number' and rel >= 45) v
  on v.doc_id = w.doc_id and v.word_idx = w.word_idx
left join (select doc_id, word_idx, max_by(field, (field, round_even(ly0 + 6, 0), label_id)) as field from best_numbers
  where field <> 'vehicle_number' and rel >= 45 group by 1, 2) c on c.doc_id = w.doc_id and c.word_idx = w.word_idx
left join (select doc_id, word_idx, max(rel) as assoc from rated_words where field = 'vehicle_number' group by 1, 2) a
  on a.doc_id = w.doc_id and a.word_idx = w.word_idx
where length(regexp_replace(w.text, '\\D', '', 'g')) between 5 and 10""")


@query("vehicle_candidate_score", "select doc_id, word_idx, value, round(score, 6) as score from candidates")
def _(d: Data):
    return op.vehicle_candidate_score(words(d), term_labels(d)).select(
        "doc_id", "word_idx", "value", F.round("score", 6).alias("score"))


@query("best_candidate_by_value", """
select doc_id, value, word_idx, round(score, 6) as score,
  score >= 60 and length(value) in (7, 8) and row_number() over (partition by doc_id order by score desc, first_idx) = 1 as selected
from (select *, min(word_idx) over (partition by doc_id, value) as first_idx,
  row_number() over (partition by doc_id, value order by score desc, word_idx) as rn from candidates) c where rn = 1""")
def _(d: Data):
    best = op.best_candidate_by_value(op.vehicle_candidate_score(words(d), term_labels(d)))
    return best.select("doc_id", "value", "word_idx", F.round("score", 6).alias("score"), "selected")


@query("candidate_confidence", """
select doc_id, word_idx, round(case when score >= 150 then greatest(0.9, least(0.99, score / 180))
  else greatest(0, least(0.99, score / 180)) end, 6) as confidence from candidates""")
def _(d: Data):
    return op.vehicle_candidate_score(words(d), term_labels(d)).select(
        "doc_id", "word_idx", F.round(values.candidate_confidence(F.col("score")), 6).alias("confidence"))


@query("relation_confidence", """
select document_id, field_name, round(least(0.99, (0.05 + 0.93 * least(1, confidence * 1.2)) * 0.9 * greatest(confidence, 0.5)), 6)
  as confidence from extractions""")
def _(d: Data):
    value = values.relation_confidence(F.col("confidence") * 120, F.lit(0.9), F.col("confidence"))
    return d.extractions.select("document_id", "field_name", F.round(value, 6).alias("confidence"))


@query("first_resolved_field", """
select doc_id, field, value from (select *, row_number() over (partition by doc_id, field order by length(label_text) desc, label_id) as nth
  from (select *, regexp_replace(text, '\\D', '', 'g') as value from best_numbers) b) r where nth = 1""")
def _(d: Data):
    return op.first_resolved_field(op.resolve_numeric_field(term_labels(d), words(d))).select("doc_id", "field", "value")


@query("anchors_detected", """
select doc_id, array_to_string(list_sort(list(distinct text)), ',') as texts from term_labels group by doc_id""")
def _(d: Data):
    return op.anchors_detected(term_labels(d)).select("doc_id", F.array_join("texts", ",").alias("texts"))


@query("label_hit_dedupe", """
select doc_id, field, label_id from (select *, row_number() over (
    partition by doc_id, field, round_even((y0 + y1) / 2 / 6, 0), round_even((x0 + x1) / 2 / 40, 0)
    order by round_even((y0 + y1) / 2, 0), score desc, x1 - x0 desc, page, word_idx) as rn from (
  select *, cast(substr(label_id, 2) as bigint) as word_idx from term_labels) t) r where rn = 1""")
def _(d: Data):
    labels = term_labels(d).withColumn("word_idx", F.substring("label_id", 2, 20).cast("long"))
    spread = labels.withColumns({"row_id": F.lit(0), "pos": F.col("word_idx"), "span": F.lit(1)})
    return op.label_hit_dedupe(spread).select(
        "doc_id", "field", F.concat(F.lit("w"), F.col("word_idx")).alias("label_id"))


@query("normalize_label", """
select item_id, word, trim(regexp_replace(replace(word, '''', ''), '\\s+', ' ', 'g'), ' :.-') as label
from (select item_id, unnest(string_split(text, ',')) as word from benchmark) w""")
def _(d: Data):
    parts = d.table("benchmark").select("item_id", F.explode(F.split("text", ",")).alias("word"))
    return parts.select("item_id", "word", values.normalize_label(F.col("word")).alias("label"))


@query("fix_ocr_digits", "select item_id, translate(text, 'OoQDIl|SBZg', '00001115829') as text from benchmark")
def _(d: Data):
    return d.table("benchmark").select("item_id", values.fix_ocr_digits(F.col("text")).alias("text"))


@query("token_shape_flags", """
select doc_id, word_idx, length(digits) = 4 and digits between '1950' and '2099' as is_year,
  length(digits) in (9, 10) and digits like '0%' as is_phone,
  regexp_matches(ascii, '[0-9][0-9,]*\\.[0-9]{2}\\b') as is_money,
  regexp_matches(ascii, '\\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\\b') as is_date
from (select *, regexp_replace(text, '\\D', '', 'g') as digits, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') as ascii from grid_words) w""")
def _(d: Data):
    return words(d).select("doc_id", "word_idx", F.inline(F.array(values.token_shape_flags(F.col("text"))))).select(
        "doc_id", "word_idx", F.col("year").alias("is_year"), F.col("phone").alias("is_phone"),
        F.col("money").alias("is_money"), F.col("date").alias("is_date"))


# --- without SQL: order-dependent or fuzzy -------------------------------------------------
@query("visual_rows", """
select doc_id, word_idx, page, dense_rank() over (partition by doc_id, page order by y0) - 1 as row_id from grid_words""")
def _(d: Data):
    return op.visual_rows(words(d)).select("doc_id", "word_idx", "page", "row_id")


@query("label_hits")
def _(d: Data):
    return hits(d).select("doc_id", "page", "field", "text", F.round("score", 6).alias("score"))


@query("match_label")
def _(d: Data):
    return op.match_label(words(d).select(F.col("text").alias("phrase")), ANCHORS)


@query("resolve_text_field")
def _(d: Data):
    rows = settle_by(op.visual_rows(words(d, placed_texts)), "doc_id")
    labels = settle(op.label_hit_dedupe(op.label_hits(rows, ANCHORS)).filter("field = 'policy_holder'"))
    return op.resolve_text_field(labels, rows, ANCHORS).select("doc_id", "label_id", "field", "value")


@query("extract_vehicle_fields")
def _(d: Data):
    found, _, _ = vehicle.extract_vehicle_fields(words(d, placed_texts), placed_texts(d), ANCHORS, CLASS_TERMS)
    return found.select("doc_id", "field", "value", F.round("confidence", 6).alias("confidence"), "source")


@query("process_vehicle_documents")
def _(d: Data):
    done = vehicle.process_vehicle_documents(words(d, placed_texts), placed_texts(d), d.vehicles, None, ANCHORS, CLASS_TERMS)
    return done["documents"].select("document_id", "type", "vehicle_key", "is_new")




def typed_documents(d: Data):
    name = F.coalesce(*[F.when(F.col("document_type") == k, n) for n, k, _ in vocab.DOCUMENT_TERMS], F.lit("unknown"))
    return d.vdocs.select(F.col("document_id").alias("doc_id"), name.alias("class"))


@query("extract_by_type")
def _(d: Data):
    return vehicle.extract_by_type(typed_documents(d), vehicle.field_specs(d.spark))


@query("field_specs")
def _(d: Data):
    used = typed_documents(d).groupBy("class").count()
    return vehicle.field_specs(d.spark).join(used, "class").select("class", "field", "mode", "count")

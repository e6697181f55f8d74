"""Queries over texts: hygiene, chunks, personal data, ingest."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.checks.base import Data, common, query
from docketry.functions import pii, text, values
from docketry.operators import ingest, similarity
from docketry.operators.near_copies import corpus_near_duplicates
from docketry.session import shared_folder
from docketry.sources import files, sinks
from docketry.sources.tables import SCHEMAS

# --- shared SQL -------------------------------------------------------------------
common("doc_words", """
select doc_id as document_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as parts
from documents""")
common("chunks", """
select document_id, cast(j as int) as position, 1 as page,
  array_to_string(list_slice(parts, j * 180 + 1, j * 180 + 220), ' ') as content
from (select *, unnest(range(0, n)) as j from (
  select *, case when len(parts) = 0 then 0 when len(parts) <= 220 then 1
    else cast(ceil((len(parts) - 220) / 180.0) as int) + 1 end as n from doc_words) w) v""")
common("doc_pages", """
select document_id, p + 1 as page, array_to_string(list_slice(lines, p * 20 + 1, p * 20 + 20), chr(10)) as text
from (select document_id, lines, unnest(range(0, cast(ceil(len(lines) / 20.0) as int))) as p from (
  select doc_id as document_id, string_split(text, chr(10)) as lines from documents) x) y""")
common("page_words", """
select document_id, page, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as parts from doc_pages""")
common("page_chunks", """
select document_id, cast(row_number() over (partition by document_id order by page, j) - 1 as int) as position,
  page, array_to_string(list_slice(parts, j * 80 + 1, j * 80 + 100), ' ') as content
from (select *, unnest(range(0, n)) as j from (
  select *, case when len(parts) = 0 then 0 when len(parts) <= 100 then 1
    else cast(ceil((len(parts) - 100) / 80.0) as int) + 1 end as n from page_words) w) v""")
# Accented letters become x before matching: RE2 knows word boundaries for ASCII only.
_STAGES = [
    ("email", "[EMAIL]", "\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b"),
    ("url", "[URL]", "(?i)\\bhttps?://[^\\s]+"),
    ("iban", "[ACCOUNT]", "(?i)\\bIL\\d{2}[\\d ]{15,23}\\b"),
    ("credit_card", "[ACCOUNT]", "\\b(?:\\d[ -]?){13,19}\\b"),
    ("phone", "[PHONE]", "\\b(?:\\+972[-\\s]?|0)(?:\\d[-\\s]?){8,9}\\d\\b"),
    ("vehicle", "[VEHICLE]", "\\b\\d{2,3}-\\d{2,3}-\\d{2,3}\\b"),
    ("id", "[ID]", "\\b\\d{9}\\b"),
    ("ip", "[IP]", "\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b"),
]


def masked_sql(source: str, key: str, column: str) -> str:
    """SELECT with the masked text and a count per kind, stage by stage."""
    sql = f"select {key}, regexp_replace({column}, '[^\\x00-\\x7F]', 'x', 'g') as t from {source}"
    kinds = []
    for kind, mark, pattern in _STAGES:
        keep = "".join(f", n_{k}" for k in kinds)
        sql = (f"select {key}, regexp_replace(t, '{pattern}', '{mark}', 'g') as t{keep}, "
               f"len(regexp_extract_all(t, '{pattern}')) as n_{kind} from ({sql}) s_{kind}")
        kinds.append(kind)
    return sql


KINDS = [k for k, _, _ in _STAGES]
common("masked", masked_sql("contact_texts", "document_id", "text"))
LEVEL = """case when n_email + n_url + n_iban + n_credit_card + n_phone + n_vehicle + n_id + n_ip = 0 then 'low'
  when n_id + n_credit_card + n_iban > 0 then 'high' else 'medium' end"""
TYPES = "array_to_string(list_filter([" + ", ".join(
    f"case when n_{k} > 0 then '{k}' end" for k in sorted(KINDS)) + "], lambda t: t is not null), ',')"


def chunks(d: Data):
    return ingest.chunk_plain_text(d.docs.select("document_id", "text"))


def doc_pages(d: Data):
    lines = F.split("text", "\n")
    count = F.ceil(F.size(lines) / F.lit(20)).cast("int")
    return d.docs.select("document_id", lines.alias("lines"), F.posexplode(F.sequence(F.lit(1), count))).select(
        "document_id", F.col("col").alias("page"),
        F.array_join(F.slice("lines", F.col("pos") * 20 + 1, 20), "\n").alias("text"))


def ascii_digest(col):
    return F.md5(F.regexp_replace(col, r"[^\x00-\x7F]", "x"))


# --- hygiene ------------------------------------------------------------------------
def _table_keys() -> dict[str, str]:
    """The first column of every table, which numbers its rows."""
    return {name: shape.split()[0] for name, shape in SCHEMAS.items()}


@query("read_tables", " union all ".join(
    f"select '{name}' as name, count(*) as n, count(distinct {key}) as n_keys, "
    f"cast(min({key}) as bigint) as low, cast(max({key}) as bigint) as high from {name}"
    for name, key in _table_keys().items()))
def _(d: Data):
    parts = [d.table(name).agg(
        F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"),
        F.min(key).cast("long").alias("low"), F.max(key).cast("long").alias("high")) for name, key in _table_keys().items()]
    return reduce(DataFrame.unionByName, parts)


@query("normalize_ws", r"""
select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as digest from documents""")
def _(d: Data):
    return d.table("documents").select("doc_id", F.md5(text.normalize_ws(F.col("text"))).alias("digest"))


common("doc_terms", r"""
select doc_id, doc_id % 40 as item_id,
  list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: length(t) > 2)) as terms
from documents""")
common("item_terms", r"""
select item_id,
  list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: length(t) > 2)) as terms
from benchmark""")


def with_item(d: Data):
    items = d.table("benchmark").select("item_id", F.col("text").alias("item"))
    return d.table("documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id")).join(items, "item_id")


@query("keyword_overlap", """
select d.doc_id, round(len(list_intersect(d.terms, i.terms)) / greatest(len(i.terms), 1), 6) as overlap
from doc_terms d join item_terms i on i.item_id = d.item_id""")
def _(d: Data):
    return with_item(d).select(
        "doc_id", F.round(text.keyword_overlap(F.col("item"), F.col("text")), 6).alias("overlap"))


@query("term_intersection", """
select d.doc_id, array_to_string(list_sort(list_intersect(d.terms, i.terms)), ' ') as shared
from doc_terms d join item_terms i on i.item_id = d.item_id""")
def _(d: Data):
    shared = text.term_intersection(text.terms_of(F.col("text")), text.terms_of(F.col("item")))
    return with_item(d).select("doc_id", F.array_join(F.array_sort(shared), " ").alias("shared"))


TIDY = r"""
select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(
  regexp_replace(l, '{mark}', '', 'g'), '\s+', ' ', 'g'))),
  lambda l: l <> '' and not regexp_matches(l, '^[-–—]?\s*\d{{1,4}}\s*[-–—]?$')) as lines from documents"""
common("marked_lines", TIDY.format(mark=r"\s*\[\s*\d{{1,3}}\s*\]".replace("{{", "{").replace("}}", "}")))
common("plain_lines", TIDY.format(mark=r"\x00"))
UNREPEATED = """
select doc_id, md5(array_to_string(list_filter(lines, lambda l, i: i = 1 or lower(l) <> lower(lines[i - 1])), chr(10))) as digest
from """


@query("clean_context", UNREPEATED + "marked_lines")
def _(d: Data):
    return d.table("documents").select("doc_id", F.md5(text.clean_context(F.col("text"))).alias("digest"))


@query("drop_consecutive_duplicate_lines", UNREPEATED + "plain_lines")
def _(d: Data):
    lines = text.without_repeats(text.tidy_lines(F.col("text"), drop_marks=False))
    return d.table("documents").select("doc_id", F.md5(F.array_join(lines, "\n")).alias("digest"))


@query("has_content", """
select doc_id, len(regexp_extract_all(text, '[A-Za-z]')) >= 1000 as enough from documents""")
def _(d: Data):
    return d.table("documents").select("doc_id", text.has_content(F.col("text"), 1000).alias("enough"))


@query("detect_language", """
select doc_id, case when doc_id % 3 = 0 then 'he' when doc_id % 5 = 0 then 'ar' else 'en' end as language
from documents""")
def _(d: Data):
    tail = F.when(F.col("doc_id") % 3 == 0, "שלום").when(F.col("doc_id") % 5 == 0, "سلام").otherwise("")
    return d.table("documents").select(
        "doc_id", text.detect_language(F.concat("text", tail)).alias("language"))


@query("text_similarity")
def _(d: Data):
    return with_item(d).select("doc_id", F.round(
        similarity.text_similarity(F.col("item"), F.col("text")), 6).alias("similarity"))


@query("clean_answer")
def _(d: Data):
    return d.messages.select("message_id", similarity.clean_answer(F.col("content")).alias("answer"))


# --- chunks -------------------------------------------------------------------------
@query("chunk_plain_text", "select document_id, position, page, md5(content) as digest from chunks")
def _(d: Data):
    return chunks(d).select("document_id", "position", "page", F.md5("content").alias("digest"))


@query("chunk_pages", "select document_id, position, page, md5(content) as digest from page_chunks")
def _(d: Data):
    return ingest.chunk_pages(doc_pages(d), 100, 20).select(
        "document_id", "position", "page", F.md5("content").alias("digest"))


common("short_chunks", """
select document_id, row_number() over (partition by document_id order by page, j) - 1 as position, page,
  array_to_string(list_slice(parts, j * 3 + 1, j * 3 + 3), ' ') as content
from (select *, unnest(range(0, cast(ceil(len(parts) / 3.0) as int))) as j from page_words) v""")


@query("chunk_dedupe_positions", """
select document_id, cast(row_number() over (partition by document_id order by position) - 1 as int) as position,
  page, md5(content) as digest, len(string_split(content, ' ')) as token_count
from (select *, row_number() over (partition by document_id, lower(content) order by position) as copy
  from short_chunks) c where copy = 1""")
def _(d: Data):
    return ingest.chunk_dedupe_positions(ingest.chunk_pages(doc_pages(d), 3, 0)).select(
        "document_id", "position", "page", F.md5("content").alias("digest"), "token_count")


@query("page_count", "select document_id, count(*) as n from doc_pages group by document_id")
def _(d: Data):
    return ingest.page_count(doc_pages(d))


@query("needs_ocr_flag", r"""
select document_id, count(*) as pages,
  cast(sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) as bigint) as chars,
  sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) < 20 * count(*) as needs_ocr
from doc_pages group by document_id""")
def _(d: Data):
    return ingest.needs_ocr_flag(doc_pages(d))


@query("indexing_status", """
select document_id,
  case when document_id % 19 = 0 then 'FAILED' else 'READY' end as processing,
  case when document_id % 2 <> 0 then 'not_required' when document_id % 3 > 0 then 'ocr_done'
    else 'ocr_unavailable' end as ocr,
  case when document_id % 19 = 0 then 'error: page tree is ' when document_id % 7 = 0 then 'skipped_no_text'
    else 'indexed' end as indexing
from docs""")
def _(d: Data):
    docs = d.docs.select(
        "document_id", (F.col("document_id") % 2 == 0).alias("needs_ocr"),
        (F.col("document_id") % 3).alias("ocr_pages"),
        F.when(F.col("document_id") % 19 == 0, "page tree is broken").alias("error"))
    pages = doc_pages(d).withColumn(
        "text", F.when(F.col("document_id") % 7 == 0, " ").otherwise(F.col("text")))
    return ingest.indexing_status(docs, pages)


@query("write_chunks", "select page, count(*) as count from chunks group by 1")
def _(d: Data):
    folder = f"{shared_folder(d.spark)}/chunks-{uuid.uuid4().hex}"
    sinks.write_chunks(chunks(d), folder)
    return d.spark.read.parquet(folder).groupBy("page").count()


@query("read_text_documents", "select 'txt' as ext, 1 as page, length(text) + 1 as chars from documents")
def _(d: Data):
    # a file per document; the writer ends each with a line break
    folder = f"{shared_folder(d.spark)}/texts-{uuid.uuid4().hex}"
    texts = d.table("documents").groupBy("doc_id").agg(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n").alias("text"))
    sinks.write_text_files(texts.select(F.col("doc_id").alias("name"), "text"), folder)
    found = files.read_text_documents(d.spark, folder)
    return found.filter("ext = 'txt'").select("ext", "page", F.length("text").alias("chars"))


# --- personal data --------------------------------------------------------------------
@query("sanitize_text", "select document_id, md5(t) as digest from masked")
def _(d: Data):
    return d.contact_texts.select(
        "document_id", ascii_digest(pii.mask_text(F.col("text"))).alias("digest"))


@query("pii_counts", "select document_id, " + ", ".join(f"n_{k}" for k in KINDS) + " from masked")
def _(d: Data):
    def columns(c):
        return F.struct(*[F.coalesce(c[k], F.lit(0)).alias(f"n_{k}") for k in KINDS])

    found = text.let(pii.pii_counts(F.col("text")), columns)
    return d.contact_texts.select("document_id", F.inline(F.array(found)))


@query("sensitivity_level", f"select document_id, {LEVEL} as level from masked")
def _(d: Data):
    return d.contact_texts.select(
        "document_id", pii.sensitivity_level(pii.pii_counts(F.col("text"))).alias("level"))


@query("redact_text")
def _(d: Data):
    return d.contact_texts.select("document_id", F.inline(F.array(pii.redact_text(F.col("text"))))).select(
        "document_id", F.md5("text").alias("digest"), F.array_join("types", ",").alias("types"))


@query("blocked_category", r"""
select document_id, case when regexp_matches(t, '(?i)\bpassword\b') then 'password'
  when regexp_matches(t, '(?i)\b(token|bearer\s+[\w.\-]+)\b') then 'token'
  when regexp_matches(t, '(?i)\b(api[_-]?key|sk-[A-Za-z0-9]{10,})\b') then 'api_key'
  when regexp_matches(t, '(?i)\b(credential|credentials)\b') then 'credential'
  when regexp_matches(t, '(?i)\b(secret|private\s*key|-----BEGIN)\b') then 'secret' end as category
from (select document_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') as t from contact_texts) m""")
def _(d: Data):
    return d.contact_texts.select("document_id", pii.blocked_category(F.col("text")).alias("category"))


@query("truncate_context", "select doc_id, md5(left(text, 12000)) as digest from documents")
def _(d: Data):
    return d.table("documents").select("doc_id", F.md5(pii.truncate_context(F.col("text"))).alias("digest"))


# --- uploads ----------------------------------------------------------------------------
@query("content_hash_dedupe", """
select d.document_id, d.content_hash, s.old_id is null and d.document_id = f.first_id as is_new,
  coalesce(s.old_id, f.first_id) as stored_id
from docs d
join (select content_hash, min(document_id) as first_id from docs group by 1) f on f.content_hash = d.content_hash
left join (select content_hash, min(document_id) as old_id from docs
  where not is_deleted and document_id % 4 = 0 group by 1) s on s.content_hash = d.content_hash""")
def _(d: Data):
    live = d.docs.filter("not is_deleted and document_id % 4 = 0").select("document_id", "content_hash")
    return ingest.content_hash_dedupe(
        d.docs.select("document_id", "arrival", F.col("text").cast("binary").alias("content")), live
    ).select("document_id", "content_hash", "is_new", "stored_id")


@query("insert_if_absent", """
select email from users where user_id % 2 = 0
union all
select min(email) from (select case when user_id % 3 = 0 then upper(email) else email end as email from users) u
where lower(email) not in (select lower(email) from users where user_id % 2 = 0) group by lower(email)""")
def _(d: Data):
    source = d.users.select(F.when(F.col("user_id") % 3 == 0, F.upper("email")).otherwise(F.col("email")).alias("email"))
    target = d.users.filter("user_id % 2 = 0").select("email")
    return ingest.insert_if_absent(target, source, "email", fold_case=True)


@query("upload_size_filter", "select doc_id from documents where octet_length(encode(text)) <= 2 * 1024 * 1024")
def _(d: Data):
    blobs = d.table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return ingest.upload_size_filter(blobs, 2).select("doc_id")


@query("coerce_classification", """
select document_id, case when document_id % 6 = 0 then 'INTERNAL' else classification end as classification
from docs""")
def _(d: Data):
    given = F.when(F.col("document_id") % 6 == 0, "TOP").otherwise(F.lower("classification"))
    return d.docs.select("document_id", values.coerce_classification(given).alias("classification"))


@query("attach_embeddings", """
select v.document_id, v.position, 'model-a' as model, round(list_sum(list_transform(vector, lambda x: cast(x as double))), 6) as total
from vectors v join chunks c on c.document_id = v.document_id and c.position = v.position""")
def _(d: Data):
    paired = ingest.attach_embeddings(chunks(d), d.vectors, "model-a")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return paired.select("document_id", "position", "model", F.round(total, 6).alias("total"))


@query("embed_with")
def _(d: Data):
    return ingest.embed_with(chunks(d), ingest.hashing_embedder(64), ["document_id", "position"]).select(
        "document_id", "position", F.size("vector").alias("width"))


#: parts by name and brand, largest first; a later one that lies in, holds or is 85 percent like a kept one goes
PART_COPIES = """
with recursive named as (select p_partkey as document_id, lower(p_name || ' ' || p_brand) as t,
    row_number() over (order by p_size desc, p_partkey) as r from part),
texts as (select t, min(r) as r, length(t) as n, string_split(t, '') as letters from named group by t),
masks as (select t, map_from_entries(list((letter, bits))) as mask from (
  select t, letter, bit_or(1::bigint << (i - 1)) as bits
  from (select t, unnest(letters) as letter, generate_subscripts(letters, 1) as i from texts) group by all) group by t),
pairs as (select a.r as early, b.r as late, contains(a.t, b.t) or contains(b.t, a.t) as inside,
    a.n, a.n + b.n as total, (1::bigint << a.n) - 1 as whole,
    list_transform(b.letters, lambda c: coalesce(m.mask[c], 0)) as steps
  from texts a join masks m using (t) join texts b on a.r < b.r and 2.0 * least(a.n, b.n) / (a.n + b.n) >= 0.85
  or a.r < b.r and (contains(a.t, b.t) or contains(b.t, a.t))),
alike as (select early, late from (select *, bit_count(list_reduce(steps,
    lambda s, m: ((s + (s & m)) | (s - (s & m))) & whole, whole)) as unmatched from pairs)
  where inside or 2.0 * (n - unmatched) / total >= 0.85),
before as (select row_number() over (order by t.r) as step, t.r, coalesce(list(early) filter (early is not null), []) as earlier
  from texts t left join alike a on a.late = t.r group by t.r),
greedy as (select 0::bigint as step, []::bigint[] as kept
  union all select b.step, case when list_has_any(b.earlier, g.kept) then g.kept else list_append(g.kept, b.r) end
  from greedy g join before b on b.step = g.step + 1),
last as (select kept from greedy order by step desc limit 1),
heads as (select b.r, list_min(list_intersect(b.earlier, kept)) as by_r from before b cross join last)
select n.document_id, coalesce(by_r, case when n.r <> t.r then t.r end) is null as kept,
  (select k.document_id from named k where k.r = coalesce(by_r, case when n.r <> t.r then t.r end)) as duplicate_of
from named n join texts t using (t) join heads h on h.r = t.r
"""


@query("corpus_near_duplicates", PART_COPIES)
def _(d: Data):
    named = d.table("part").select(
        F.col("p_partkey").alias("document_id"), F.concat("p_name", F.lit(" "), "p_brand").alias("content"),
        F.col("p_size").alias("score"))
    return corpus_near_duplicates(named)


@query("corpus_near_duplicate_documents")
def _(d: Data):
    texts = d.table("documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return corpus_near_duplicates(texts.withColumn("score", F.length("content")))

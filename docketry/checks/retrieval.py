"""Queries over questions, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import vocab
from docketry.checks.base import Data, common, query
from docketry.checks.texts import chunks as text_chunks
from docketry.functions import values
from docketry.operators import retrieval as op
from docketry.operators.similarity import dedupe_similar_chunks
from docketry.plans import answers

common("chunk_ids", "select *, document_id * 100000 + position as chunk_id from chunks")
common("semantic", """
select question_id, chunk_id, document_id, greatest(0.0, cosine) as score, rank from (
  select *, row_number() over (partition by question_id order by cosine desc, chunk_id) as rank from (
    select q.question_id, c.chunk_id, c.document_id, round(list_cosine_similarity(
      cast(q.vector as double[]), cast(v.vector as double[])), 9) as cosine
    from questions q join reach r on r.user_id = q.user_id
    join vectors v on v.document_id = r.document_id
    join chunk_ids c on c.document_id = v.document_id and c.position = v.position) s) t
where rank <= 8""")
common("keyword", """
select question_id, chunk_id, document_id, 0.5 as score, rank from (
  select q.question_id, c.chunk_id, c.document_id,
    row_number() over (partition by q.question_id order by c.document_id, c.position) as rank
  from chunk_ids c join questions q on contains(lower(c.content), lower(trim(q.question)))
  join reach r on r.user_id = q.user_id and r.document_id = c.document_id) s
where rank <= 8""")
common("merged", """
select question_id, chunk_id, document_id, max(score) as score, min(source * 1000 + rank) as place
from (select *, 0 as source from semantic union all select *, 1 from keyword) u
group by question_id, chunk_id, document_id""")
common("hybrid", """
select question_id, chunk_id, document_id, cast(score as double) as score, rank from (
  select *, row_number() over (partition by question_id order by score desc, place) as rank from merged) m
where rank <= 8""")
TERMS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 2))"
common("reranked", f"""
select question_id, chunk_id, document_id, page, content, round(final, 6) as final, rank from (
  select *, row_number() over (partition by question_id order by final desc, place) as rank from (
    select h.question_id, h.chunk_id, h.document_id, c.page, c.content, h.rank as place,
      round(0.65 * h.score + 0.25 * case when len({TERMS.format('q.question')}) = 0 then 0
        else len(list_intersect({TERMS.format('q.question')}, {TERMS.format('c.content')}))
          / len({TERMS.format('q.question')}) end
      + 0.10 * case when h.document_id = first_value(h.document_id) over (
          partition by h.question_id order by h.score desc, h.rank) then 1 else 0 end, 9) as final
    from hybrid h join chunk_ids c on c.chunk_id = h.chunk_id
    join questions q on q.question_id = h.question_id) s) t
where rank <= 4""")
common("cited", """
select question_id, chunk_id, document_id, page, content,
  row_number() over (partition by question_id order by rank) as rank
from (select *, row_number() over (partition by question_id, document_id, page order by rank) as copy from reranked) c
where copy = 1""")


def queries(d: Data):
    return d.questions.withColumnRenamed("question_id", "query_id")


def chunks(d: Data):
    ids = F.col("document_id") * 100000 + F.col("position")
    return text_chunks(d).withColumn("chunk_id", ids)


def chunk_table(d: Data):
    """The chunks as a table that was written when the documents came in."""
    return d.once("chunks", lambda: chunks(d))


def asked(d: Data):
    return d.once("asked", lambda: op.with_keys(queries(d), d.users, d.user_roles))


def open_chunks(d: Data):
    return op.permitted_chunks(chunk_table(d), asked(d), d.docs, d.grants)


def semantic(d: Data, **kw):
    places = op.permitted_chunks(
        chunks(d).drop("content", "page") if "chunks" not in d.stored else chunk_table(d).drop("content", "page"),
        asked(d), d.docs, d.grants)
    return op.semantic_topk(asked(d), op.chunks_with_embedding(places, d.vectors), **kw)


def keyword(d: Data, **kw):
    return op.keyword_ilike(open_chunks(d), asked(d), **kw)


def hybrid(d: Data):
    words = keyword(d)
    return op.hybrid_topk(semantic(d), words)


def with_text(d: Data, rows):
    texts = chunk_table(d).select("chunk_id", "page", "content")
    return op.chunks_with_document(rows.join(texts, "chunk_id"), d.docs)


def reranked(d: Data):
    return op.rerank(with_text(d, hybrid(d)), queries(d))


def shown(df, *columns):
    return df.withColumnRenamed("query_id", "question_id").select("question_id", *columns)


def score():
    return F.round("score", 6).alias("score")


@query("cosine_similarity", """
select q.question_id, v.document_id, v.position, round(list_cosine_similarity(
  cast(q.vector as double[]), cast(v.vector as double[])), 6) as cosine
from questions q join vectors v on v.document_id = q.question_id""")
def _(d: Data):
    left = d.questions.select("question_id", F.col("question_id").alias("document_id"), F.col("vector").alias("asked"))
    met = left.join(d.vectors, "document_id")
    cosine = values.cosine_similarity(F.col("asked"), F.col("vector"))
    return met.select("question_id", "document_id", "position", F.round(cosine, 6).alias("cosine"))


@query("chunks_with_document", """
select c.chunk_id, d.title, md5(c.content) as digest from chunk_ids c join docs d on d.document_id = c.document_id""")
def _(d: Data):
    return op.chunks_with_document(chunks(d), d.docs).select("chunk_id", "title", F.md5("content").alias("digest"))


@query("chunks_with_embedding", """
select c.chunk_id, len(v.vector) as width from chunk_ids c
join vectors v on v.document_id = c.document_id and v.position = c.position""")
def _(d: Data):
    return op.chunks_with_embedding(chunks(d), d.vectors).select("chunk_id", F.size("vector").alias("width"))


@query("permitted_chunks", """
select c.chunk_id, array_to_string(list_sort(k.keys), ',') as readers from chunk_ids c join (
  select dk.document_id, list(distinct dk.key) as keys from document_keys dk
  where dk.key in (select uk.key from user_keys uk join questions q on q.user_id = uk.user_id)
  group by dk.document_id) k on k.document_id = c.document_id""")
def _(d: Data):
    return open_chunks(d).select("chunk_id", F.array_join(F.array_sort("readers"), ",").alias("readers"))


@query("scope_to_document", "select chunk_id from chunk_ids where document_id = 7")
def _(d: Data):
    return op.scope_to_document(chunks(d), 7).select("chunk_id")


@query("semantic_topk", "select question_id, chunk_id, round(score, 6) as score, rank from semantic")
def _(d: Data):
    return shown(semantic(d), "chunk_id", score(), "rank")


@query("keyword_ilike", "select question_id, chunk_id, cast(score as double) as score, rank from keyword")
def _(d: Data):
    return shown(keyword(d), "chunk_id", score(), "rank")


@query("hybrid_union", "select question_id, chunk_id, round(cast(score as double), 6) as score from merged")
def _(d: Data):
    words = keyword(d)
    return shown(op.hybrid_union(semantic(d), words), "chunk_id", score())


@query("hybrid_topk", "select question_id, chunk_id, round(score, 6) as score, rank from hybrid")
def _(d: Data):
    return shown(hybrid(d), "chunk_id", score(), "rank")


@query("retrieve", """
select h.question_id, h.chunk_id, d.title, c.page, md5(c.content) as digest, round(h.score, 6) as score, h.rank
from hybrid h join chunk_ids c on c.chunk_id = h.chunk_id join docs d on d.document_id = h.document_id""")
def _(d: Data):
    found = answers.retrieve(queries(d), chunk_table(d), d.vectors, d.docs, d.users, d.user_roles, d.grants)
    return shown(found, "chunk_id", "title", "page", F.md5("content").alias("digest"), score(), "rank")


@query("top_document", """
select question_id, document_id from hybrid where rank = 1""")
def _(d: Data):
    return shown(op.top_document(hybrid(d)), "document_id")


@query("rerank", "select question_id, chunk_id, final, rank from reranked")
def _(d: Data):
    return shown(reranked(d), "chunk_id", F.round("final", 6).alias("final"), "rank")


@query("citations", """
select question_id, rank, chunk_id, document_id, page, left(content, 280) as snippet from cited""")
def _(d: Data):
    return shown(op.citations(reranked(d)), "rank", "chunk_id", "document_id", "page", "snippet")


@query("context_block", """
select question_id, md5('CONTEXT:' || chr(10) || chr(10) || string_agg('[' || rank || '] doc-' || document_id ||
  ', page ' || page || ':' || chr(10) || content, chr(10) || chr(10) order by rank)) as digest
from reranked group by question_id""")
def _(d: Data):
    return shown(op.context_block(reranked(d)), F.md5("context").alias("digest"))


@query("retrieval_diagnostics", """
select q.question_id, coalesce(h.n, 0) as retrieved, coalesce(c.n, 0) as sources_used,
  length(q.question) as answer_chars, q.question_id % 2 = 0 as needs_escalation
from questions q left join (select question_id, count(*) as n from hybrid group by 1) h on h.question_id = q.question_id
left join (select question_id, count(*) as n from cited group by 1) c on c.question_id = q.question_id""")
def _(d: Data):
    chosen = reranked(d)
    replies = queries(d).select("query_id", F.col("question").alias("answer"),
                                (F.col("query_id") % 2 == 0).alias("needs_escalation"))
    rows = op.retrieval_diagnostics(hybrid(d), op.context_block(chosen), op.citations(chosen), replies)
    return shown(rows, "retrieved", "sources_used", "answer_chars", "needs_escalation")


@query("weak_answer_flag", f"""
select message_id, len(regexp_extract_all(content, '[A-Za-z]')) >= 8 and message_id % 3 > 0 as ok,
  md5(case when len(regexp_extract_all(content, '[A-Za-z]')) >= 8 and message_id % 3 > 0 then content
    when message_id % 2 = 0 then '{vocab.WEAK_ANSWER_TEXT["en"]}'
    else '{vocab.WEAK_ANSWER_TEXT["he"]}' end) as digest
from messages where role = 'assistant'""")
def _(d: Data):
    language = F.when(F.col("message_id") % 2 == 0, "en").otherwise("he")
    judged = op.weak_answer_flag(F.col("content"), F.col("message_id") % 3, language)
    return d.messages.filter("role = 'assistant'").select("message_id", judged.alias("j")).select(
        "message_id", "j.ok", F.md5("j.content").alias("digest"))


@query("dedupe_similar_chunks")
def _(d: Data):
    return shown(dedupe_similar_chunks(with_text(d, hybrid(d))), "chunk_id", "rank")


@query("build_context")
def _(d: Data):
    contexts, _ = answers.build_context(with_text(d, hybrid(d)), queries(d))
    return shown(contexts, F.md5("context").alias("digest"), F.length("context").alias("chars"))

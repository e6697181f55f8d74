"""Whole questions: retrieve, build the context, answer from fields first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions.pii import redact_text, truncate_context
from docketry.functions.text import clean_context
from docketry.operators import retrieval as op
from docketry.operators.release import external_release_policy
from docketry.operators.similarity import dedupe_similar_chunks


def retrieve(
    queries: DataFrame, chunks: DataFrame, embeddings: DataFrame, docs: DataFrame, users: DataFrame,
    user_roles: DataFrame, grants: DataFrame, k: int = vocab.RETRIEVAL_K,
) -> DataFrame:
    """(query_id, chunk_id, document_id, title, page, content, score, rank) of the k best
    permitted chunks per question, by vector and by keyword."""
    asked = op.with_keys(queries, users, user_roles)
    open_chunks = op.permitted_chunks(chunks, asked, docs, grants)
    index = op.chunks_with_embedding(open_chunks.drop("content", "page"), embeddings)
    ranked = op.hybrid_topk(
        op.semantic_topk(asked, index, k), op.keyword_ilike(open_chunks, asked, k), k)
    texts = chunks.select("chunk_id", "page", "content")
    return op.chunks_with_document(ranked.join(texts, "chunk_id"), docs)


def build_context(retrieved: DataFrame, queries: DataFrame, top: int = vocab.CONTEXT_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """(contexts, citations): near-copies dropped, reranked, cleaned, empty ones left out."""
    chosen = op.rerank(dedupe_similar_chunks(retrieved), queries, top)
    cleaned = chosen.withColumn("content", clean_context(F.col("content"))).filter("content <> ''")
    return op.context_block(cleaned), op.citations(cleaned)


def route_questions(
    questions: DataFrame, structured: DataFrame, retrieved: DataFrame, top: int = vocab.CONTEXT_CHUNKS
) -> DataFrame:
    """(query_id, origin, content, sources): the stored value where there is one, else the
    context for the model and the number of its sources.

    questions(query_id, question, ...); structured answers by question_id.
    """
    answered = structured.select(
        F.col("question_id").alias("query_id"), F.lit("EXTRACTED").alias("origin"), "content",
        F.lit(1).cast("long").alias("sources"))
    open_questions = questions.join(answered.select("query_id"), "query_id", "left_anti")
    left = retrieved.join(open_questions.select("query_id"), "query_id", "left_semi")
    contexts, cited = build_context(left, open_questions, top)
    counted = cited.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"))
    rest = open_questions.select("query_id").join(contexts, "query_id", "left").join(counted, "query_id", "left")
    return answered.unionByName(rest.select(
        "query_id", F.lit("LOCAL").alias("origin"), F.coalesce("context", F.lit("")).alias("content"),
        F.coalesce("sources", F.lit(0)).alias("sources")))


def escalation_context(
    requests: DataFrame, retrieved: DataFrame, keys: DataFrame, configured: bool, mode: str,
    categories: list[str] = vocab.BLOCKED_CATEGORIES, model: str = "external",
) -> DataFrame:
    """requests(query_id, user_id, question) -> masked, cut context with the release
    decision and the usage row: (query_id, user_id, context, sources, allowed, reason,
    category, model, redaction_applied, context_chars, success)."""
    contexts, cited = build_context(retrieved, requests)
    masked = contexts.select("query_id", F.inline(F.array(redact_text(F.col("context"))))).select(
        "query_id", truncate_context(F.col("text")).alias("context"),
        (F.size("types") > 0).alias("redaction_applied"))
    counted = cited.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"))
    joined = requests.select("query_id", "user_id", "question").join(masked, "query_id", "left").join(
        counted, "query_id", "left").withColumns({
            "context": F.coalesce("context", F.lit("")),
            "redaction_applied": F.coalesce("redaction_applied", F.lit(False)),
            "sources": F.coalesce("sources", F.lit(0))})
    decided = external_release_policy(
        joined.withColumn("text", F.concat_ws("\n", "question", "context")), keys, configured, mode, categories)
    return decided.select(
        "query_id", "user_id", "context", "sources", "allowed", "reason", "category",
        F.lit(model).alias("model"), "redaction_applied", F.length("context").alias("context_chars"),
        F.when(~F.col("allowed"), False).alias("success"))

"""Permission-filtered hybrid retrieval for a table of questions.

Chunks: chunk_id, document_id, position, page, content. Embeddings: document_id,
position, vector. Questions: query_id, user_id, question, vector and optionally
scope_id, the one document to look in.

Scores of all questions against all chunks are never written out. Vectors lie in an index
(`vector_index`) and questions travel to the cells they need; keywords are looked up by
trigram postings (`postings`). Both are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions.text import has_content, keyword_overlap
from docketry.operators.access import WIDE_KEYS, audience, live_documents, principals, wide_keys
from docketry.operators.common import top_per
from docketry.operators.postings import candidates
from docketry.operators.vector_index import VectorIndex, search, unit_rows
from docketry.session import settle

KEYWORD_SCORE = 0.5


# --- chunks, documents and readers --------------------------------------------------
def chunks_with_document(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select("document_id", "title"), "document_id")


def chunks_with_embedding(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return chunks.join(embeddings.select("document_id", "position", "vector"), ["document_id", "position"])


def scope_to_document(chunks: DataFrame, document_id=None) -> DataFrame:
    return chunks if document_id is None else chunks.filter(F.col("document_id") == document_id)


def with_keys(queries: DataFrame, users: DataFrame, user_roles: DataFrame) -> DataFrame:
    """Questions with the keys of the user who asks."""
    return queries.join(principals(users, user_roles).select("user_id", "keys"), "user_id")


def permitted_chunks(chunks: DataFrame, queries: DataFrame, docs: DataFrame, grants: DataFrame) -> DataFrame:
    """Chunks some asking user may read, with `readers`: the asked-for keys that open them.

    Applied before any scoring. A document lists only keys the given questions hold.
    """
    wanted = queries.select(F.explode("keys").alias("key")).distinct()
    named = audience(docs, grants).join(wanted, "key", "left_semi").groupBy("document_id").agg(
        F.collect_set("key").alias("named"))
    # the keys that whole tables hold are not joined: whether anybody asks with them is two flags
    held = queries.agg(*[F.coalesce(F.max(F.array_contains("keys", k)), F.lit(False)).alias(k) for k in WIDE_KEYS]).first()
    wide = F.filter(wide_keys(), lambda k: k.isin(*[k_ for k_ in WIDE_KEYS if held[k_]]))
    none = F.array().cast("array<string>")
    readers = settle(live_documents(docs).select("document_id", wide.alias("wide")).join(named, "document_id", "left").select(
        "document_id", F.concat("wide", F.coalesce("named", none)).alias("readers")).filter(F.size("readers") > 0))
    return chunks.join(readers, "document_id")


# --- keyword side ---------------------------------------------------------------------
def keyword_ilike(
    chunks: DataFrame, queries: DataFrame, k: int = vocab.RETRIEVAL_K, raw_pattern: bool = False,
) -> DataFrame:
    """(query_id, chunk_id, document_id, score, rank): permitted chunks that contain the
    question, ignoring case; the first k by document and position.

    Questions with the same words, keys and scope are searched for once. Chunks are found
    by trigram postings; only the texts of candidates are compared.
    raw_pattern=True keeps % and _ of the question as wildcards.
    """
    scope = F.col("scope_id") if "scope_id" in queries.columns else F.lit(None).cast("bigint")
    asked = queries.filter(F.col("question").isNotNull()).select(
        "query_id", F.array_sort("keys").alias("keys"), F.lower(F.trim("question")).alias("needle"), scope.alias("scope_id")
    ).withColumn("needle_id", F.sha2("needle", 256)).withColumn(
        "ask", F.sha2(F.concat_ws("\n", "needle_id", F.array_join("keys", "\n"), F.lit(""), F.col("scope_id").cast("string")), 256))
    needles = asked.groupBy("needle_id").agg(F.first("needle").alias("needle"))
    folded = F.lower("content")
    met = candidates(
        chunks.filter(F.col("content").isNotNull()).select(F.col("chunk_id").alias("text_id"), folded.alias("text")),
        needles.select("needle_id", F.col("needle").alias("text")), raw_pattern)
    needle = F.concat(F.lit("%"), F.col("needle"), F.lit("%"))
    found = F.like(folded, needle) if raw_pattern else F.contains(folded, F.col("needle"))
    hits = met.withColumnRenamed("text_id", "chunk_id").join(
        chunks.select("chunk_id", "document_id", "position", "readers", "content"), "chunk_id"
    ).join(needles, "needle_id").filter(found).select("needle_id", "chunk_id", "document_id", "position", "readers")
    # the same question by many users of equal rights is one ask
    asks = asked.groupBy("ask").agg(*[F.first(c).alias(c) for c in ("needle_id", "keys", "scope_id")])
    in_scope = F.col("scope_id").isNull() | (F.col("scope_id") == F.col("document_id"))
    allowed = hits.join(asks, "needle_id").filter(in_scope & F.arrays_overlap("keys", "readers"))
    first = top_per(allowed.select("ask", "chunk_id", "document_id", "position"), ["ask"], ["document_id", "position"], k)
    return first.join(asked.select("ask", "query_id"), "ask").select(
        "query_id", "chunk_id", "document_id", F.lit(KEYWORD_SCORE).alias("score"), "rank")


# --- semantic side ----------------------------------------------------------------------
def _ranker(k: int):
    """Best k permitted chunks of a batch for each question of a batch."""
    def rank(questions: pa.RecordBatch, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked, scored = unit_rows(questions["vector"]), unit_rows(rows["vector"])
        readers, keys = rows["readers"], questions["keys"]
        codes = pc.unique(keys.flatten())  # only keys that somebody asks with
        holds, opens = (_matrix_of_keys(lists, codes) for lists in (keys, readers))
        scores = np.round(asked @ scored.T, 9)
        allowed = (holds @ opens.T) > 0
        if "scope_id" in questions.schema.names:
            scope = questions["scope_id"]
            anywhere = scope.is_null().to_numpy(zero_copy_only=False)[:, None]
            wanted = scope.fill_null(-1).to_numpy(zero_copy_only=False)[:, None]
            allowed &= anywhere | (wanted == rows["document_id"].to_numpy(zero_copy_only=False)[None, :])
        scores = np.where(allowed, scores, -np.inf)
        if scores.shape[1] > k:  # everything at least as good as the k-th score: ties are settled later
            allowed &= scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1: k]
        q, c = np.nonzero(allowed)
        yield pa.RecordBatch.from_arrays(
            [questions["query_id"].take(pa.array(q)), rows["chunk_id"].take(pa.array(c)),
             rows["document_id"].take(pa.array(c)), pa.array(scores[q, c])],
            names=["query_id", "chunk_id", "document_id", "cosine"])

    return rank


def _matrix_of_keys(lists: pa.ListArray, codes: pa.Array) -> np.ndarray:
    """One row per list, one column per code."""
    out = np.zeros((len(lists), len(codes)), np.float32)
    at = pc.index_in(lists.flatten(), codes)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    out[row[known], at.drop_null().to_numpy()] = 1.0
    return out


def semantic_index(rows: DataFrame, pivots: int | None = None) -> VectorIndex:
    """Chunks (chunk_id, document_id, readers, vector) as an index that can grow (`append`)."""
    return VectorIndex.build(rows.select("chunk_id", "document_id", "readers", "vector"), pivots)


def semantic_search(queries: DataFrame, index: VectorIndex, k: int = vocab.RETRIEVAL_K) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, document_id, score, rank) of the k nearest permitted chunks by cosine, exactly;
    and (query_id, cells_read, cells): how much of the index each question needed."""
    fields = [c for c in ("query_id", "vector", "keys", "scope_id") if c in queries.columns]
    asked = settle(queries.filter(F.size("vector") > 0).select(*fields))
    types = {f.name: f.dataType.simpleString() for f in index.schema}
    schema = f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {types['chunk_id']}, document_id {types['document_id']}, cosine double"
    order = [F.desc("cosine"), "chunk_id"]

    def kth(found: DataFrame) -> DataFrame:
        return top_per(found, ["query_id"], order, k).filter(F.col("rank") == k).select("query_id", F.col("cosine").alias("beat"))

    found, read = search(asked, index, ["chunk_id", "document_id", "readers"], schema, _ranker(k), kth)
    return top_per(found, ["query_id"], order, k).select(
        "query_id", "chunk_id", "document_id", F.greatest(F.lit(0.0), "cosine").alias("score"), "rank"), read


def semantic_topk(queries: DataFrame, rows: DataFrame, k: int = vocab.RETRIEVAL_K, pivots: int | None = None) -> DataFrame:
    """The k nearest permitted chunks by cosine, through an index made of `rows`."""
    return semantic_search(queries, semantic_index(settle(rows.select("chunk_id", "document_id", "readers", "vector")), pivots), k)[0]


# --- merge and rerank -----------------------------------------------------------------------
def hybrid_union(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """One row per (query, chunk) with the higher score; `place` keeps where it was seen first."""
    def side(df: DataFrame, source: int) -> DataFrame:
        return df.select("query_id", "chunk_id", "document_id", "score",
                         F.struct(F.lit(source).alias("source"), F.col("rank").alias("at")).alias("place"))

    return side(semantic, 0).unionByName(side(keyword, 1)).groupBy(
        "query_id", "chunk_id", "document_id").agg(
        F.max("score").alias("score"), F.min("place").alias("place"))


def hybrid_topk(semantic: DataFrame, keyword: DataFrame, k: int = vocab.RETRIEVAL_K) -> DataFrame:
    """The k best of both sides; equal scores keep semantic order, then keyword order."""
    merged = hybrid_union(semantic, keyword)
    return top_per(merged, ["query_id"], [F.desc("score"), "place"], k).drop("place")


def top_document(scored: DataFrame) -> DataFrame:
    """(query_id, document_id) of each question's best chunk."""
    return scored.groupBy("query_id").agg(
        F.min_by("document_id", F.struct(-F.col("score"), "rank")).alias("document_id"))


def rerank(
    chunks: DataFrame, queries: DataFrame, top: int = vocab.CONTEXT_CHUNKS,
    weights: tuple[float, float, float] = (0.65, 0.25, 0.10),
) -> DataFrame:
    """Blend score, word overlap and being in the best chunk's document; keep the top ones.

    Questions bring at most twice the retrieval limit of chunks, so a window over a
    question is small.
    """
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    first = F.first("document_id").over(by_score)
    same = F.when(F.col("document_id") == first, 1.0).otherwise(0.0)
    vector, words, document = weights
    asked = chunks.join(queries.select("query_id", "question"), "query_id")
    final = (
        vector * F.col("score") + words * keyword_overlap(F.col("question"), F.col("content"))
        + document * same
    )
    scored = asked.withColumn("final", F.round(final, 9)).withColumnRenamed("rank", "place")
    return top_per(scored, ["query_id"], [F.desc("final"), "place"], top).drop("question", "place")


# --- context ----------------------------------------------------------------------------------
def context_block(chunks: DataFrame) -> DataFrame:
    """(query_id, context): numbered blocks of the few chunks chosen for each question."""
    where = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit(", page "), F.col("page"))).otherwise("")
    listed = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.concat(F.col("title"), where, F.lit(":\n"), F.col("content")).alias("text")))).alias("parts"))
    blocks = F.transform("parts", lambda p, i: F.concat(F.lit("["), i + 1, F.lit("] "), p["text"]))
    return listed.select("query_id", F.array_join(
        F.concat(F.array(F.lit("CONTEXT:")), blocks), "\n\n").alias("context"))


def citations(chunks: DataFrame, snippet: int = vocab.SNIPPET_CHARS) -> DataFrame:
    """One source per (document, page) of each question's chunks, numbered in order."""
    once = top_per(chunks.withColumnRenamed("rank", "place"), ["query_id", "document_id", "page"], ["place"], 1, "copy")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return once.select("query_id", number.alias("rank"), "chunk_id", "document_id", "title", "page",
                       F.substring("content", 1, snippet).alias("snippet"))


def weak_answer_flag(answer: Column, n_citations: Column, language: Column) -> Column:
    """struct(ok, content): an answer without content or sources gives way to a fixed sentence."""
    ok = has_content(answer) & (n_citations > 0)
    instead = F.lit(vocab.WEAK_ANSWER_TEXT["en"])
    for code, sentence in vocab.WEAK_ANSWER_TEXT.items():
        instead = F.when(language == code, sentence).otherwise(instead)
    return F.struct(ok.alias("ok"), F.when(ok, answer).otherwise(instead).alias("content"))


def retrieval_diagnostics(retrieved: DataFrame, contexts: DataFrame, used: DataFrame, answers: DataFrame) -> DataFrame:
    """Counters per question: answers(query_id, answer, needs_escalation)."""
    found = retrieved.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"))
    cited = used.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources_used"))
    sized = contexts.select("query_id", F.length("context").alias("context_chars"))
    joined = answers.join(found, "query_id", "left").join(cited, "query_id", "left").join(sized, "query_id", "left")
    return joined.select("query_id", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("retrieved", "sources_used", "context_chars")],
        F.length("answer").alias("answer_chars"), "needs_escalation")

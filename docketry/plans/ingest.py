"""Uploads to stored documents, chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import ingest as op


def ingest_documents(
    uploads: DataFrame, pages: DataFrame, existing: DataFrame,
    embedder: Callable[[list[str]], list[list[float]]], model: str = "default",
) -> dict[str, DataFrame]:
    """uploads(document_id, arrival, content), their pages, and the live documents ->
    documents with status, chunks, embeddings. Known content is not worked on again."""
    decided = op.content_hash_dedupe(uploads, existing)
    new = decided.filter("is_new").select("document_id", "content_hash")
    new_pages = pages.join(new.select("document_id"), "document_id", "left_semi")
    chunks = op.chunk_dedupe_positions(op.chunk_pages(new_pages))
    vectors = op.embed_with(chunks, embedder, ["document_id", "position"], failures="null")
    # a document with a chunk that has no vector is not indexed: it has failed, and none of its vectors stay
    broken = vectors.filter("vector is null").select("document_id").distinct()
    ocr = op.needs_ocr_flag(new_pages).select("document_id", "needs_ocr")
    states = new.select("document_id").join(ocr, "document_id", "left").join(
        broken.withColumn("error", F.lit("embedding failed")), "document_id", "left")
    status = op.indexing_status(
        states.select("document_id", F.coalesce("needs_ocr", F.lit(True)).alias("needs_ocr"),
                      F.lit(0).alias("ocr_pages"), "error"), new_pages)
    vectors = vectors.join(broken, "document_id", "left_anti")
    docs = new.join(op.page_count(new_pages), "document_id", "left").join(status, "document_id")
    return {"decisions": decided, "documents": docs, "chunks": chunks,
            "embeddings": op.attach_embeddings(chunks, vectors, model)}

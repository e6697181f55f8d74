"""From uploaded texts to chunks and vectors.

Page columns: document_id, page, text. Chunk columns: document_id, position,
page, content. Decisions (which copy is kept, which position a chunk gets) are
made on narrow rows; texts move at most once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions.text import normalize_ws, words_of
from docketry.operators.common import running_total


# --- chunking -------------------------------------------------------------------
def _windows(n: Column, words: int, step: int) -> Column:
    """Number of windows over n words; the last one is the first to reach the end."""
    return F.when(n == 0, 0).when(n <= words, 1).otherwise(
        F.ceil((n - words) / F.lit(step)).cast("int") + 1)


def _with_windows(pages: DataFrame, words: int, overlap: int) -> tuple[DataFrame, int]:
    if words <= 0:
        raise ValueError("words must be positive")
    step = words - max(0, min(overlap, words - 1))
    return pages.withColumn("n", _windows(F.size(words_of(F.col("text"))), words, step)).filter("n > 0"), step


def _cut(pages: DataFrame, words: int, step: int, before: Column) -> DataFrame:
    # texts move, not their words: an array of words takes several times the bytes
    pages = pages.withColumn("parts", words_of(F.col("text")))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda j: F.array_join(F.slice("parts", j * step + 1, words), " "))
    return pages.select("document_id", "page", before.alias("before"), F.posexplode(windows)).select(
        "document_id", (F.col("before") + F.col("pos")).cast("int").alias("position"), "page",
        F.col("col").alias("content"))


def chunk_pages(
    pages: DataFrame, words: int = vocab.CHUNK_WORDS, overlap: int = vocab.OVERLAP_WORDS
) -> DataFrame:
    """Overlapping word windows that never cross a page; positions run over all pages."""
    cut, step = _with_windows(pages, words, overlap)
    offsets = running_total(cut.select("document_id", "page", "n"), ["document_id"], "page", "n")
    return _cut(
        cut.join(offsets.select("document_id", "page", "before"), ["document_id", "page"]),
        words, step, F.col("before"))


def chunk_plain_text(
    docs: DataFrame, words: int = vocab.CHUNK_WORDS, overlap: int = vocab.OVERLAP_WORDS
) -> DataFrame:
    """`chunk_pages` for texts of one page: nothing is shuffled."""
    one = docs.select("document_id", F.lit(1).alias("page"), "text")
    cut, step = _with_windows(one, words, overlap)
    return _cut(cut, words, step, F.lit(0))


def chunk_dedupe_positions(chunks: DataFrame) -> DataFrame:
    """Drop chunks whose normalized text came earlier in the document; renumber the rest."""
    norm = F.lower(normalize_ws(F.col("content")))
    # a short text is its own key, of fewer bytes than any digest
    key = F.when(F.octet_length("norm") < 32, F.encode("norm", "utf-8")).otherwise(F.unhex(F.sha2("norm", 256)))
    kept = (
        chunks.select("document_id", "position", norm.alias("norm")).filter("norm <> ''")
        .groupBy("document_id", key.alias("digest"))
        .agg(F.min("position").alias("position"), F.lit(1).alias("one"))
    )
    places = running_total(kept.select("document_id", "position", "one"), ["document_id"], "position", "one")
    return chunks.join(places, ["document_id", "position"]).select(
        "document_id", F.col("before").cast("int").alias("position"), "page", "content",
        F.size(words_of(F.col("content"))).alias("token_count"))


# --- identity of uploads ----------------------------------------------------------
def content_hash_dedupe(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming(document_id, arrival, content, ...) -> without content, with
    content_hash, is_new and stored_id, the document that holds the content.

    The earliest arrival of a hash is stored unless `existing`(document_id,
    content_hash), the live documents, has it. The first of each hash is found by a
    grouped minimum, so a hash shared by very many uploads is reduced before the shuffle.
    """
    thin = incoming.withColumn("content_hash", F.sha2(F.col("content"), 256)).drop("content")
    first = thin.groupBy("content_hash").agg(
        F.min_by("document_id", F.struct("arrival", "document_id")).alias("first_id"))
    stored = existing.groupBy("content_hash").agg(F.min("document_id").alias("old_id"))
    owners = first.join(stored, "content_hash", "left")
    return thin.join(owners, "content_hash").select(
        *[c for c in thin.columns], 
        (F.col("old_id").isNull() & (F.col("document_id") == F.col("first_id"))).alias("is_new"),
        F.coalesce("old_id", "first_id").alias("stored_id"))


def insert_if_absent(target: DataFrame, source: DataFrame, key: str, fold_case: bool = False) -> DataFrame:
    """target plus the rows of source whose key it lacks; one row per new key."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("natural_key", F.lower(key) if fold_case else F.col(key))

    new = keyed(source).groupBy("natural_key").agg(
        F.min(F.struct(*[F.col(c) for c in source.columns])).alias("row"))
    new = new.join(keyed(target).select("natural_key").distinct(), "natural_key", "left_anti")
    return target.unionByName(new.select("row.*"), allowMissingColumns=True)


def upload_size_filter(files: DataFrame, max_mb: int = vocab.UPLOAD_LIMIT_MB) -> DataFrame:
    return files.filter(F.octet_length("content") <= max_mb * 1024 * 1024)


# --- page facts and status ----------------------------------------------------------
def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


def needs_ocr_flag(pages: DataFrame) -> DataFrame:
    """Documents with fewer than 20 characters of text per page need OCR."""
    chars = F.length(F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return (
        pages.groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("pages"), F.sum(chars).alias("chars"))
        .withColumn("needs_ocr", F.col("chars") < 20 * F.greatest(F.lit(1), F.col("pages")))
    )


def indexing_status(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """docs(document_id, needs_ocr, ocr_pages, error) and their pages ->
    (document_id, processing, ocr, indexing)."""
    has_text = F.max(F.trim(normalize_ws(F.col("text"))) != "")
    texts = pages.groupBy("document_id").agg(has_text.alias("has_text"))
    failed = F.col("error").isNotNull()
    ocr = (
        F.when(~F.col("needs_ocr"), "not_required")
        .when(F.col("ocr_pages") > 0, "ocr_done").otherwise("ocr_unavailable")
    )
    indexing = (
        F.when(failed, F.substring(F.concat(F.lit("error: "), F.col("error")), 1, 20))
        .when(F.coalesce("has_text", F.lit(False)), "indexed").otherwise("skipped_no_text")
    )
    return docs.join(texts, "document_id", "left").select(
        "document_id", F.when(failed, "FAILED").otherwise("READY").alias("processing"),
        ocr.alias("ocr"), indexing.alias("indexing"))


# --- vectors ------------------------------------------------------------------------
def attach_embeddings(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Pair chunks and vectors by (document_id, position); empty vectors are dropped."""
    full = vectors.filter(F.size("vector") > 0).select("document_id", "position", "vector")
    return chunks.select("document_id", "position").join(full, ["document_id", "position"]).select(
        "document_id", "position", F.lit(model).alias("model"), "vector")


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: signed word counts by CRC, length 1."""
    from zlib import crc32

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                code = crc32(word.encode())
                out[i, code % dim] += 1.0 if (code >> 16) & 1 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()

    return embed


def embed_with(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], key: list[str],
               text: str = "content", failures: str = "raise") -> DataFrame:
    """(key..., vector) from a caller's function on batches of texts.

    A failure of the function fails the job. With failures="null" the batch gets NULL vectors:
    right for questions, which can still be answered by keyword, and for callers that mark
    the documents of such chunks as failed.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                vectors = list(embedder(batch[text].fillna("").tolist()))
                vectors += [None] * (len(batch) - len(vectors))
            except Exception:  # the provider is outside code and may fail in any way
                if failures != "null":
                    raise
                vectors = [None] * len(batch)
            out = batch[key].copy()
            out["vector"] = vectors[: len(batch)]
            yield out

    thin = chunks.select(*key, text)
    schema = ", ".join(f"{c} {t}" for c, t in thin.select(*key).dtypes) + ", vector array<float>"
    return thin.mapInPandas(run, schema)

"""SentencePiece encoding with original byte spans, and decoding.

Texts are normalized through the model's compiled character map (the longest key at each
place), and every normalized byte remembers the original byte it came from. Merging then works
on the normalized text, and the end of every piece is carried back through that alignment: a
piece has its id and the original bytes [begin, end). A character spelled by byte pieces belongs
to the last of them; the others are empty spans. The space put in front of a text spans nothing.

Work is per document, in tasks over slices of a few hundred kilobytes; nothing is shuffled.
The model is a file that every executor can read; its path is a parameter.

Defined results for odd input: a NULL or empty text has no pieces and decodes to the empty
text; NULL and repeated doc_ids are rows of their own; texts of any length are encoded whole;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.piece_model import PieceModel
from docketry.llm.textbytes import slices

ENCODED = "{id} {kind}, ids array<int>, begins array<int>, ends array<int>"


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    """One model, with the segments it has merged, per Python worker."""
    return PieceModel(path)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """(key, ids, begins, ends): the pieces of every text and the original bytes of each.

    With `back`, also `decoded`, the text of the ids, made by the same task.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "ids", "begins", "ends"] + ["decoded"] * back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in batches:
            for first, raw in slices(batch.column(1)):
                made = model.encode([t.decode() for t in raw])
                columns = [batch.column(0).slice(first, len(raw)), *(_lists([m[k] for m in made]) for k in range(3))]
                if back:
                    columns.append(pa.array([model.decode(m[0].tolist()) for m in made], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, text).mapInArrow(run, ENCODED.format(id=f"`{key}`", kind=kind) + ", decoded string" * back)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """encoded with `decoded`: the text of its ids."""
    @F.pandas_udf("string")
    def text_of(lists):
        model = model_of(model_path)
        return lists.map(lambda i: "" if i is None else model.decode(i.tolist()))

    return encoded.withColumn("decoded", text_of(F.col(ids)))


def joined(ids: Column) -> Column:
    """Ids as decimal numbers joined by commas."""
    return F.concat_ws(",", ids.cast("array<string>"))

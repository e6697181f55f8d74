"""Sinks: appended tables and text files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks; rows of a file are sorted by document, so readers of one
    document skip most row groups by their statistics."""
    chunks.sortWithinPartitions("document_id", "position").write.mode("append").parquet(path)


def write_text_files(texts: DataFrame, folder: str) -> None:
    """A file `<name>.txt` for each row (name, text) below `folder`, UTF-8, ended by a line break.

    Tasks open the files themselves, so a file costs no temporary name, checksum or move; names are
    unique, and a task that runs again writes the same files. `folder` is a path or URI that all share.
    """
    def opened() -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = opened()
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                with store.open_output_stream(f"{at}/{name.as_py()}.txt") as out:
                    out.write(text.as_py().encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    store, at = opened()
    store.create_dir(at, recursive=True)
    texts.select(F.col("name").cast("string"), "text").mapInArrow(put, "n long").agg(F.sum("n")).collect()

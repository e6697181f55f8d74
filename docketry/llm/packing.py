"""Best-fit packing of token pieces into sequences under several capacities at once.

1. Every task turns its documents into pieces (ids, one end id, cuts of the capacity) and
   numbers the pieces of each length it has. The rows are written once, so the numbers stay.
2. Only the histogram of lengths goes to the driver: `capacity` rows at most, whatever the
   corpus. `plan` packs it by vector best-fit; bins in the same state are one group with a
   count, so the work depends on the lengths, not on the number of documents.
3. The plan says for each length which numbers go to which sequences and offsets; tasks look
   their pieces up in it. No piece ever moves for packing, except its few numbers.

Defined results for odd input: a NULL or empty text is the end id alone; NULL and repeated
doc_ids are pieces of their own; an empty table gives an empty result; other columns are not
looked at; a text of any length is cut, never dropped.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.tables import settle

#: words of a text as byte-level BPE cuts it before merging; fixed by the vocabulary's format
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    #: weights of the three residuals when bins are compared
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)
    #: "norm": least weighted norm of what is left; "dot": greatest weighted dot product
    rule: str = "norm"


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer file defines them.

    A plain byte-level BPE whose merges are ranked like its ids is run by the faster of the two
    BPE libraries on the ranks read from the same file. Texts with a special token in them, texts
    its regex gives up on (about a million spaces in a row), and tokenizers of any other kind,
    go to the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task owns one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.ranks = self._ranked(spec)

    def _ranked(self, spec: dict):
        """The same BPE by ranks, or None if the file holds something else."""
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (before.get("type") == "ByteLevel" and before.get("use_regex", True)
                 and not before.get("add_prefix_space") and model.get("type", "BPE") == "BPE"
                 and not model.get("ignore_merges") and not model.get("dropout")
                 and spec.get("normalizer") is None and spec.get("post_processor") is None)
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special} if plain else {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [vocab.get("".join(p)) for p in pairs]
        if not plain or None in made or made != sorted(made) or len(set(made)) + 256 != len(vocab):
            return None
        import tiktoken

        letter = byte_of_letter()
        return tiktoken.Encoding(
            "file", pat_str=BYTE_LEVEL, special_tokens={},
            mergeable_ranks={bytes(letter[c] for c in t): i for t, i in vocab.items()})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            return self.whole(text)
        try:
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # the regex has a bounded stack
            return self.whole(text)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 2) -> DataFrame:
    """The pieces of every document, with the task that made each and its number there among equal lengths."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = Encoder(tokenizer_path)
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, size = 0, n if n <= capacity else n % capacity or capacity
                number = 0
                while at < n:
                    part = memoryview(ids)[4 * at: 4 * (at + size)]
                    out.append((doc, number, at, size, zlib.crc32(part), task, int(seen[size])))
                    seen[size] += 1
                    at, size, number = at + size, capacity, number + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(schema), schema.types, strict=True)],
                schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: Capacity) -> np.ndarray:
    """Pack `counts` (length -> pieces) by vector best-fit, longest first.

    Rows (length, first number, pieces, first sequence, offset): pieces number first.. of that
    length go one each to the sequences from the first on, at that offset. A group is a run of
    sequences in the same state; placing pieces splits it. Each step uses up a group or a
    length, so the number of rows depends on the lengths that occur.
    """
    caps = np.array([capacity.tokens, capacity.documents, capacity.cost], float)
    weights = np.array(capacity.weights, float)
    size = 1024
    left = np.zeros((size, 3))  # what is left in a sequence of each group
    many = np.zeros(size, np.int64)  # sequences in the group
    first = np.zeros(size, np.int64)
    groups, sequences, runs = 0, 0, []

    def add(rest: np.ndarray, number: int, begin: int) -> None:
        nonlocal groups, size, left, many, first
        if rest[0] < 1 or rest[1] < 1 or rest[2] < 1:
            return  # full: nothing fits any more
        if groups == size:
            keep = np.flatnonzero(many[:groups])
            groups = len(keep)
            size = max(1024, 2 * groups)
            left, many, first = (np.concatenate([x[keep], np.zeros((size - groups, *x.shape[1:]), x.dtype)])
                                 for x in (left, many, first))
        left[groups], many[groups], first[groups] = rest, number, begin
        groups += 1

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        todo, number = counts[length], 0
        while todo:
            open_ = np.flatnonzero((many[:groups] > 0) & (left[:groups] >= need).all(axis=1))
            if not len(open_):
                break
            if capacity.rule == "dot":
                best = open_[np.argmax((left[open_] / caps * (need / caps)) @ weights)]
            else:
                best = open_[np.argmin(((left[open_] - need) / caps) ** 2 @ weights)]
            m = int(min(todo, many[best]))
            runs.append((length, number, m, int(first[best]), int(capacity.tokens - left[best][0])))
            rest, begin = left[best] - need, int(first[best])
            many[best] -= m
            first[best] += m
            add(rest, m, begin)
            todo, number = todo - m, number + m
        per = int((caps // need).min())
        for fill, bins in ((per, todo // per), (todo % per, 1 if todo % per else 0)):
            if bins:
                for copy in range(fill):
                    runs.append((length, number, bins, sequences, copy * length))
                    number += bins
                add(caps - fill * need, bins, sequences)
                sequences += bins
    return np.array(runs, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: Capacity = Capacity(), end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    made = settle(pieces(docs, tokenizer_path, capacity.tokens, end_id))
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = made.join(offsets, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # number and length as one sorted key: lengths are small, numbers restart with each
        lengths, begins = np.unique(runs[:, 0], return_index=True)
        ends = np.append(begins[1:], len(runs))
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            row = np.zeros(len(length), np.int64)
            for value in np.unique(length):
                k = np.searchsorted(lengths, value)
                mine = length == value
                own = runs[begins[k]: ends[k], 1]
                row[mine] = begins[k] + np.searchsorted(own, number[mine], "right") - 1
            sequence = runs[row, 3] + number - runs[row, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence), pa.array(runs[row, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

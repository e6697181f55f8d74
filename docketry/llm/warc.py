"""Web archives with a two-level capture index.

Writing: each task writes archive files of gzip members, one member per record, and returns
one capture row per record: sort key, file, offset, length, digest, kind. Of equal payloads
one is stored as a response, the others as revisits that refer to it.

Index: captures are range-partitioned and sorted by their reversed-host URL key, cut into
compressed blocks of some thousand lines, and written as a table of blocks. A sparse block
directory keeps one row per block: its first and last key.

Looking up: keys are found in the directory by binary search, only blocks that can hold them
are fetched and searched by bisection, and the records they name are read by their byte
range. The directory travels with the tasks; its size is bounded by DIRECTORY_ROWS, since
blocks grow once there would be more of them.

Files are read and written through pyarrow's file systems by URI, below the session's shared
folder. A file is named by task and attempt, and only files named by the written capture
table count, so a lost executor leaves at most files that nobody reads.

Defined results for odd input: NULL html is an empty payload; a NULL url has the empty key;
line breaks in a url are percent-encoded in headers and keys; several pages with one url are
several captures; rows repeated with the smallest page_id of their payload are all responses;
a NULL page_id never is the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.tables import at_most, scratch, settle

FILE_BYTES = 64_000_000
BLOCK_LINES = 2_000
DIRECTORY_ROWS = 200_000
SMALL_ROWS = 200_000
SALTS = 16
WARC_DATE = "2024-01-01T00:00:00Z"
CAPTURE = ("sort_key string, page_id long, file string, at long, size long, digest string, payload_bytes long, "
           "kind string, refers_to long")


def sort_key(url: str | None) -> str:
    """Reversed-host key: `https://www.a.org:80/x?y#z` gives `org,a,www:80)/x?y`."""
    text = clean(url or "")
    rest = text.split("://", 1)[1] if "://" in text else text
    rest = rest.split("#", 1)[0]
    cut = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:] or "/"
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + path


def clean(url: str) -> str:
    """A url fit for a header line: spaces and control characters percent-encoded."""
    if url.isprintable() and " " not in url:
        return url
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has headers only."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {WARC_DATE}",
        f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Bytes: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    body = b"" if revisit else payload
    head.append("Content-Type: text/html")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != size + 4:
        raise ValueError("no whole WARC record at this place")
    return headers, rest[:size]


def first_of_payload(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with `first`: the smallest page_id of the same payload, where several rows have it.

    Only payloads that occur more than once are joined back; if these are few they are
    broadcast, else hot ones are spread over salts.
    """
    sized = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({
            "sha": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    repeated = settle(
        sized.filter(F.col("n") >= min_bytes).groupBy("sha", "n").agg(
            F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"))
    if at_most(repeated, SMALL_ROWS):
        return sized.join(F.broadcast(repeated), ["sha", "n"], "left").drop("sha", "n")
    salt: Column = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    spread = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
    return sized.withColumn("salt", salt).join(spread, ["sha", "n", "salt"], "left").drop("sha", "n", "salt")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page below `folder`; the captures, written once and read again."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        file, name, at, number = None, "", 0, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file is None:
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                        file, at, number = store.open_output_stream(f"{top}/{name}", compression=None), 0, number + 1
                    payload = html.encode()
                    revisit = first is not None and first != page_id
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, payload, first, revisit)) + packer.flush()
                    file.write(member)
                    rows.append((sort_key(url), page_id, name, at, len(member), base32_sha1(payload), len(payload),
                                 "revisit" if revisit else "response", first if revisit else None))
                    at += len(member)
                    if at >= file_bytes:
                        file.close()
                        file = None
                yield _batch(rows, CAPTURE)
        finally:
            if file is not None:
                file.close()

    return settle(first_of_payload(pages, min_bytes).select("page_id", "url", "html", "first").mapInArrow(write, CAPTURE))


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


BLOCKS = "block long, first_key string, last_key string, lines long, data binary"


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The blocks of the index: sorted, compressed, written once.

    A block has `block_lines` lines, or more where that would make more than DIRECTORY_ROWS
    blocks, so the directory has DIRECTORY_ROWS rows at most, and one more per partition.
    A line is `key page_id file at size`, tab-separated; page_id is empty where it is NULL.
    """
    block_lines = max(block_lines, -(-captures.count() // DIRECTORY_ROWS))
    ranged = captures.select("sort_key", "page_id", "file", "at", "size").repartitionByRange(
        "sort_key", "file", "at").sortWithinPartitions("sort_key", "file", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        number = 0

        def block(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            text = "\n".join("\t".join("" if v is None else str(v) for v in r) for r in rows)
            number += 1
            return _batch([((part << 32) + number, rows[0][0], rows[-1][0], len(rows), zlib.compress(text.encode()))], BLOCKS)

        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while len(held) >= block_lines:
                yield block(held[:block_lines])
                held = held[block_lines:]
        if held:
            yield block(held)

    return settle(ranged.mapInArrow(cut, BLOCKS))


def look_up(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """sort_key, page_id, file, at, size of every capture under the keys (a column sort_key), each once."""
    wanted = keys.select("sort_key").distinct()
    entries = sorted(map(tuple, blocks.select("first_key", "last_key", "block").collect()))
    firsts, lasts = [e[0] for e in entries], [e[1] for e in entries]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                # blocks are sorted, so those that can hold the key stand together
                for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    rows.append((entries[k][2], key))
            yield _batch(rows, "block long, sort_key string")

    places = wanted.mapInArrow(search, "block long, sort_key string")
    asked = places.groupBy("block").agg(F.collect_list("sort_key").alias("keys"))  # at most the keys inside one block
    line = "sort_key string, page_id long, file string, at long, size long"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, keys_ in zip(batch.column(0), batch.column(1), strict=True):
                lines = [t.split("\t") for t in zlib.decompress(data.as_py()).decode().split("\n")]
                order = [t[0] for t in lines]
                rows = []
                for key in keys_.as_py():
                    for k in range(bisect.bisect_left(order, key), bisect.bisect_right(order, key)):
                        t = lines[k]
                        rows.append((key, int(t[1]) if t[1] else None, t[2], int(t[3]), int(t[4])))
                yield _batch(rows, line)

    return blocks.select("block", "data").join(asked, "block").select("data", "keys").mapInArrow(fetch, line)


RECORD = ("sort_key string, page_id long, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at the given places, read by byte range and checked against their digests."""
    near = captures.repartition("file").sortWithinPartitions("file", "at") if payloads else captures
    columns = RECORD if payloads else RECORD.rpartition(",")[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for key, page_id, want, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if want != name:
                    if file is not None:
                        file.close()
                    name, file = want, store.open_input_file(f"{top}/{want}")
                headers, body = parse(zlib.decompress(file.read_at(size, at), 31))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = headers["WARC-Type"] == "revisit"
                if not revisit and base32_sha1(body) != digest:
                    raise ValueError(f"the record at {at} in {want} is not what was written")
                refers = headers.get("WARC-Refers-To", "<urn:page:None>")[10:-1]
                row = (key, page_id, int(headers["X-Payload-Bytes"]), digest, headers["WARC-Type"],
                       None if refers == "None" else int(refers))
                rows.append((*row, body) if payloads else row)
            yield _batch(rows, columns)
        if file is not None:
            file.close()

    return near.select("sort_key", "page_id", "file", "at", "size").mapInArrow(read, columns)


def archive(pages: DataFrame, min_bytes: int = 0) -> tuple[str, DataFrame, DataFrame]:
    """Write pages (page_id, url, html) as archives; their folder, the captures and the index blocks."""
    folder = scratch(pages.sparkSession, "archives")
    captures = write_archives(pages, folder, min_bytes)
    return folder, captures, build_index(captures)


def keys_of(urls: DataFrame) -> DataFrame:
    """sort_key of the column url of a table."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(sort_key(u),) for u in batch.column(0).to_pylist()], "sort_key string")

    return urls.select("url").mapInArrow(make, "sort_key string")

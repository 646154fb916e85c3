"""WARC archives: one gzip member per record, written by Spark tasks and read back record by record.

``write_archives`` turns a table of pages into archive files in a shared folder and returns its
manifest; ``read_archives`` reads the files of a manifest sequentially: chunks of a file are
decompressed one gzip member at a time, the record's header gives the length of its block, and the
digests of block and payload are taken while the block streams by. A task holds one chunk and one
record, never a file.

Defined results
- null html is an empty payload; null url is an empty target.
- Of equal payloads (same SHA-1) of at least ``min_revisit_bytes`` bytes, the smallest page id is
  written as ``response``, all others as ``revisit`` of it. Null ids are larger than any id. Rows that
  repeat the smallest id are responses too; with null ids only, all are responses.
- A record whose framing or digests don't hold is returned with ``valid`` false, and reading goes on
  with the next member where the damage leaves one.
- Extra columns of the pages are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
LEVEL = 4
MANIFEST = "path string, records long, bytes long"
RECORD = (
    "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, valid boolean"
)
END = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    name = identifier.strip("<>").rpartition(":")[2]
    return None if name in ("", "none") else int(name)


def encode_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head (with the payload's length), not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {'%0A'.join(url.splitlines())}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
        ]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + END) + pack.compress(block) + pack.compress(END) + pack.flush()


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, archive_bytes: int):
    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _filesystem(folder)
        out, made, count, size = None, 0, 0, 0

        def close():
            out.close()
            path = f"{root}/part-{task.partitionId():06d}-{made:04d}.warc.gz"
            store.move(temporary, path)  # a second attempt writes the same bytes under the same name
            return pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": size}])

        for batch in batches:
            columns = [batch.column(name) for name in ("page_id", "url", "html", "first_id", "revisit")]
            for k in range(batch.num_rows):
                page_id, url, html, first_id, revisit = (c[k].as_py() for c in columns)
                if out is None:
                    temporary = f"{root}/.part-{task.partitionId():06d}-{made:04d}-{task.taskAttemptId()}"
                    out, count, size = store.open_output_stream(temporary, compression=None), 0, 0
                member = encode_record(page_id, url, html.encode(), first_id, revisit)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    yield close()
                    out, made = None, made + 1
        if out is not None:
            yield close()

    return write


def decide(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html, first_id and revisit for each page. The join key is the payload's digest; only
    digests that occur more than once take part, and a hot one is left to the skewed join of AQE."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    digest = F.when(F.octet_length("html") >= min_revisit_bytes, F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    rows = rows.withColumn("digest", digest)
    first = (
        rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null").drop("n")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "first_id", revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as archives into ``folder`` (a URI all machines reach) and return the manifest.

    Files get their name when they are whole, and the manifest is a table beside them, so a task that runs
    twice leaves one copy.
    """
    spark = pages.sparkSession
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    decide(pages, min_revisit_bytes).mapInArrow(_writer(folder, archive_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Damaged(ValueError):
    """The bytes of a record don't follow the format."""


def members(stream, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of decompressed pieces of at most ``chunk`` bytes.
    Each must be read to its end before the next is asked for."""
    rest = stream.read(chunk)
    while rest:
        unpack = zlib.decompressobj(31)

        def pieces():
            nonlocal rest
            while not unpack.eof:
                try:
                    piece = unpack.decompress(rest, chunk)
                except zlib.error as error:
                    rest = b""
                    raise Damaged(str(error)) from error
                rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                if piece:
                    yield piece
                elif not unpack.eof and not rest and not (rest := stream.read(chunk)):
                    raise Damaged("the file ends inside a member")

        yield pieces()
        rest = rest or stream.read(chunk)


def _until(pieces: Iterator[bytes], buffer: bytearray, mark: bytes) -> bytes:
    """Move the bytes before ``mark`` out of the buffer, and the mark, reading on as needed."""
    at = buffer.find(mark)
    while at < 0:
        piece = next(pieces, None)
        if piece is None:
            raise Damaged("the record ends in its header")
        start = max(0, len(buffer) - len(mark) + 1)
        buffer += piece
        at = buffer.find(mark, start)
    head = bytes(buffer[:at])
    del buffer[: at + len(mark)]
    return head


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_record(pieces: Iterator[bytes]) -> dict:
    """One record of a member: framed by its content length and held against its digests."""
    buffer = bytearray()
    head = _until(pieces, buffer, END)
    if not head.startswith(b"WARC/1."):
        raise Damaged("no WARC version line")
    fields = _fields(head)
    left = int(fields["content-length"])
    block, payload = hashlib.sha1(), hashlib.sha1()
    http, in_payload, length = bytearray(), False, 0
    while True:
        part = bytes(buffer[:left])
        del buffer[: len(part)]
        left -= len(part)
        block.update(part)
        if not in_payload:
            http += part
            if (at := http.find(END)) >= 0:
                part, in_payload = bytes(http[at + len(END) :]), True
                del http[at:]
        if in_payload:
            payload.update(part)
            length += len(part)
        if not left:
            break
        piece = next(pieces, None)
        if piece is None:
            raise Damaged("the block is shorter than its content length")
        buffer += piece
    for piece in pieces:
        buffer += piece
        if len(buffer) > len(END):
            break
    if bytes(buffer) != END:
        raise Damaged("the record doesn't end after its block")
    revisit = fields["warc-type"] == "revisit"
    claimed = fields["warc-payload-digest"].removeprefix("sha1:")
    b32 = lambda h: base64.b32encode(h.digest()).decode()
    valid = fields["warc-block-digest"].removeprefix("sha1:") == b32(block) and (revisit or claimed == b32(payload))
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "target_uri": fields["warc-target-uri"],
        "record_type": fields["warc-type"],
        "refers_to": page_of(fields["warc-refers-to"]) if revisit else None,
        "payload_bytes": int(_fields(bytes(http))["content-length"]) if revisit else length,
        "payload_digest": claimed,
        "valid": valid,
    }


def read_file(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """The records of one archive in order; damage gives a row with ``valid`` false."""
    for pieces in members(stream, chunk):
        try:
            yield read_record(pieces)
        except (Damaged, KeyError, ValueError):
            yield {"valid": False}
            try:
                for _ in pieces:
                    pass
            except Damaged:
                pass


def _reader(folder: str, batch_rows: int = 2000):
    schema = pa.schema([
        ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("valid", pa.bool_()),
    ])

    def read(batches):
        store, _ = _filesystem(folder)
        rows: list[dict] = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    for record in read_file(stream):
                        rows.append(record)
                        if len(rows) >= batch_rows:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives that the manifest names, a file to a task."""
    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(_reader(folder), RECORD)


def round_trip(pages: DataFrame, shared: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages under the shared folder and read the archives back."""
    folder = f"{shared}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, min_revisit_bytes), folder)

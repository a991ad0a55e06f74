"""WARC archives whose records are compressed one by one with a dictionary of the archive's own.

An archive (.warc.zst) starts with a skippable frame that holds a Zstandard dictionary, trained from the archive's first
records; every record after it is one frame. So an archive needs no other file to be read, and a record can be read alone
from its offset. Of equal payloads one is stored as a response, the others as revisits that name it.

Tasks write archives through Arrow's file systems, each attempt under a name of its own, and return an index. Only archives
in the index count, so that attempts that were lost or ran twice leave nothing behind in it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from lodestone.session import broadcast_if_small, materialize, scratch

# Fixed values of the archive formats: the magic number of the dictionary frame, the profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEVEL = 3
DICTIONARY_BYTES = 110 << 10
SAMPLE_BYTES = 4 << 20  # records up to this many bytes train an archive's dictionary
SAMPLE_RECORD = 128 << 10  # bytes of a record that training looks at
ARCHIVE_BYTES = 256 << 20  # an archive is closed beyond this size

INDEX = "path string, offset long, length long, id string, type string"
RECORD = "path string, id string, type string, url string, date string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def train(records: list[bytes]) -> bytes:
    """A dictionary from records, at most a 32nd of their size; empty if they are too few to train from."""
    samples = [r[:SAMPLE_RECORD] for r in records if len(r) >= 8]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 32)
    if size < 256:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, d=8, k=200).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform
        return b""


def record(kind: str, number: str, id: str | None, url: str | None, date: str, size: int, sha1: str, refers: tuple[str, str | None] | None, payload: bytes) -> bytes:
    """A response or revisit; the block is an HTTP answer, whose length field names the full payload's bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{number}>"), ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url) if url else f"urn:uuid:{number}"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload))),
    ]
    if id is not None:
        fields.append(("X-Row-Id", quote(id, safe="")))
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers[0]}>")]
        if refers[1] is not None:
            fields.append(("X-Refers-To-Row-Id", quote(refers[1], safe="")))
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def writer(folder: str, date: str, archive_bytes: int, sample_bytes: int):
    """The function that writes a partition's rows as archives and yields their index."""

    def numbered(row: int) -> str:
        return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}#{row}"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str, bytes]]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, id, url, size, sha1, payload, top = (batch.column(name)[i].as_py() for name in ("row", "id", "url", "size", "sha1", "payload", "top"))
                refers = None if top is None or top["row"] == row else (numbered(top["row"]), top["id"])
                kind = "revisit" if refers else "response"
                yield id, kind, record(kind, numbered(row), id, url, date, size, sha1, refers, payload or b"")

    def archive(head: list, rest: Iterator, system: fs.FileSystem, base: str) -> Iterator[tuple]:
        name = f"{uuid.uuid4().hex}.warc.zst"
        words = train([r for *_, r in head])
        dictionary = zstandard.ZstdCompressionDict(words) if words else None
        if dictionary:
            dictionary.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(words)) + words)
            at = 8 + len(words)
            while head or at < archive_bytes:
                found = head.pop(0) if head else next(rest, None)
                if found is None:
                    break
                id, kind, raw = found
                frame = compressor.compress(raw)
                out.write(frame)
                yield f"{folder}/{name}", at, len(frame), id, kind
                at += len(frame)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        rest = records(batches)
        while True:
            head, size = [], 0
            while size < sample_bytes and (found := next(rest, None)):
                head.append(found)
                size += len(found[2])
            if not head:
                return
            system.create_dir(base, recursive=True)
            rows = []
            for row in archive(head, rest, system, base):
                rows.append(row)
                if len(rows) == 10_000:
                    yield batch_of(rows, INDEX_FIELDS)
                    rows = []
            yield batch_of(rows, INDEX_FIELDS)

    return write


INDEX_FIELDS = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.string()), ("type", pa.string())]
RECORD_FIELDS = [
    ("path", pa.string()), ("id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
]


def batch_of(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


def write(
    pages: DataFrame, folder: str | None = None, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES, id: str = "page_id", url: str = "url", payload: str = "html",
) -> DataFrame:
    """One record for each row; returns the index of all records: path, offset, length, id as text, type.

    Of rows with equal payloads (SHA-256) of at least ``min_bytes`` that of the largest id is the response, of equal ids
    one; null ids are smallest. A null payload is an empty one. Rows without an id or a URL get records without them.
    Other columns are left out, whatever their names. An empty table gives no archive. ``folder`` is a URI that Arrow can
    write (file, s3, gs, hdfs); by default a new one below the shared folder, until ``session.release``. Payloads move
    through a shuffle only when more kinds of repeated payloads exist than may be broadcast. A task holds a sample of
    ``sample_bytes`` and one record.
    """
    spark = pages.sparkSession
    folder = as_uri(folder or scratch(spark, "warc"))
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "key": F.unhex(F.sha2("payload", 256))})
    rows = materialize(rows, "pages")  # row numbers stay the same from here on
    repeated = rows.where(F.col("size") >= min_bytes).groupBy("key").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("n"))
    repeated = materialize(repeated.where("n > 1").select("key", "top"), "repeated")
    marked = rows.join(broadcast_if_small(repeated), "key", "left").select(
        "row", F.col("id").cast("string").alias("id"), "url", "size", "sha1",
        F.when(F.col("top").isNull() | (F.col("top.row") == F.col("row")), F.col("payload")).alias("payload"),
        F.when(F.col("top").isNotNull(), F.struct(F.col("top.id").cast("string").alias("id"), F.col("top.row").alias("row"))).alias("top"),
    )
    return materialize(marked.mapInArrow(writer(folder, date, archive_bytes, sample_bytes), INDEX), "warc-index")


def as_uri(path: str) -> str:
    """Hadoop writes file:/path where Arrow wants file:///path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return path.rstrip("/")


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def opened(stream) -> io.BufferedReader:
    """The records of an archive as one stream: the leading frame gives the dictionary."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    words = stream.read(size)
    dictionary = zstandard.ZstdCompressionDict(words) if words else None
    return io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True), 1 << 20)


def digest_row(path: str, fields: dict[str, str], block: bytes, keep: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    sha1 = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError(f"the payload of {fields['warc-record-id']} in {path} has changed")
    name = lambda key: unquote(fields[key]) if key in fields else None
    return (
        path, name("x-row-id"), fields["warc-type"], fields["warc-target-uri"], fields["warc-date"], size, sha1,
        name("x-refers-to-row-id"), payload if keep else None,
    )


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all archives in an index (or any table with a ``path``), read from start to end, an archive a task.

    path, id as text, type, url, date, payload_bytes and payload_digest (bare hexadecimal SHA-1) of the full payload,
    refers_to (the id of the response that a revisit names), and the payload itself if asked for. Payloads are held
    against their digests. A damaged archive ends the run.
    """
    paths = materialize(index.select("path").distinct(), "warc-paths")
    count = paths.count()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for fields, block in parsed(opened(stream)):
                        rows.append(digest_row(path, fields, block, payloads))
                        size += len(block) if payloads else 0
                        if len(rows) == 10_000 or size > 16 << 20:
                            yield batch_of(rows, RECORD_FIELDS)
                            rows, size = [], 0
                yield batch_of(rows, RECORD_FIELDS)

    return paths.repartition(max(1, count)).mapInArrow(decode, RECORD)


def fetch(index: DataFrame) -> DataFrame:
    """The records of these index rows alone, payloads included, each read from its offset."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length in sorted(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")))):
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_file(at) as file:
                    words = file.read_at(struct.unpack("<II", file.read_at(8, 0))[1], 8)
                    dictionary = zstandard.ZstdCompressionDict(words) if words else None
                    raw = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(file.read_at(length, offset))
                yield batch_of([digest_row(path, *found, True) for found in parsed(io.BufferedReader(io.BytesIO(raw)))], RECORD_FIELDS)

    return index.select("path", "offset", "length").mapInArrow(decode, RECORD)

"""WARC archives as a chunked record table.

Archives are gzip members, one per record, written and read in pieces: a
payload is never held as a whole beyond the row it comes from, and a read gives
rows (record, chunk number, bytes, digest so far). Paths are URIs of any store
that ``pyarrow.fs`` knows, in a folder that all executors share.

Writing: a task writes files under names of its own and returns their paths;
the table of paths of the attempts that succeeded is the manifest, and files of
lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import slices
from lociq.session import cut_lineage, use_checkpoint_folder

CHUNK = 1 << 20
#: Compressed bytes after which a task begins the next archive.
ARCHIVE = 64 << 20
LINE = b"\r\n"
DATE = "2000-01-01T00:00:00Z"

_MANIFEST = "path string, records long, bytes long"
CHUNKS = "path string, record_id string, page_id long, target_uri string, record_type string, refers_to long, payload_digest string, full_bytes long, chunk int, last boolean, payload binary, bytes_so_far long, digest_so_far string"
_SCHEMA = pa.schema(
    [("path", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string())]
    + [("full_bytes", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("payload", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())]
)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def record_uri(key: int | None) -> str:
    """The record id of a key; null keys get a random one."""
    return f"<urn:uuid:{uuid.uuid4()}>" if key is None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(key))}>"


def label(digest) -> str:
    """Bare base32 of a SHA-1 state."""
    return base64.b32encode(digest.digest()).decode()


class Archive:
    """One file of gzip members, written through a temporary buffer of one chunk."""

    def __init__(self, folder: str, name: str):
        system, path = store(folder)
        self.path, self.records, self.bytes = f"{folder}/{name}", 0, 0
        self._out = system.open_output_stream(f"{path}/{name}", compression=None)

    def add(self, headers: list[tuple[str, str]], payload: memoryview) -> None:
        """Append one record as one gzip member."""
        head = LINE.join([b"WARC/1.0", *(f"{k}: {v}".encode() for k, v in headers)]) + LINE + LINE
        packer = zlib.compressobj(6, wbits=31)
        self._put(packer.compress(head))
        for at in range(0, len(payload), CHUNK):
            self._put(packer.compress(payload[at : at + CHUNK]))
        self._put(packer.compress(LINE + LINE) + packer.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.bytes += len(data)

    def close(self) -> dict:
        self._out.close()
        return {"path": self.path, "records": self.records, "bytes": self.bytes}


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, payload, refers_to) as records; gives the manifest (path, records, bytes).

    A row with ``refers_to`` becomes a revisit without payload, whose digest and
    length are those of the payload given; others are responses. A null payload
    is empty. Control characters and blanks in a url are percent-encoded (and so is
    ``%``), reading decodes them; a null url gives no target header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for part in slices(batch, "payload", CHUNK):
                for key, url, payload, refers in zip(*(part.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if archive is None or archive.bytes > ARCHIVE:
                        done += [archive.close()] if archive else []
                        archive = Archive(folder, f"{uuid.uuid4()}.warc.gz")
                    body = memoryview(payload.as_buffer()) if payload.is_valid else memoryview(b"")
                    digest = hashlib.sha1()
                    for at in range(0, len(body), CHUNK):
                        digest.update(body[at : at + CHUNK])
                    key, revisit = key.as_py(), refers.is_valid
                    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_uri(key)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{label(digest)}")]
                    headers += [] if key is None else [("X-Key", str(key))]
                    headers += [("WARC-Target-URI", quote(url.as_py(), safe="!#$&'()*+,/:;=?@[]~"))] if url.is_valid else []
                    if revisit:
                        profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
                        headers += [("WARC-Profile", profile), ("WARC-Refers-To", record_uri(refers.as_py())), ("X-Refers-To-Key", str(refers.as_py())), ("X-Payload-Length", str(len(body)))]
                    headers.append(("Content-Length", "0" if revisit else str(len(body))))
                    archive.add(headers, memoryview(b"") if revisit else body)
        done += [archive.close()] if archive else []
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return cut_lineage(records.mapInArrow(run, _MANIFEST))


def members(path: str) -> Iterator[bytes | None]:
    """Pieces of the unpacked records of an archive, at most ``CHUNK`` bytes each, and None after each record."""
    system, at = store(path)
    with system.open_input_stream(at, compression=None) as source:
        packed, unpacker = b"", zlib.decompressobj(wbits=31)
        while True:
            if not packed:
                packed = source.read(CHUNK)
                if not packed:
                    return
            piece = unpacker.decompress(packed, CHUNK)
            if piece:
                yield piece
            packed = unpacker.unconsumed_tail
            if unpacker.eof:
                yield None
                packed, unpacker = unpacker.unused_data, zlib.decompressobj(wbits=31)


def chunks(path: str) -> Iterator[dict]:
    """Rows of ``CHUNKS`` of one archive in order. Every record has at least one row; the last has ``last``."""
    head, row, digest, left, done = b"", None, None, 0, 0
    for piece in members(path):
        if piece is None:
            if row is None or left:
                raise ValueError(f"a record of {path} is cut short")
            head, row = b"", None
            continue
        if row is None:
            head += piece
            top, gap, piece = head.partition(LINE + LINE)
            if not gap:
                continue
            named = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
            left, done, digest = int(named["Content-Length"]), 0, hashlib.sha1()
            row = {
                "path": path, "record_id": named["WARC-Record-ID"], "page_id": int(named["X-Key"]) if "X-Key" in named else None,
                "target_uri": unquote(named["WARC-Target-URI"]) if "WARC-Target-URI" in named else None, "record_type": named["WARC-Type"],
                "refers_to": int(named["X-Refers-To-Key"]) if "X-Refers-To-Key" in named else None,
                "payload_digest": named["WARC-Payload-Digest"].removeprefix("sha1:"), "full_bytes": int(named.get("X-Payload-Length", left)), "chunk": -1,
            }
            if not left:
                yield row | {"chunk": 0, "last": True, "payload": b"", "bytes_so_far": 0, "digest_so_far": label(digest)}
        if left and piece:
            piece = piece[:left]
            digest.update(piece)
            left, done = left - len(piece), done + len(piece)
            row["chunk"] += 1
            yield row | {"last": not left, "payload": piece, "bytes_so_far": done, "digest_so_far": label(digest)}


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The chunk table of all archives of a manifest, an archive at a time per task.

    ``payload=False`` leaves the bytes out; lengths and digests are still taken from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in chunks(path):
                    rows.append(row if payload else row | {"payload": None})
                    size += 500 + len(row["payload"]) * payload
                    if size > 4 * CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return manifest.mapInArrow(run, CHUNKS)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) of (page_id, url, html).

    Of pages with equal payloads of ``least_bytes`` or more, the smallest
    page_id is referred to by the others. Only digests are grouped; payloads move only
    where the groups with copies are too many to be sent to all tasks. Rows with
    a null page_id are responses and are referred to by none; of repeated rows with one
    page_id, all are alike.
    """
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    made = made.withColumn("digest", F.sha2("payload", 256))
    known = made.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("digest", "page_id")
    copied = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("final")).where("first < final").select("digest", "first")
    return made.join(copied, "digest", "left").select("page_id", "url", "payload", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to a new folder of the shared checkpoint folder and read the records back: one row per record."""
    folder = f"{use_checkpoint_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4()}"
    system, path = store(folder)
    system.create_dir(path, recursive=True)
    rows = read_archives(write_archives(with_revisits(pages, least_bytes), folder), payload=False).where("last")
    return rows.select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "record_id", F.col("target_uri").alias("url"),
        ((F.col("record_type") == "revisit") | (F.col("digest_so_far") == F.col("payload_digest")) & (F.col("bytes_so_far") == F.col("full_bytes"))).alias("verified"),
    )

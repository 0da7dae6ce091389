"""WARC archives compressed record by record with a Zstandard dictionary, and their reader.

An archive begins with a skippable frame that holds a dictionary built from the archive's own records; each record
follows as a frame of its own, compressed with that dictionary, so that a record can be read alone from its offset. Archives
are written by the tasks, in parallel, into one folder that all executors see, under names that no other attempt of
the task uses; the manifest of finished attempts says which count, so a lost or repeated attempt harms nothing.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, new_path, partitions, staged

#: Fixed values of the format: the skippable frame's magic number, and that of dictionaries.
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of the dictionary, and of the records it is built from (the first of the archive; all are archived).
DICT_BYTES = 1 << 15
SAMPLE_BYTES = 1 << 20
#: An archive is closed once it holds so many bytes of records before compression.
ARCHIVE_BYTES = 1 << 27
READ_BYTES = 1 << 16


def _record_id(page_id: int | None, salt: str = "") -> str:
    """A version-8 UUID that carries the page's id; of pages without one, a random UUID."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    n = page_id & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=(0x717569726500 << 80) | (8 << 76) | ((n >> 62) << 64) | (2 << 62) | (n & ((1 << 62) - 1)))}>"


def _page_of(record_id: str) -> int | None:
    u = uuid.UUID(record_id.removeprefix("<urn:uuid:").removesuffix(">"))
    if u.version != 8:
        return None
    n = ((u.int >> 64) & 3) << 62 | (u.int & ((1 << 62) - 1))
    return n - (1 << 64) if n >> 63 else n


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of ``original`` with the payload left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if original is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if original is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(original)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on ``samples``; where they are too few to train on, their own last bytes."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


class ArchiveWriter:
    """Writes one archive to a binary stream."""

    def __init__(self, out, samples: list[bytes]):
        self.out, self.at = out, 0
        raw = build_dictionary(samples)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw))
        self._put(struct.pack("<II", SKIPPABLE, len(raw)) + raw)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, rec: bytes) -> int:
        """Append a record; returns its offset."""
        at = self.at
        self._put(self.zstd.compress(rec))
        return at


def read_archive(stream) -> Iterator[tuple[int, bytes]]:
    """(number, record) of an archive, in order, from a binary stream; memory holds one frame at a time.

    What follows a frame's end is handed on whole, so READ_BYTES is small beside an archive, yet holds many records.
    """
    head = stream.read(8)
    if len(head) < 8:
        return
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with its dictionary")
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    held, number = b"", 0
    dec = zstd.decompressobj()
    parts: list[bytes] = []
    while True:
        if not held:
            held = stream.read(READ_BYTES)
            if not held:
                break
        parts.append(dec.decompress(held))
        held = b""
        if dec.eof:
            yield number, b"".join(parts)
            number, parts, held = number + 1, [], dec.unused_data
            dec = zstd.decompressobj()
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(rec: bytes) -> dict:
    """Headers and payload of a record."""
    head, _, body = rec.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = body[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "payload_bytes": size}


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, original``: the page with an equal payload and the smallest id, where another."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    slim = p.where(F.octet_length("html") >= min_bytes).select("page_id", "sha1")
    first = slim.groupBy("sha1").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    # The pages, with their payloads, are joined by their own id, which no two share; only ids meet by payload.
    again = slim.join(first, "sha1").where("page_id is distinct from original").distinct()
    again = again.select(F.col("page_id").alias("id"), F.col("sha1").alias("digest"), "original")
    return p.join(again, p.page_id.eqNullSafe(again.id) & (p.sha1 == again.digest), "left").select("page_id", "url", "html", "sha1", "original")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for every row of ``pages``; returns the manifest (archive, records, bytes), written and reread.

    The payload is html in UTF-8, null the empty payload. Of records with equal payloads of at least ``min_bytes`` bytes
    the one with the smallest page_id is a response and the others revisit it; all smaller payloads are responses. Rows
    that share that smallest page_id are responses too; a row without a page_id is a revisit where a row with one has
    the payload, and else a response. A null url leaves the target out. An empty table writes no archive.
    """
    ready = with_originals(pages, min_bytes)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        attempt, number = uuid.uuid4().hex, 0
        writer, out, path, count, size = None, None, "", 0, 0
        waiting: list[bytes] = []
        waits = 0

        def start():
            nonlocal writer, out, path, number, waits
            path = f"{root}/{attempt}-{number:05d}.warc.zst"
            out = fs.open_output_stream(path)
            writer = ArchiveWriter(out, waiting)
            number += 1
            for r in waiting:
                writer.add(r)
            waiting.clear()
            waits = 0

        def close():
            nonlocal writer, count, size
            out.close()
            done = pa.RecordBatch.from_arrays([pa.array([os.path.basename(path)]), pa.array([count], pa.int64()), pa.array([writer.at], pa.int64())], ["archive", "records", "bytes"])
            writer, count, size = None, 0, 0
            return done

        for batch in batches:
            for page_id, url, html, sha1, original in zip(*(c.to_pylist() for c in batch.columns)):
                rec = record(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), original)
                count += 1
                size += len(rec)
                if writer is None:
                    waiting.append(rec)
                    waits += len(rec)
                    if waits >= SAMPLE_BYTES:
                        start()
                else:
                    writer.add(rec)
                if writer is not None and size >= ARCHIVE_BYTES:
                    yield close()
        if waiting:
            start()
        if writer is not None:
            yield close()

    return staged(ready.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, html, archive, number: every record.

    html is null for a revisit. The digest of a response's payload is computed anew and must equal its header's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html", "archive", "number"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{archive}") as stream:
                    for number, raw in read_archive(stream):
                        f = parse(raw)
                        kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (base64.b32encode(hashlib.sha1(f["payload"]).digest()).decode() != digest or len(f["payload"]) != f["payload_bytes"]):
                            raise ValueError(f"{archive}, record {number}: the payload is damaged")
                        refers = f.get("warc-refers-to")
                        rows.append((_page_of(f["warc-record-id"]), f.get("warc-target-uri"), kind, f["payload_bytes"], digest, _page_of(refers) if refers else None, f["payload"].decode() if kind == "response" else None, archive, number))
                        size += len(raw)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string, archive string, number long"
    spark = manifest.sparkSession
    return manifest.select("archive").repartition(max(partitions(spark), spark.sparkContext.defaultParallelism)).mapInArrow(read, schema)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), folder)

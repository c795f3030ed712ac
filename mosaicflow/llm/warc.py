"""WARC archives and their chunked record table.

Pages are written as gzip-member WARC records, one archive a task, and read back as rows
(record_id, chunk_no, ...) of at most CHUNK_BYTES each. Every chunk carries the digest of the
payload so far, so the last one has the digest of the whole and no reader holds a whole record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, filesystem, fresh_uri, written

CHUNK_BYTES = 64 << 10
#: Compressed bytes of whole records that one row of the manifest stands for.
SEGMENT_BYTES = 4 << 20
#: Payloads shorter than this are never replaced by a revisit.
REVISIT_FROM = 100
#: Reading tasks for each core, at most; fewer where there are fewer segments.
TASKS_PER_CORE = 8
_READ = 256 << 10
#: Bytes of payload that go to the compressor at a time.
_WRITE = 1 << 20
#: Bytes of a block of header lines, at most; what has more is damaged.
MOST_HEADER = 1 << 20
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NOT_IN_URI = re.compile(r"[\x00-\x20\x7f<>\"]")

MANIFEST = "path string, start long, length long, records long"
CHUNKS = (
    "record_id string, page_id long, record_type string, refers_to long, refers_to_record string, target_uri string, payload_length long, "
    "chunk_no int, chunk_offset long, chunk_bytes long, digest_so_far string, is_last boolean, payload binary"
)


def plan_records(pages: DataFrame) -> DataFrame:
    """Page rows with payload_digest, record_type, refers_to, first_url and is_first.

    A null html is an empty payload. Of payloads of REVISIT_FROM bytes and more that are equal, the row
    with the smallest page_id is the response; rows that repeat that page_id are responses as well, one of them being first; rows
    without a page_id refer to it. Digests are grouped with partial aggregation, so a hot payload costs
    one row a task before the shuffle, and the join back is one that can be split when skewed.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "row": F.monotonically_increasing_id()})
    first = (
        rows.where(F.octet_length("payload") >= REVISIT_FROM)
        .groupBy(F.col("payload_digest").alias("first_digest"))
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row", "url"))).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1 AND first IS NOT NULL")
        .drop("copies")
    )
    again = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return rows.join(first, F.col("payload_digest") == F.col("first_digest"), "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.page_id")).alias("refers_to"),
        F.when(again, F.col("first.url")).alias("first_url"), F.coalesce(F.col("first.row") == F.col("row"), F.lit(False)).alias("is_first"),
    )


def _uri(url: str) -> str:
    """A url with what can't stand in a header line or a URI percent-encoded."""
    return _NOT_IN_URI.sub(lambda m: f"%{ord(m[0]):02X}", url)


def record_header(page_id, url, size: int, digest: str, kind: str, refers_to, first_url, is_first: bool, archive: str, date: str) -> bytes:
    """The header lines of a record and of the HTTP response in it, for a payload of size bytes.

    A record without url has its own id as target. The record that others revisit has an id that follows from the archive and the
    digest, so revisits name it without knowing where it was written.
    """
    original = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}/{digest}").urn
    own = original if is_first else uuid.uuid4().urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}", f"WARC-Target-URI: {own if url is None else _uri(url)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_IDENTICAL}", f"WARC-Refers-To: <{original}>", f"WARC-Refers-To-Target-URI: {original if first_url is None else _uri(first_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(http) + (0 if kind == 'revisit' else size)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + http


def write_member(out, header: bytes, payload) -> int:
    """Write a record as one gzip member, a part of its payload at a time, and return the bytes written."""
    z, view, n = zlib.compressobj(1, zlib.DEFLATED, 31), memoryview(payload), 0
    for data in (header, *(view[k : k + _WRITE] for k in range(0, len(view), _WRITE)), b"\r\n\r\n"):
        if got := z.compress(data):
            out.write(got)
            n += len(got)
    out.write(last := z.flush())
    return n + len(last)


def write_archives(planned: DataFrame, uri: str | None = None) -> DataFrame:
    """Write planned records below uri (a new folder in the shared one if None) and return the manifest, itself written.

    A lost task is run again under another file name; only files that the manifest names count. An empty
    table gives an empty manifest. A very long payload is written in parts, without a copy. WARC-Date is the time of this call.
    """
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    uri = uri or fresh_uri(planned.sparkSession, "warc")
    bound_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        segments, at, start, n = [], 0, 0, 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("page_id", "url", "payload_digest", "record_type", "refers_to", "first_url", "is_first")]
            for payload, page_id, url, digest, kind, refers_to, first_url, is_first in zip(batch.column("payload"), *columns, strict=True):
                payload = payload.as_buffer()
                if out is None:
                    files, folder = filesystem(uri)
                    files.create_dir(folder, recursive=True)
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(path, compression=None)
                header = record_header(page_id, url, payload.size, digest, kind, refers_to, first_url, is_first, uri, date)
                at, n = at + write_member(out, header, b"" if kind == "revisit" else payload), n + 1
                if at - start >= SEGMENT_BYTES:
                    segments.append((path, start, at - start, n))
                    start, n = at, 0
        if out is not None:
            out.close()
            if n:
                segments.append((path, start, at - start, n))
        if segments:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*segments, strict=True)], names=["path", "start", "length", "records"])

    return written(planned.mapInArrow(run, MANIFEST), "warc-manifest").withColumn("uri", F.lit(uri))


class _Members:
    """Decompressed bytes of gzip members in part of a file, a bounded buffer at a time."""

    def __init__(self, source, length: int):
        self.source, self.left, self.z, self.buffer, self.rest = source, length, None, bytearray(), b""

    def _more(self) -> bool:
        while True:
            data = self.rest
            if not data and self.left:
                data = self.source.read(min(_READ, self.left))
                self.left -= len(data)
            if not data:
                return False
            self.z = self.z or zlib.decompressobj(31)
            got = self.z.decompress(data, _READ)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, None
            if got:
                self.buffer += got
                return True

    def header(self) -> dict[bytes, bytes] | None:
        """Lines up to an empty one as a dict with lower-case names; None at the end."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if len(self.buffer) > MOST_HEADER:
                raise ValueError("a header doesn't end")
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("a record is cut")
                return None
        lines = bytes(self.buffer[:end]).split(b"\r\n")
        del self.buffer[: end + 4]
        return {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)} | {b"": str(end + 4).encode()}

    def chunk(self, most: int) -> bytes:
        while len(self.buffer) < most and self._more():
            pass
        got = bytes(self.buffer[:most])
        del self.buffer[:most]
        return got


def archives(spark: SparkSession, uri: str) -> DataFrame:
    """A manifest of all *.warc.gz files right below a folder, whoever wrote them: one row a file."""
    from pyarrow import fs

    files, folder = filesystem(uri)
    found = [(x.path, 0, x.size, None) for x in files.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".warc.gz")]
    return spark.createDataFrame(sorted(found), MANIFEST).withColumn("uri", F.lit(uri))


def chunks_of(uri: str, name: str, start: int, length: int, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> Iterator[tuple]:
    """Rows of CHUNKS for the records in part of a file."""
    files, _ = filesystem(uri)
    number_of = lambda x: int(x) if x and x.isdigit() else None
    text = lambda x: x and x.decode("utf-8", "replace").strip("<>")
    with files.open_input_file(name) as source:
        source.seek(start)
        members = _Members(source, length)
        while (head := members.header()) is not None:
            left, kind = int(head[b"content-length"]), head.get(b"warc-type", b"").decode()
            declared = left
            if left and head.get(b"content-type", b"").lower().startswith(b"application/http"):
                http = members.header()
                if http is None:
                    raise ValueError(f"{name}: a record is cut")
                left -= int(http[b""])
                declared = number_of(http.get(b"content-length")) if kind == "revisit" else left
            recorded = head.get(b"warc-payload-digest", b"").decode()
            recorded = recorded.removeprefix("sha256:") if re.fullmatch("sha256:[0-9a-f]{64}", recorded) else None
            same = (text(head.get(b"warc-record-id")), number_of(head.get(b"x-page-id")), kind, number_of(head.get(b"x-refers-to-page-id")), text(head.get(b"warc-refers-to")), text(head.get(b"warc-target-uri")), declared)
            digest, number, offset = hashlib.sha256(), 0, 0
            while True:
                data = members.chunk(min(chunk_bytes, left))
                if left and not data:
                    raise ValueError(f"{name}: a record is cut")
                digest.update(data)
                left -= len(data)
                so_far = recorded if kind == "revisit" else digest.copy().hexdigest()
                if not left and recorded and so_far != recorded:
                    raise ValueError(f"{name}: payload digest differs in {same[0]}")
                yield (*same, number, offset, len(data), so_far, not left, data if with_payload else None)
                number, offset = number + 1, offset + len(data)
                if not left:
                    break
            members.chunk(4)


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest.

    One row per record and chunk number, from 0; a record without payload has one empty chunk. digest_so_far is
    the SHA-256 of the payload up to and with the chunk; for revisits the recorded one. A payload whose digest isn't
    the recorded one, a cut archive or a header without end raises. with_payload=False leaves payload null. No record is held whole, however long.
    Records of other kinds and writers are rows like others: the payload is the block, less the HTTP header where there is one; page_id and
    refers_to are null; only digests in hexadecimal SHA-256 are checked.
    """
    bound_batches(manifest.sparkSession)

    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(pending):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pending, strict=True), types, strict=True)], names=names)

        pending, size = [], 0
        for batch in batches:
            for part in zip(*(batch.column(k).to_pylist() for k in ("uri", "path", "start", "length")), strict=True):
                for row in chunks_of(*part, chunk_bytes, with_payload):
                    pending.append(row)
                    size += 200 + (row[9] if with_payload else 0)
                    if size >= 4 << 20:
                        yield batch_of(pending)
                        pending, size = [], 0
        if pending:
            yield batch_of(pending)

    # Dealt by number: by bytes, the few bytes of a manifest would all be one task's.
    spark = manifest.sparkSession
    tasks = min(manifest.count(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return manifest.select("uri", "path", "start", "length").repartition(max(1, tasks)).mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk, which carries the totals: no shuffle."""
    return chunks.where("is_last").select("page_id", F.col("payload_length").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")

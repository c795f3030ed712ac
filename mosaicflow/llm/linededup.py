"""Line dedup: common lines go, but in the largest document that holds each; the result is bitmaps of lines, not text.

A line of enough characters is 128 bits of hash, its document and its number. These rows are range-partitioned by hash and
document and sorted, largest document first, so each partition is read once as a stream: the first document of a hash keeps
its lines, the others lose theirs as soon as enough documents have been seen. A hash may go on in the next partition, however
many there are, so a line that every document holds is no single task's. Only the first and the last hash of a partition can;
their counts are a row a partition each, and their open lines are decided once those are added up.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, bound_batches, discard, map_batches, written

LEAST_CHARS, LEAST_DOCS = 40, 5
_SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id: a document of its own, less than any other.
NO_ID = -(1 << 63)
#: Lines for each range partition, at most.
PARTITION_LINES = 4_000_000

LINES = "high long, low long, doc long, text_hash long, line int"
VERDICTS = f"kind string, {LINES}, documents long"
_NAMES = ["high", "low", "doc", "text_hash", "line"]
_TYPES = [np.int64, np.int64, np.int64, np.int64, np.int32]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by (doc, text_hash), which tells the lines of rows apart that share a doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID).cast("long")).alias("doc"), F.xxhash64(text).alias("text_hash"), doc_id.alias("doc_id"), text.alias("text"))


def _lines(keyed: DataFrame, least_chars: int) -> DataFrame:
    """LINES of enough characters."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = pc.split_pattern(batch.column("text").cast(pa.large_string()), "\n")
        ends = lines.offsets.to_numpy()
        keys = pc.ascii_lower(pc.utf8_trim(lines.values, _SPACE))
        chosen = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least_chars).to_numpy(zero_copy_only=False))
        row = np.searchsorted(ends, chosen, "right") - 1
        digests = b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(chosen)).cast(pa.large_binary()).to_pylist()))
        hashes = np.frombuffer(digests, ">i8").reshape(-1, 2)
        doc, text_hash = (batch.column(c).to_numpy()[row] for c in ("doc", "text_hash"))
        columns = (hashes[:, 0], hashes[:, 1], doc, text_hash, chosen - ends[row])
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    return map_batches(keyed.select("doc", "text_hash", "text"), kernel, LINES)


def _rows(kind: str, columns: list[np.ndarray], documents: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(columns[0])
    counts = pa.array(documents, pa.int64()) if documents is not None else pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), *(pa.array(c) for c in columns), counts], names=["kind", *_NAMES, "documents"])


def stream(batches: Iterator[list[np.ndarray]], least_docs: int) -> Iterator[pa.RecordBatch]:
    """VERDICTS on the sorted lines of one partition: drop, open with its hash, and edge with the hash's largest document and its number of them.

    A line waits while its document is the second to the last but one that a hash needs; nothing else is held from batch to batch.
    """
    none = [np.zeros(0, t) for t in _TYPES]
    waiting, current, documents, largest, last_doc = none, None, 0, 0, 0
    at_start, edges = True, []  # whether the current hash is the partition's first

    for columns in batches:
        high, low, doc = columns[:3]
        if not len(high):
            continue
        goes_on = current == (high[0], low[0])
        other = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        new_doc = np.concatenate([[not goes_on or doc[0] != last_doc], other | (doc[1:] != doc[:-1])])
        begin = np.concatenate([[0], np.flatnonzero(other) + 1])
        run = np.concatenate([[0], np.cumsum(other)])
        seen = np.cumsum(new_doc)
        #: Each line's document is the number-th of its hash.
        number = seen - (seen[begin] - new_doc[begin])[run] + np.where(run == 0, documents if goes_on else 0, 0)
        totals = number[np.concatenate([begin[1:], [len(high)]]) - 1]
        if not goes_on:
            if current is not None and at_start:
                edges.append((*current, largest, documents))
                at_start = False
            waiting, largest = none, doc[0]

        opens = (run == 0) & at_start
        waits = (number > 1) & (number < least_docs) & ~opens
        enough = (totals >= least_docs)[run]
        gone = (number > 1) & ((number >= least_docs) | enough) & ~opens
        if totals[0] >= least_docs and len(waiting[0]):
            yield _rows("drop", waiting)
            waiting = none
        if opens.any():
            yield _rows("open", [c[opens] for c in columns])
        if gone.any():
            yield _rows("drop", [c[gone] for c in columns])
        if len(begin) > 1:
            if at_start:
                edges.append((high[0], low[0], largest, int(totals[0])))
                at_start = False
            waiting, largest = none, doc[begin[-1]]
        own = waits & ~enough & (run == len(begin) - 1)
        waiting = [np.concatenate([a, c[own]]) for a, c in zip(waiting, columns, strict=True)]
        current, documents, last_doc = (high[-1], low[-1]), int(totals[-1]), doc[-1]

    if current is not None:
        edges.append((*current, largest, documents))
        yield _rows("open", waiting)
        h, w, d, n = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        yield _rows("edge", [h, w, d, np.zeros(len(h), np.int64), np.zeros(len(h), np.int32)], n)


def _dropped(keyed: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(doc, text_hash, line) of the lines that go."""
    bound_batches(keyed.sparkSession)
    lines = written(_lines(keyed, least_chars), "lines")
    partitions = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // PARTITION_LINES))
    order = ["high", "low", F.desc("doc")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stream(([batch.column(c).to_numpy() for c in _NAMES] for batch in batches), least_docs)

    found = written(lines.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(run, VERDICTS), "line-verdicts")
    discard(lines)
    # Two rows a partition at most, whatever the input: small enough for every task.
    edges = found.where("kind = 'edge'").groupBy("high", "low").agg(F.sum("documents").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= least_docs)
    late = found.where("kind = 'open'").select(*_NAMES).join(F.broadcast(edges), ["high", "low"]).where("doc <> keeper")
    columns = ("doc", "text_hash", "line")
    return found.where("kind = 'drop'").select(*columns).unionByName(late.select(*columns))


def packed_bits(dropped: np.ndarray) -> bytes:
    """A text's lines as compressed bits, 1 for those that stay, as far as the byte of the last that goes."""
    keep = np.ones((int(dropped.max()) + 8) // 8 * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def kept_lines(keep: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each of a text's lines stays; without a bitmap all do."""
    out = np.ones(n_lines, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n_lines]
        out[: len(bits)] = bits
    return out


def bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, text_hash, n_dropped, keep) of the texts that lose lines; keep is packed_bits().

    A key is a line stripped of white space at both ends, with A-Z in lower case. Keys of least_chars code points that least_docs
    documents hold lose all their lines but in the document of the largest doc_id. Rows of one doc_id are one document, whether they
    repeat its text or not; rows without doc_id are one as well, of the least id, as are those of the least 64-bit id. Null and empty
    texts have one empty line. An empty table gives no rows, and other columns are not looked at.
    """
    return _bitmaps(_keyed(docs), least_chars, least_docs)


def _bitmaps(keyed: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = [np.array(x) for x in batch.column("lines").to_pylist()]
        packed = pa.array([packed_bits(x) for x in lines], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_hash"), pa.array([len(x) for x in lines], pa.int64()), packed], names=["doc", "text_hash", "n_dropped", "keep"])

    of_text = _dropped(keyed, least_chars, least_docs).groupBy("doc", "text_hash").agg(F.collect_set("line").alias("lines"))
    return map_batches(of_text, kernel, "doc long, text_hash long, n_dropped long, keep binary")


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep, kept_sha256, text) of every row of docs: its bitmap, null where all lines stay, and what is left, joined by line ends.

    with_text=False leaves text null. Odd rows are as in bitmaps().
    """
    keyed = _keyed(docs)
    found = written(_bitmaps(keyed, least_chars, least_docs), "line-bitmaps")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, n_dropped, keep in zip(blobs(batch.column("text")), batch.column("n_dropped").to_pylist(), batch.column("keep").to_pylist(), strict=True):
            n_lines, kept = text.count(b"\n") + 1, text
            if keep is not None:
                lines = text.split(b"\n")
                kept = b"\n".join([lines[i] for i in np.flatnonzero(kept_lines(keep, n_lines))])
            out.append((n_lines, n_dropped or 0, keep, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_lines", "n_dropped", "keep", "kept_sha256", "text"])

    joined = keyed.join(found, ["doc", "text_hash"], "left").select("doc_id", "text", "n_dropped", "keep")
    return map_batches(joined, kernel, "doc_id long, n_lines long, n_dropped long, keep binary, kept_sha256 string, text string")

"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of 64 bits are made from hashes of word shingles. Two that differ in at most 2 bits agree in at least two of
four 16-bit quarters, so each distinct fingerprint goes to the buckets of its six pairs of quarters. In a bucket, bit planes
are stored vertically: one word has one bit of 64 fingerprints. Differences are added up in carry-save counters, 64 at a
time, and a row of words is abandoned once all its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, bound_batches, documents, map_batches, written
from .components import roots

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints of one bucket that one cell compares; a larger bucket is cut into parts, and each pair of parts is a cell.
CELL = 1024
_CHUNK = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of lower-cased words; 0 for none."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    n = len(words) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp as a signed long. A null or empty text, or one without words, has 0."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, size) for x in blobs(batch.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(documents(docs), kernel, "doc_id long, fp long")


def _planes(members: np.ndarray) -> np.ndarray:
    """Of fingerprints (buckets, 64 * words): words (buckets, 64 planes, words) with one bit of 64 fingerprints each."""
    n, m = members.shape
    bits = np.unpackbits(members.view(np.uint8).reshape(n, m, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")


def near(queries: np.ndarray, members: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, query, member) of all fingerprints at radius bits or fewer, for radius 2; members' number is a multiple of 64."""
    if radius != 2:
        raise ValueError("the two counter planes hold radius 2")
    planes = _planes(members)
    bucket, query = (x.ravel() for x in np.indices(queries.shape))
    wanted = queries.ravel()
    shape = (len(wanted), planes.shape[2])
    ones, twos, over = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
    for p in range(64):
        spread = np.where((wanted >> np.uint64(p)) & np.uint64(1), _ALL, np.uint64(0))
        differ = planes[bucket, p] ^ spread[:, None]
        carry = ones & differ
        ones ^= differ
        twos |= carry
        over |= ones & twos
        if p % 8 == 7 and (gone := (over == _ALL).all(axis=1)).any():
            left = ~gone
            bucket, query, wanted, ones, twos, over = (x[left] for x in (bucket, query, wanted, ones, twos, over))
            if not len(wanted):
                break
    at, member = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(len(wanted), shape[1] * 8), axis=1, bitorder="little"))
    return bucket[at], query[at], member


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest number of its group, after the links a-b."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def _cell_links(fps: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each fingerprint of a cell, the smallest number of those it is linked with there. side: the part each is of."""
    label = np.arange(len(fps))
    queries = np.flatnonzero(side == side[0]) if side[0] != side[-1] else np.arange(len(fps))
    padded = np.concatenate([fps, np.zeros(-len(fps) % 64, np.uint64)])[None]
    for at in range(0, len(queries), 256):
        own = queries[at : at + 256]
        _, q, member = near(fps[own][None], padded)
        real = member < len(fps)
        label = _united(label, own[q[real]], member[real])
    return label


def _links(key: np.ndarray, fps: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that join what is near within each run of one key; fewer than there are positions."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([begin, [len(key)]]))
    out_a, out_b = [], []
    for width in (2, 8, 64):
        least = {2: 2, 8: 3, 64: 9}[width]
        runs = np.flatnonzero((size >= least) & (size <= width))
        for part in np.array_split(runs, len(runs) * width // 8192 + 1):
            if not len(part):
                continue
            inside = np.arange(width) < size[part, None]
            at = np.where(inside, begin[part, None] + np.arange(width), 0)
            members = np.zeros((len(part), 64), np.uint64)
            members[:, :width] = np.where(inside, fps[at], 0)
            bucket, q, m = near(members[:, :width].copy(), members)
            real = (m < size[part][bucket]) & (q < m)
            a, b = begin[part][bucket[real]] + q[real], begin[part][bucket[real]] + m[real]
            if len(a):
                used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                label = _united(np.arange(len(used)), place[: len(a)], place[len(a) :])
                moved = label != np.arange(len(used))
                out_a.append(used[moved])
                out_b.append(used[label[moved]])
    for run in np.flatnonzero(size > 64):
        own = slice(begin[run], begin[run] + size[run])
        label = _cell_links(fps[own], side[own])
        moved = np.flatnonzero(label != np.arange(len(label)))
        out_a.append(begin[run] + moved)
        out_b.append(begin[run] + label[moved])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each cell, of rows that come sorted by cell and side; a cell may go over batches."""
    rest: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        bucket, fps, part, side, node = (table.column(k).to_numpy() for k in ("bucket", "fp", "cell", "side", "node"))
        key = np.unique(np.stack([bucket, part], axis=1), axis=0, return_inverse=True)[1].ravel()
        a, b = _links(key, fps.view(np.uint64), side)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if sum(x.num_rows for x in rest) < 1 << 16:
            continue
        whole = pa.Table.from_batches(rest).combine_chunks()
        bucket, cell = whole.column("bucket").to_numpy(), whole.column("cell").to_numpy()
        differs = np.flatnonzero((bucket != bucket[-1]) | (cell != cell[-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield links(whole.slice(0, cut))
        rest = whole.slice(cut).combine_chunks().to_batches()
    if rest:
        yield links(pa.Table.from_batches(rest).combine_chunks())


def _bucket_columns() -> list:
    """A number for each pair of quarters with its 32 bits, as one long."""
    quarter = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    return [F.lit(number << 32).bitwiseOR(F.shiftleft(quarter[i], 16)).bitwiseOR(quarter[j]) for number, (i, j) in enumerate(combinations(range(4), 2))]


def links(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) between nodes that join all fingerprints at RADIUS bits or fewer; nodes: (node, fp), fp distinct.

    A bucket gives fewer links than it has rows. Buckets of more than cell rows are dealt over cells, by pairs of their parts,
    so that none is one task's work and every pair in them is still compared.
    """
    bound_batches(nodes.sparkSession)
    rows = nodes.select("node", "fp", F.explode(F.array(*_bucket_columns())).alias("bucket"))
    sizes = rows.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = rows.join(sizes, F.col("bucket") == F.col("of")).drop("of")
    n_parts = F.ceil(F.col("n") / cell).cast("int")
    rows = rows.withColumns({"parts": n_parts, "side": F.pmod(F.xxhash64("fp"), n_parts.cast("long")).cast("int")})
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.least("side", other) * F.col("parts") + F.greatest("side", other))
    rows = rows.select("node", "fp", "bucket", "side", F.explode(pairs).alias("cell"))
    dealt = rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "side", "node")
    return dealt.mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id that links of RADIUS bits or fewer reach, its own included. Documents without words
    have fingerprint 0 and are linked like others. Rows that repeat a doc_id are each answered; rows without doc_id take the
    id of those they are linked with, null if that is none.
    """
    prints = written(fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    found = roots(links(nodes.where("node IS NOT NULL")))
    ids = nodes.join(found.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select(F.col("fp").alias("fp_"), F.coalesce("root", "node").alias("component_id"))
    return prints.join(ids, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs, all columns, of each group that links of RADIUS bits or fewer join: that of smallest doc_id, then of least hash of its text.

    Rows without doc_id go, also where a group has nothing else. A doc_id that repeats with other texts is judged row by row, so it
    stays in each group that it is the smallest of; rows that repeat both are one.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    free = max(map(len, docs.columns), default=0) * "_"  # no column is called so
    keys = {f"none{free}": doc_id.isNull(), f"id{free}": F.coalesce(doc_id, F.lit(0)), f"hash{free}": F.xxhash64(text)}
    names = list(keys)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x) for x in blobs(batch.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(found.view(np.int64))], names=[*names, "fp"])

    prints = map_batches(docs.select(*(c.alias(k) for k, c in keys.items()), text.alias("text")), kernel, f"{names[0]} boolean, {names[1]} long, {names[2]} long, fp long")
    nodes = written(prints.groupBy("fp").agg(F.min(F.struct(*names)).alias("least")), "fingerprint-nodes")
    found = roots(links(nodes.select(F.col("fp").alias("node"), "fp"))).withColumnRenamed("node", "linked")
    group = F.coalesce("root", "fp").alias("group")
    kept = nodes.join(found, F.col("fp") == F.col("linked"), "left").groupBy(group).agg(F.min("least").alias("least")).select("least.*").where(f"NOT {names[0]}")
    return docs.withColumns(keys).join(kept, names).dropDuplicates(names).select(*docs.columns)

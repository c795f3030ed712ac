"""Alignment of two tokenizers: bytes at which both have a token's end cut a text into groups, and tokens that end together are linked.

Each text is tokenised once. A task gathers the pairs of ids that its texts link into blocks; blocks hold counts, so what is
shuffled is a row for each distinct pair of a block. Pairs are summed in two shuffles, salted by block first, since few pairs
make up much of any text. Counts go back to the blocks that asked for them by joins on pair and block: no task opens more than
the blocks it was dealt, and no table of all pairs is ever in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, documents, texts, written
from .tokens import ByteBPE, PieceBPE

A, B = "byte_bpe_50k", "piece_bpe_32k"
#: A block ends at the batch that brings it to so many distinct pairs or bytes of text.
BLOCK_PAIRS, BLOCK_BYTES = 200_000, 24 << 20
#: Pairs of a block in one row.
ROW_PAIRS = 1 << 14
SALTS = 16
ALIGNED = "kind string, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<long>"
_NAMES = [x.split()[0] for x in ALIGNED.split(", ")]
_TYPES = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"


class Aligned(NamedTuple):
    """Ids of both tokenizers, the group of each token, and the indexes of linked tokens."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.group_a[-1]) + 1 if len(self.group_a) else 0


def aligned(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Tokens of the same bytes, by their ids and the bytes of each, which may be none."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=bool(size_a.all() and size_b.all()))
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    first_a, first_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    n_a, n_b = np.searchsorted(end_a, cuts, "right") - first_a, np.searchsorted(end_b, cuts, "right") - first_b
    n = n_a * n_b
    cut = np.repeat(np.arange(len(cuts)), n)
    within = np.arange(len(cut)) - np.repeat(np.cumsum(n) - n, n)
    return Aligned(a, b, group_a, group_b, first_a[cut] + within // n_b[cut], first_b[cut] + within % n_b[cut])


def _decimal(count: int) -> np.ndarray:
    return np.array([f"{i}," for i in range(count)], dtype="S")


def groups_text(x: Aligned, decimal: np.ndarray) -> bytes:
    """Groups as a1,a2|b1;a3|b2,b3; decimal has each id with a comma."""
    place_a = np.arange(len(x.a)) + np.searchsorted(x.group_b, x.group_a)
    place_b = np.arange(len(x.b)) + np.searchsorted(x.group_a, x.group_b, "right")
    out = np.empty(len(x.a) + len(x.b), decimal.dtype)
    out[place_a], out[place_b] = decimal[x.a], decimal[x.b]
    ends = np.zeros(len(out), np.uint8)
    for place, group, sign in ((place_a, x.group_a, b"|"), (place_b, x.group_b, b";")):
        ends[place[np.append(group[1:] != group[:-1], True)]] = sign[0]
    letters = out.view(np.uint8).reshape(len(out), -1)
    row, at = np.flatnonzero(ends), np.char.str_len(out) - 1
    letters[row, at[row]] = ends[row]
    return letters[letters > 0].tobytes()[:-1]


def align(docs: DataFrame, vocabulary_a: str = A, vocabulary_b: str = B, with_groups: bool = True) -> DataFrame:
    """ALIGNED: a row of kind text for each of docs, with its distinct linked pairs and how often it has each, and rows of kind block with those of whole blocks.

    A pair is a's id times 2 ** 32 plus b's. Both tokenise a space and the text. Texts that are null, empty or not given back byte for byte by the tokens of both
    have none. with_groups=False leaves groups null but not their digest.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteBPE(vocabulary_a), PieceBPE(vocabulary_b)
        bytes_a, bytes_b = first.token_bytes(), second.token_bytes()
        size_a, size_b = (np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b))
        decimal = _decimal(max(len(bytes_a), len(bytes_b)))
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        nothing = (0, 0, 0, 0, None, "", [], [])

        def of(text: str, b: np.ndarray) -> tuple:
            a, data = first.ordinary(f" {text}"), f" {text}".encode()
            if b"".join([bytes_a[i] for i in a.tolist()]) != data or b"".join([bytes_b[i] for i in b.tolist()]) != data:
                return nothing
            x = aligned(a, b, size_a[a], size_b[b])
            pairs, times = np.unique(a[x.link_a].astype(np.int64) << 32 | b[x.link_b], return_counts=True)
            held.append((pairs, times))
            groups = groups_text(x, decimal)
            return len(a), len(b), x.n_groups, len(x.link_a), groups.decode() if with_groups else None, hashlib.sha256(groups).hexdigest(), pairs, times

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, times = (np.concatenate(x) for x in zip(*held, strict=True))
            pairs, at = np.unique(pairs, return_inverse=True)
            return pairs, np.bincount(at, times, len(pairs)).astype(np.int64)

        def block_rows() -> pa.RecordBatch:
            pairs, times = held[0]
            parts = [slice(k, k + ROW_PAIRS) for k in range(0, len(pairs), ROW_PAIRS)]
            return _batch([("block", block, *[None] * 7, pairs[p], times[p]) for p in parts])

        for batch in batches:
            own = texts(batch.column("text"))
            there = [t for t in own if t]
            ids = iter(second.ids(there))
            yield _batch([("text", block, doc_id, *(of(t, next(ids)) if t else nothing)) for doc_id, t in zip(batch.column("doc_id").to_pylist(), own, strict=True)])
            size += sum(map(len, there))
            if held:
                held[:] = [summed()]
                if len(held[0][0]) >= BLOCK_PAIRS or size >= BLOCK_BYTES:
                    yield block_rows()
                    held.clear()
                    block, size = block + 1, 0
        if held:
            yield block_rows()

    return documents(docs).mapInArrow(run, ALIGNED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _pairs(found: DataFrame) -> DataFrame:
    """(block, pair, times) of all blocks."""
    return found.where("kind = 'block'").select("block", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best) of all pairs that align() found linked: how often, and whether no pair of the same b is more frequent."""
    salted = _pairs(found).groupBy("pair", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("times").alias("n"))
    counts = written(salted.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    # As many rows as b's vocabulary at most.
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, vocabulary_a: str = A, vocabulary_b: str = B, with_groups: bool = True) -> DataFrame:
    """COUNTED, a row for each of docs: tokens, groups, links, links whose pair no other of the same b is linked more often than, the sum of links' counts, and groups.

    Texts without tokens, as in align(), have zeros and an empty digest. Rows that repeat count each. Other columns are not looked at; an empty table gives no rows.
    """
    found = written(align(docs, vocabulary_a, vocabulary_b, with_groups), "aligned")
    counts = written(pair_counts(found), "best-pairs")
    replies = _pairs(found).select("block", "pair").join(counts, "pair").select(F.col("block").alias("asked_by"), "pair", "n", "best")
    names = [x.split()[0] for x in COUNTED.split(", ")]

    def run(own: pa.Table, reply: pa.Table) -> pa.Table:
        reply = reply.sort_by("pair")
        pair, n, best = (reply.column(c).to_numpy() for c in ("pair", "n", "best"))
        pairs = own.column("pairs").combine_chunks()
        times = own.column("times").combine_chunks().values.to_numpy()
        at = np.searchsorted(pair, pairs.values.to_numpy())
        sums = {}
        for name, value in (("n_best", times * best[at]), ("count_sum", times * n[at])):
            total = np.concatenate([[0], np.cumsum(value, dtype=np.int64)])[pairs.offsets.to_numpy()]
            sums[name] = pa.array(total[1:] - total[:-1], pa.int64())
        return pa.table([sums[c] if c in sums else own.column(c) for c in names], names=names)

    asked = found.where("kind = 'text'").select("block", *(c for c in names if c not in ("n_best", "count_sum")), "pairs", "times")
    return asked.groupBy("block").cogroup(replies.groupBy("asked_by")).applyInArrow(run, COUNTED)

"""Best-two-fit packing of token sequences.

A bin is filled greedily with the longest piece that fits, again and again; then its smallest piece gives way to two
unpacked ones that fit the expanded gap more tightly. The plan is made over the counts of each length alone: a bin that
comes out the same many times over is one row of the plan, so the plan's size depends on the sequence length, not on
the data. Pieces find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, documents, texts, written
from .tokens import ByteBPE

SEQUENCE = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, task int, rank long"


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Pieces of at most sequence ids; only documents of more are cut, and only their first piece may be shorter.

    A null or empty text is its end id alone; a very long one is tokenised in parts, cut where no token crosses. rank numbers the pieces of one length within a task. Rows that repeat
    are packed each. with_ids=False leaves ids null.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, task = ByteBPE(vocabulary), np.zeros(sequence + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                ids = np.append(bpe.ids(text), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % sequence or sequence
                for k, end in enumerate(range(first, len(ids) + 1, sequence)):
                    start = max(0, end - sequence) if k else 0
                    own = ids[start:end]
                    out.append((doc_id, k, start, end - start, zlib.crc32(own), own.tolist() if with_ids else None, task, seen[end - start]))
                    seen[end - start] += 1
            if out:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return documents(docs).mapInArrow(run, PIECES)


def _largest(lengths: int, most: int) -> int:
    """The largest length in a bit set that is at most most; 0 if none is."""
    return max(0, (lengths & ((2 << most) - 1)).bit_length() - 1)


class _Pool:
    """Counts of unpacked pieces by length, with the set of lengths that are there as bits, in both directions."""

    def __init__(self, counts: dict[int, int], sequence: int):
        self.counts, self.sequence, self.bits, self.flipped = Counter(), sequence, 0, 0
        for length, n in counts.items():
            self.add(length, n)

    def add(self, length: int, n: int) -> None:
        self.counts[length] += n
        there = self.counts[length] > 0
        for name, bit in (("bits", 1 << length), ("flipped", 1 << (self.sequence - length))):
            setattr(self, name, getattr(self, name) | bit if there else getattr(self, name) & ~bit)

    def pair(self, least: int, most: int) -> tuple[int, int] | None:
        """Two pieces whose sum is as near to most as can be, and over least."""
        for total in range(most, max(least, 1), -1):
            shift = self.sequence - total
            both = self.bits & (self.flipped >> shift if shift >= 0 else self.flipped << -shift)
            while both:
                a = both.bit_length() - 1
                b = total - a
                if b < 1 or a < b:
                    break
                if a != b or self.counts[a] > 1:
                    return a, b
                both ^= 1 << a
        return None


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """Bins as (times, lengths of the pieces, longest first)."""
    pool, bins = _Pool(counts, sequence), []
    while pool.bits:
        own, gap = [], sequence

        def fill(own=own):
            nonlocal gap
            while length := _largest(pool.bits, gap):
                own.append(length)
                pool.add(length, -1)
                gap -= length

        fill()
        while gap and len(own) > 1:
            smallest = min(own)
            if not (two := pool.pair(smallest, gap + smallest)):
                break
            own.remove(smallest)
            for length in two:
                own.append(length)
                pool.add(length, -1)
            gap += smallest - sum(two)
            pool.add(smallest, 1)
            fill()
        times = 1 + min(pool.counts[length] // n for length, n in Counter(own).items())
        for length in own:
            pool.add(length, 1 - times)
        bins.append((times, sorted(own, reverse=True)))
    return bins


def _slots(bins: list[tuple[int, list[int]]]) -> dict[int, list[np.ndarray]]:
    """By length: first rank, first sequence, pieces of the length in a sequence, and their offset there, for each row of the plan."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter[int] = Counter()
    sequence = 0
    for times, own in bins:
        for length, n in Counter(own).items():
            rows.setdefault(length, []).append((used[length], sequence, n, sum(x for x in own if x > length)))
            used[length] += n * times
        sequence += times
    return {length: list(np.array(x, np.int64).T) for length, x in rows.items()}


def pack(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """The pieces with sequence_id and offset. No row is shuffled but with the counts of its task and length."""
    cut = written(cut, "pieces")
    counts = cut.groupBy("task", "length").agg((F.max("rank") + 1).alias("n"))
    counts = written(counts, "piece-counts")
    bins = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, sequence)
    slots = cut.sparkSession.sparkContext.broadcast(_slots(bins))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    based = counts.select("task", "length", before.alias("before"))
    # Merged, not broadcast: the counts grow with the number of tasks, and look small as files.
    ranked = cut.join(based.hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                first, number, n, at = slots.value[x]
                row = np.searchsorted(first, rank[own], "right") - 1
                since = rank[own] - first[row]
                sequence_id[own], offset[own] = number[row] + since // n[row], at[row] + since % n[row] * x
            kept = [k for k in batch.schema.names if k != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(sequence_id), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    bound_batches(cut.sparkSession)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")

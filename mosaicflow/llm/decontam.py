"""Benchmark decontamination by Wu-Manber search for word windows of the benchmark's items.

Texts are normalised to lower-case words with one space between, so a window of words is a byte string
that begins and ends with a space. The search moves a cursor by block shift tables; where a shift is 0,
the suffix hash picks a bucket of test strings and bytes are compared. Many cursors step together in numpy.
The tables are built once, by Spark, a part of the benchmark in each task, and kept as arrays in the shared
folder; workers map them into memory and search each batch for one part after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mapped, release, save
from .common import blobs, bound_batches, fresh_uri, map_batches

WINDOW_WORDS = 10
#: Benchmark text that one set of tables is made of.
BLOCK_BYTES = 2 << 20
#: Bytes of text that one cursor walks through.
LANE = 512

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW_WORDS) -> list[bytes]:
    """Each window as the bytes to search for; all words if there are fewer than size, none if there are none."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def _loads(buffer: np.ndarray) -> np.ndarray:
    """Eight bytes from every position, little-endian, as unsigned integers."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))


class _Search:
    """Wu-Manber tables for patterns of which none is twice as long as the shortest."""

    TABLES = ("shift", "suffix", "numbers", "lengths", "bytes", "first")

    def __init__(self, patterns: list[bytes], numbers: np.ndarray):
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        longest = max(map(len, patterns))
        self.bits = np.uint64(64 - max(10, min(22, int(np.ceil(np.log2(16 * len(patterns) * (m - b + 1)))))))
        lengths = np.array([len(p) for p in patterns], np.int64)
        grid = np.zeros((len(patterns), longest + 8), np.uint8)
        grid[np.arange(longest + 8) < lengths[:, None]] = np.frombuffer(b"".join(patterns), np.uint8)
        loads = np.ndarray((len(patterns), longest + 1), "<u8", grid, 0, (grid.strides[0], 1))
        self.shift = np.full(1 << int(np.uint64(64) - self.bits), m - b + 1, np.int32)
        for end in range(b, m + 1):
            np.minimum.at(self.shift, self._hash(loads[:, end - b]), m - end)
        suffix = self._hash(loads[:, m - b])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.numbers, self.lengths = suffix[order], numbers[order], lengths[order]
        self.bytes, self.first = grid[order, :longest], loads[order, 0] & self.mask

    def packed(self) -> list[np.ndarray]:
        return [np.array([self.m, self.block, int(self.bits), self.bytes.shape[1]], np.int64), *(np.ascontiguousarray(getattr(self, k)).ravel() for k in self.TABLES)]

    @classmethod
    def unpacked(cls, arrays: list[np.ndarray]) -> _Search:
        search = cls.__new__(cls)
        search.m, search.block, bits, longest = map(int, arrays[0])
        search.bits, search.mask = np.uint64(bits), np.uint64((1 << (8 * search.block)) - 1)
        for name, array in zip(cls.TABLES, arrays[1:], strict=True):
            setattr(search, name, array)
        search.bytes = search.bytes.reshape(-1, longest)
        return search

    def _hash(self, values: np.ndarray) -> np.ndarray:
        return (((values & self.mask) * _MULTIPLIER) >> self.bits).astype(np.int64)

    def _candidates(self, buffer: np.ndarray, n: int) -> np.ndarray:
        """Starts of windows whose last block ends some pattern's window. The first n bytes count."""
        loads, back = _loads(buffer), self.m - self.block
        at = np.arange(0, max(0, n - self.m + 1), LANE)
        end, found = np.minimum(at + LANE, n - self.m + 1), []
        while len(at):
            step = self.shift[self._hash(loads[at + back])]
            if len(hit := at[step == 0]):
                found.append(hit)
            at = at + np.maximum(step, 1)
            if not (inside := at < end).all():
                at, end = at[inside], end[inside]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def find(self, buffer: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence: its start and its pattern's number. buffer goes on for twice m and 8 bytes after n."""
        starts, numbers = [], []
        loads, at = _loads(buffer), self._candidates(buffer, n)
        suffix = self._hash(loads[at + self.m - self.block])
        k, stop = np.searchsorted(self.suffix, suffix), np.searchsorted(self.suffix, suffix, "right")
        width = np.arange(self.bytes.shape[1])
        while len(at):
            inside = k < stop
            at, k, stop = at[inside], k[inside], stop[inside]
            likely = np.flatnonzero((loads[at] & self.mask) == self.first[k])
            for part in np.array_split(likely, len(likely) // 4096 + 1):
                same = ((buffer[at[part, None] + width] == self.bytes[k[part]]) | (width >= self.lengths[k[part], None])).all(axis=1)
                starts.append(at[part[same]])
                numbers.append(self.numbers[k[part[same]]])
            k = k + 1
        return (np.concatenate(starts), np.concatenate(numbers)) if starts else (np.zeros(0, np.int64),) * 2


class WuManber:
    """Finds all occurrences of many byte strings; strings of like length share tables, so a short one costs no others their shifts."""

    def __init__(self, patterns: list[bytes]):
        self.longest = max(map(len, patterns), default=0)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            classes.setdefault(len(p).bit_length(), []).append(i)
        self.searches = [_Search([patterns[i] for i in members], np.array(members)) for members in classes.values()]

    @classmethod
    def of(cls, searches: list[_Search]) -> WuManber:
        search = cls.__new__(cls)
        search.searches, search.longest = searches, max((s.bytes.shape[1] for s in searches), default=0)
        return search

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        buffer = np.frombuffer(data + bytes(self.longest * 2 + 8), np.uint8)
        found = [s.find(buffer, len(data)) for s in self.searches] or [(np.zeros(0, np.int64),) * 2]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


class _Windows:
    """What one part of the benchmark has to look for: the distinct windows, their numbers of words and the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        number: dict[bytes, int] = {}
        of: list[list[int]] = []
        for i, (_, text) in enumerate(items):
            for w in dict.fromkeys(windows_of(words_of(text), size)):
                if number.setdefault(w, len(number)) == len(of):
                    of.append([])
                of[number[w]].append(i)
        self.names = [name for name, _ in items]
        self.n_words = np.array([w.count(b" ") - 1 for w in number], np.int64)
        self.ends = np.cumsum([0, *map(len, of)])
        self.items = np.array([i for own in of for i in own], np.int64)
        self.search = WuManber(list(number))

    def items_of(self, patterns: set[int]) -> set[str]:
        return {self.names[i] for p in patterns for i in self.items[self.ends[p] : self.ends[p + 1]].tolist()}

    def save(self, folder: str, part: int) -> None:
        names = [n.encode() for n in self.names]
        tables = [x.packed() for x in self.search.searches]
        head = [np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)]), self.n_words, self.ends, self.items]
        save(folder, f"windows-{part}", *head, *(a for t in tables for a in t))

    @classmethod
    def load(cls, folder: str, part: int) -> _Windows | None:
        """The part's tables, mapped; None for a part without items."""
        if (arrays := mapped(folder, f"windows-{part}")) is None:
            return None
        look, (names, name_ends) = cls.__new__(cls), arrays[:2]
        look.n_words, look.ends, look.items = arrays[2:5]
        text = names.tobytes()
        look.names = [text[a:b].decode() for a, b in zip(name_ends[:-1].tolist(), name_ends[1:].tolist(), strict=True)]
        step = len(_Search.TABLES) + 1
        look.search = WuManber.of([_Search.unpacked(arrays[k : k + step]) for k in range(5, len(arrays), step)])
        return look


def _build(benchmark: DataFrame, size: int, block_bytes: int) -> tuple[str, int]:
    """Write the tables of all items, dealt over parts of about block_bytes by hash; their folder and number."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, folder = max(1, -(-total // block_bytes)), fresh_uri(benchmark.sparkSession, "benchmark")

    def build(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        _Windows(sorted(zip(group.column("item").to_pylist(), group.column("text").to_pylist(), strict=True)), size).save(folder, part)
        return pa.table([pa.array([group.num_rows], pa.int64())], names=["n"])

    bound_batches(benchmark.sparkSession)
    items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n))).groupBy("part").applyInArrow(build, "n long").agg(F.sum("n")).collect()
    return folder, n


def _scan(batch: pa.RecordBatch, folder: str, parts: int) -> pa.RecordBatch:
    """The columns n_words, hits (word runs as start, end, start, end, ...) and items of a batch."""
    words = [words_of(x) for x in blobs(batch.column("text"))]
    counts = np.array([len(w) for w in words], np.int64)
    data = b"".join(b"\n " + b" ".join(w) + b" " if w else b"\n" for w in words)
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    first = np.concatenate([[0], np.cumsum(np.where(counts > 0, counts + 1, 0))])
    covered: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    items: dict[int, set[str]] = {}
    for part in range(parts):
        if (look := _Windows.load(folder, part)) is None:
            continue
        at, number = look.search.find(data)
        if len(at):
            space = np.searchsorted(spaces, at)
            doc = np.searchsorted(first, space, "right") - 1
            order = np.argsort(doc, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                d = int(doc[own[0]])
                covered.setdefault(d, []).append((space[own] - first[d], look.n_words[number[own]]))
                items.setdefault(d, set()).update(look.items_of(set(number[own].tolist())))
        del look
        release()
    hits: list[list[int]] = [[] for _ in words]
    for d, runs in covered.items():
        start, n = (np.concatenate(x) for x in zip(*runs, strict=True))
        cover = np.zeros(counts[d] + 2, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + n, -1)
        hits[d] = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))).tolist()
    found = [sorted(items.get(d, ())) for d in range(len(words))]
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counts), pa.array(hits, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], names=["row", "n_words", "hits", "items"])


def _searched(docs: DataFrame, benchmark: DataFrame, columns: list[str], size: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, hits, items), row being the given columns."""
    folder, parts = _build(benchmark, size, block_bytes)
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return map_batches(rows, lambda batch: _scan(batch, folder, parts), f"row struct<{fields}>, n_words long, hits array<long>, items array<string>")


def search_items(docs: DataFrame, benchmark: DataFrame, columns: list[str], **options) -> DataFrame:
    """Each row of docs with n_words, hits and items, beside the given columns of docs.

    hits: runs of hit words as start, end, start, end, ...; items: the sorted ids of items with a window that occurs.
    A null or empty text, or one of no words, has no hits; a null item_id or a null item text is no item; rows
    that repeat are each answered; a very long text is searched whole. The benchmark may have any size: each batch is searched for one
    part of block_bytes after the other, without a shuffle of docs, and neither the driver nor a task holds more than a part.
    """
    return _searched(docs, benchmark, columns, **options).select("row.*", "n_words", "hits", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search_items(docs, benchmark, ["doc_id"], **options)
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs."""
    return _searched(docs, benchmark, docs.columns, **options).where(F.size("hits") == 0).select("row.*")

"""Repeated byte strings, by hash-compared suffix sort.

Every string of LENGTH bytes has an anchor: of the ANCHOR-byte strings that start in it, the one of least hash. Equal strings
have equal anchors in the same place, so only strings whose anchors repeat can repeat, and consecutive strings of one anchor
are one stretch. A first pass counts anchors and stretches over all texts. A second keeps the bytes of one of each stretch that
repeats as a whole by its hashes. A third compares every such stretch with those bytes, which decides it; the rest go, with one
copy of the former, to the other stretches of their anchor. There the suffixes are merge-sorted: the common extension of
two is found by binary search over prefix polynomial hashes, and neighbours that agree over LENGTH bytes are compared byte
by byte. So hashes alone decide nothing: where they clash, bytes do.
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

from .arrays import by_shard, looked_up, mapped, narrow, opened, packed, release, save, save_bytes, shard_count, unpacked
from .common import blobs, bound_batches, discard, documents, fresh_uri, map_batches, written

LENGTH = 200
#: Bytes of an anchor; SPAN of them start in a string.
ANCHOR = 100
SPAN = LENGTH - ANCHOR + 1
#: Bytes of text that are hashed at a time; longer texts are cut into parts that overlap by LENGTH - 1.
PART = 1 << 19
#: Bytes of text for each shard of counts.
SHARD_BYTES = 16 << 20
#: Stretches of one anchor that one task sorts; where there are more, Spark counts their strings instead.
GROUP = 20_000
#: Stretches that a task holds before it sends their counts.
TASK_STRETCHES = 500_000
#: Bytes of stretches that are sorted at a time.
SORTED_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(200).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Prefix polynomial hashes of a buffer: the hash of any stretch in constant time."""

    powers = inverses = np.zeros(0, np.uint64)

    def __init__(self, buffer: np.ndarray):
        n = len(buffer) + 1
        if len(Hashes.powers) < n:
            Hashes.powers, Hashes.inverses = _powers(_BASE, n + n // 8), _powers(pow(_BASE, -1, 1 << 64), n + n // 8)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(_BYTES[buffer] * Hashes.powers[: n - 1], out=self.prefix[1:])

    def of(self, start, length):
        return (self.prefix[start + length] - self.prefix[start]) * Hashes.inverses[start]

    def all(self, length: int) -> np.ndarray:
        n = max(0, len(self.prefix) - length)
        return (self.prefix[length:] - self.prefix[:n]) * Hashes.inverses[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """For each start, the place of the leftmost least value among span values from there."""
    low, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < span:
        step = min(size, span - size)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        size += step
    return at


class Stretches(NamedTuple):
    """Of the texts of a batch: each run of string starts that share an anchor."""

    text: np.ndarray  # number of the text
    start: np.ndarray  # of the first string, in the text
    n: np.ndarray  # strings
    left: np.ndarray  # bytes from the first string's start to the anchor
    anchor: np.ndarray
    whole: np.ndarray  # hash of all bytes and of left


def _stretches(texts: list[bytes], bits: int = 64) -> Stretches:
    """bits: of hashes that are kept; fewer make them clash."""
    cut = np.uint64(64 - bits)
    found: list[list[np.ndarray]] = [[] for _ in Stretches._fields]
    parts: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not parts:
            return
        buffer = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in parts])
        number = np.repeat(np.arange(len(parts)), [len(p) for _, _, p in parts])
        hashes = Hashes(buffer)
        anchors = _mixed(hashes.all(ANCHOR)) >> cut << cut
        at = _least(anchors, SPAN)
        start = np.flatnonzero(np.arange(len(at)) + LENGTH <= ends[number[: len(at)]])
        at, own = at[start], number[start]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
        n, begin, at, own = np.diff(np.concatenate([first, [len(start)]])), start[first], at[first], own[first]
        left = at - begin
        whole = _mixed(hashes.of(begin, n + LENGTH - 1) + left.astype(np.uint64) * np.uint64(_BASE)) >> cut << cut
        text, offset = np.array([t for t, _, _ in parts]), np.array([o for _, o, _ in parts])
        shift = offset - (ends - [len(p) for _, _, p in parts])
        for column, value in zip(found, (text[own], begin + shift[own], n, left, anchors[at], whole), strict=True):
            column.append(value)
        parts.clear()

    held = 0
    for t, data in enumerate(texts):
        for offset in range(0, max(1, len(data) - LENGTH + 1), PART):
            part = data[offset : offset + PART + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            parts.append((t, offset, part))
            held += len(part)
            if held >= PART:
                flush()
                held = 0
    flush()
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return Stretches(*(np.concatenate([np.zeros(0, k), *c]).astype(k) for c, k in zip(found, kinds, strict=True)))


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[len(key) > 0], key[1:] != key[:-1]])[: len(key)])
    return (key[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def _paired(whole: np.ndarray, anchor: np.ndarray, n: np.ndarray, task: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, the sums of n and the least task: a stretch is known by both hashes until its bytes are compared."""
    order = np.lexsort((anchor, whole))
    whole, anchor = whole[order], anchor[order]
    first = np.flatnonzero(np.concatenate([[len(whole) > 0], (whole[1:] != whole[:-1]) | (anchor[1:] != anchor[:-1])])[: len(whole)])
    return whole[first], anchor[first], np.add.reduceat(n[order], first) if len(first) else n, np.minimum.reduceat(task[order], first) if len(first) else task


def _shards(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _count(docs: DataFrame, folder: str, shards: int, bits: int) -> None:
    """Write, by shard, the stretches found twice or more, with the least number of a task that found them, and the anchors found twice or more with the number of stretches to sort with theirs."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Stretches] = []

        def sent() -> pa.RecordBatch:
            anchor, whole = (np.concatenate([getattr(x, k) for x in held]) for k in ("anchor", "whole"))
            one, out = np.ones(len(anchor), np.int64), []
            anchors, total = _summed(anchor, one)
            wholes, own, times, _ = _paired(whole, anchor, one, one)
            task = np.full(len(wholes), TaskContext.get().partitionId(), "<u4")
            out += [("anchors", s, packed(a, narrow(n))) for s, (a, n) in by_shard(_shards(anchors, shards), anchors, total)]
            out += [("wholes", s, packed(w, a, narrow(n), t)) for s, (w, a, n, t) in by_shard(_shards(wholes, shards), wholes, own, times, task)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["kind", "shard", "block"])

        for batch in batches:
            if len((found := _stretches(blobs(batch.column("text")), bits)).anchor):
                held.append(found)
            if sum(len(x.anchor) for x in held) > TASK_STRETCHES:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def merged(group: pa.Table) -> pa.Table:
        kind, shard = group.column("kind")[0].as_py(), group.column("shard")[0].as_py()
        parts = [unpacked(b.as_buffer()) for b in group.column("block")]
        if kind == "anchors":
            anchor, total = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
            rows = [("total", shard, packed(anchor[total > 1], total[total > 1]))]
        else:
            whole, anchor, times, task = (np.concatenate([p[k] for p in parts]) for k in range(4))
            whole, anchor, n, task = _paired(whole, anchor, times.astype(np.int64), task.astype(np.int64))
            again = n > 1
            save(folder, f"wholes-{shard}", whole[again], anchor[again].view(np.int64), task[again])
            anchor, done, kinds = _summed(anchor[again], n[again], np.ones(int(again.sum()), np.int64))
            rows = [("done", s, packed(*mine)) for s, mine in by_shard(_shards(anchor, shards), anchor, done, kinds)] or [("done", 0, packed(*[np.zeros(0, np.int64)] * 3))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["kind", "shard", "block"])

    def joined(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [(k.as_py(), unpacked(b.as_buffer())) for k, b in zip(group.column("kind"), group.column("block"), strict=True)]
        keys = np.concatenate([p[0].astype(np.uint64) for _, p in parts])
        left = np.concatenate([p[1] if k == "total" else -p[1] for k, p in parts]).astype(np.int64)
        kinds = np.concatenate([np.zeros(len(p[0]), np.int64) if k == "total" else p[2] for k, p in parts]).astype(np.int64)
        anchor, left, kinds = _summed(keys, left, kinds)
        save(folder, f"anchors-{shard}", anchor, np.where(left > 0, left + kinds, 0), np.ones(len(anchor), np.uint8))
        return pa.table([pa.array([int((left > 0).sum())], pa.int64())], names=["n"])

    bound_batches(docs.sparkSession)
    sent = docs.select("text").mapInArrow(blocks, "kind string, shard long, block binary")
    small = written(sent.groupBy("kind", "shard").applyInArrow(merged, "kind string, shard long, block binary"), "repeat-counts")
    small.groupBy("shard").applyInArrow(joined, "n long").agg(F.sum("n")).collect()
    discard(small)


def _places(whole: np.ndarray, anchor: np.ndarray, shards: int, folder: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(shard, place) of pairs in the sorted arrays of files of a kind; place -1 where they aren't in. Pairs of one whole stand side by side."""
    shard, place = _shards(whole, shards), np.full(len(whole), -1, np.int64)
    order = np.lexsort((whole, shard))
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        if (arrays := mapped(folder, f"{kind}-{shard[part[0]]}")) is None or not len(arrays[0]):
            continue
        at, end = np.searchsorted(arrays[0], whole[part]), np.searchsorted(arrays[0], whole[part], "right")
        own = anchor[part].view(np.int64)
        while (open_ := np.flatnonzero((at < end) & (place[part] < 0))).size:
            same = arrays[1][at[open_]] == own[open_]
            place[part[open_[same]]] = at[open_[same]]
            at[open_] += 1
    return shard, place


def _represent(docs: DataFrame, folder: str, shards: int, bits: int) -> None:
    """Write, by shard, the bytes of one of each stretch found twice or more: the first of the task that its count names.

    Were tasks numbered otherwise in this pass, stretches would lack their bytes and be sorted with the rest.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            texts = blobs(batch.column("text"))
            x = _stretches(texts, bits)
            shard, place = _places(x.whole, x.anchor, shards, folder, "wholes")
            out = []
            hit = np.flatnonzero(place >= 0)
            for s, (mine,) in by_shard(shard[hit], hit):
                of_task = mapped(folder, f"wholes-{s}")[2]
                mine = mine[of_task[place[mine]] == task]
                mine = mine[np.unique(place[mine], return_index=True)[1]]
                if len(mine):
                    data = [texts[t][a : a + n + LENGTH - 1] for t, a, n in zip(x.text[mine].tolist(), x.start[mine].tolist(), x.n[mine].tolist(), strict=True)]
                    out.append((s, packed(x.whole[mine], x.anchor[mine].view(np.int64), np.array([len(d) for d in data], np.int64), np.frombuffer(b"".join(data), np.uint8))))
            release()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["shard", "block"])

    def merged(group: pa.Table) -> pa.Table:
        parts = [unpacked(b.as_buffer()) for b in group.column("block")]
        whole, anchor, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
        data, begin = np.concatenate([p[3] for p in parts]), np.cumsum(size) - size
        order = np.lexsort((anchor, whole))
        whole, anchor = whole[order], anchor[order]
        first = np.concatenate([[True], (whole[1:] != whole[:-1]) | (anchor[1:] != anchor[:-1])])
        order = order[first]
        save(folder, f"bytes-{group.column('shard')[0].as_py()}", whole[first], anchor[first], begin[order], size[order])
        save_bytes(folder, f"data-{group.column('shard')[0].as_py()}", data)
        return pa.table([pa.array([len(order)], pa.int64())], names=["n"])

    docs.select("text").mapInArrow(blocks, "shard long, block binary").groupBy("shard").applyInArrow(merged, "n long").agg(F.sum("n")).collect()


def _runs(start: np.ndarray, n: np.ndarray) -> list[int]:
    """Bytes that strings from start on cover, n of them each, as sorted disjoint start, end, start, end, ..."""
    order = np.argsort(start, kind="stable")
    begin, end = start[order], (start + n + LENGTH - 1)[order]
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(begin[1:] > reach[:-1]) + 1
    return np.stack([begin[np.concatenate([[0], cut])], reach[np.concatenate([cut - 1, [len(reach) - 1]])]], axis=1).ravel().tolist()


def without(data: bytes, spans: list[int]) -> bytes:
    """data less the bytes of spans."""
    edges = [0, *spans, len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


ROWS = (
    "kind string, row long, doc_id long, n_bytes long, spans array<long>, kept binary, kept_sha256 string, "
    "text binary, start long, n long, anchor long, left int, whole long, bytes binary"
)
_ROW_TYPES = [pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.binary(), pa.string(), pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()]
_ROW_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _same(texts: list[bytes], x: Stretches, shards: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Of the stretches: whether their bytes are those kept for their hashes, and whether they are others."""
    same, other = np.zeros(len(x.whole), bool), np.zeros(len(x.whole), bool)
    shard, place = _places(x.whole, x.anchor, shards, folder, "bytes")
    hit = np.flatnonzero(place >= 0)
    for s, (mine,) in by_shard(shard[hit], hit):
        _, _, begin, size = mapped(folder, f"bytes-{s}")
        mine = mine[np.argsort(begin[place[mine]], kind="stable")]
        at, last, kept = place[mine], -1, b""
        with opened(folder, f"data-{s}") as data:
            for k, t, a, n, b, length in zip(mine.tolist(), x.text[mine].tolist(), x.start[mine].tolist(), x.n[mine].tolist(), begin[at].tolist(), size[at].tolist(), strict=True):
                if b != last:
                    last, kept = b, data.read_at(length, b)
                equal = texts[t][a : a + n + LENGTH - 1] == kept
                same[k], other[k] = equal, not equal
    return same, other


def _judge(docs: DataFrame, folder: str, shards: int, group: int, with_kept: bool, bits: int, clashed: bool = False) -> DataFrame:
    """Rows of kind done, with the result, open, with the text and the spans so far, stretch, to be sorted, hot, to be counted, and clash.

    A clash names hashes that two different stretches have; then the pass is made again, with these not settled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sent = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            texts, ids = blobs(batch.column("text")), batch.column("doc_id").to_pylist()
            x = _stretches(texts, bits)
            to_sort, again = looked_up(x.anchor, _shards(x.anchor, shards), lambda s: mapped(folder, f"anchors-{s}"), 2)
            same, other = _same(texts, x, shards, folder)
            settled = same
            if clashed:  # anchors of clashing stretches were counted as if all theirs were settled
                settled = same & (_places(x.whole, x.anchor, shards, folder, "clashes")[1] < 0)
                to_sort = np.maximum(to_sort, looked_up(x.anchor, _shards(x.anchor, shards), lambda s: mapped(folder, f"clashed-{s}"), 1)[0])
            left_over = (again > 0) & ~settled
            out: list[tuple] = [("clash", *[None] * 9, int(x.anchor[k : k + 1].view(np.int64)[0]), None, int(x.whole[k : k + 1].view(np.int64)[0]), None) for k in (() if clashed else np.flatnonzero(other))]
            bounds = np.searchsorted(x.text, np.arange(len(texts) + 1))
            for t, data in enumerate(texts):
                own = np.arange(bounds[t], bounds[t + 1])
                mine = own[settled[own]]
                spans = _runs(x.start[mine], x.n[mine])
                if left_over[own].any():
                    out.append(("open", row + t, ids[t], len(data), spans, None, None, data, *[None] * 6))
                else:
                    kept = without(data, spans)
                    out.append(("done", row + t, ids[t], len(data), spans, kept if with_kept else None, hashlib.sha256(kept).hexdigest(), *[None] * 7))
            anchor, whole = x.anchor.view(np.int64), x.whole.view(np.int64)
            for k in np.flatnonzero(left_over | (settled & (to_sort > 0))).tolist():
                if settled[k]:
                    if (key := (int(whole[k]), int(anchor[k]))) in sent:
                        continue
                    sent.add(key)
                number = row + int(x.text[k]) if left_over[k] else None
                a, n = int(x.start[k]), int(x.n[k])
                data = texts[x.text[k]][a : a + n + LENGTH - 1]
                out.append(("stretch" if 0 < to_sort[k] <= group else "hot", number, *[None] * 6, a, n, anchor[k], int(x.left[k]), whole[k], data))
            row += len(texts)
            release()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ROW_TYPES, strict=True)], names=_ROW_NAMES)

    bound_batches(docs.sparkSession)
    rows = written(docs.mapInArrow(run, ROWS), "repeat-rows")
    clashes = rows.where("kind = 'clash'").select("anchor", "whole").distinct()
    if clashed or clashes.isEmpty():
        return rows

    def kept(kind: str, column: str):
        def one(table: pa.Table) -> pa.Table:
            value, anchor = (table.column(k).to_numpy().view(np.uint64) for k in (column, "anchor"))
            order = np.lexsort((anchor, value))
            second = anchor[order].view(np.int64) if kind == "clashes" else table.column("n").to_numpy()[order]
            save(folder, f"{kind}-{table.column('shard')[0].as_py()}", value[order], second)
            return pa.table([pa.array([len(order)], pa.int64())], names=["n"])

        return one

    shard = F.udf(lambda k: int(_shards(np.array([k], np.int64).view(np.uint64), shards)[0]), "long")
    clashes = written(clashes, "clashes")
    clashes.withColumn("shard", shard("whole")).groupBy("shard").applyInArrow(kept("clashes", "whole"), "n long").collect()
    of_anchor = rows.where("kind <> 'done' AND kind <> 'open'").select("anchor").unionByName(clashes.select("anchor")).groupBy("anchor").agg((F.count("*") + 1).alias("n"))
    of_anchor = of_anchor.join(clashes.select("anchor").distinct(), "anchor", "left_semi").withColumn("shard", shard("anchor"))
    of_anchor.groupBy("shard").applyInArrow(kept("clashed", "anchor"), "n long").collect()
    discard(rows)
    return _judge(docs, folder, shards, group, with_kept, bits, clashed=True)


def _compared(hashes: Hashes, buffer: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the strings at p come before, equal or come after those at q."""
    low, high = np.zeros(len(p), np.int64), np.full(len(p), LENGTH)
    low[hashes.of(p, LENGTH) == hashes.of(q, LENGTH)] = LENGTH
    open_ = np.flatnonzero(low < LENGTH)
    high[open_] = LENGTH - 1
    while len(open_):  # the longest common extension lies from low to high
        middle = (low[open_] + high[open_] + 1) // 2
        same = hashes.of(p[open_], middle) == hashes.of(q[open_], middle)
        low[open_] = np.where(same, middle, low[open_])
        high[open_] = np.where(same, high[open_], middle - 1)
        open_ = open_[low[open_] < high[open_]]
    out = np.zeros(len(p), np.int8)
    differ = low < LENGTH
    a, b = buffer[p[differ] + low[differ]], buffer[q[differ] + low[differ]]
    out[differ] = np.where(a < b, -1, np.where(a > b, 1, 0))
    return out


def sort_suffixes(hashes: Hashes, buffer: np.ndarray, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places at, sorted within each of the groups that begin and size give, by bottom-up mergesort of all groups at once.

    An item's place in the merged run is its own in its run and the number of items of the other run before it.
    """
    at, width = at.copy(), 1
    while width < size.max(initial=0):
        groups = np.flatnonzero(size > width)
        g = np.repeat(begin[groups], size[groups])
        item = np.arange(len(g)) - np.repeat(np.cumsum(size[groups]) - size[groups], size[groups])
        run = item // width
        other = (run ^ 1) * width
        low, high = np.zeros(len(g), np.int64), np.clip(np.repeat(size[groups], size[groups]) - other, 0, width)
        value, later = at[g + item], run % 2
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) // 2
            sign = _compared(hashes, buffer, value[active], at[g[active] + other[active] + middle])
            after = sign + later[active] > 0
            low[active] = np.where(after, middle + 1, low[active])
            high[active] = np.where(after, high[active], middle)
            active = active[low[active] < high[active]]
        at[g + (run & ~1) * width + item % width + low] = value
        width *= 2
    return at


def _twins(hashes: Hashes, buffer: np.ndarray, given: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of places of equal strings, of given places, sorted to place, whose groups begin at first. Every string with an equal is in one of them.

    Equal strings are neighbours unless hashes clash; where some do, the strings of their groups are sorted by their bytes instead. Comparisons
    that clashes make inconsistent can also have two strings merged to one place, which shows as a place that is missing.
    """
    width, own = np.arange(LENGTH), hashes.of(place, LENGTH)
    begins = np.zeros(len(place), bool)
    begins[first] = True
    near = np.flatnonzero(~begins[1:] & (own[1:] == own[:-1])) + 1
    equal = np.concatenate([np.zeros(0, bool), *((buffer[place[part, None] + width] == buffer[place[part - 1, None] + width]).all(axis=1) for part in np.array_split(near, len(near) // 8192 + 1))])
    group = np.cumsum(begins) - 1
    runs = np.flatnonzero(begins | np.concatenate([[True], own[1:] != own[:-1]]))
    order = np.lexsort((own[runs], group[runs]))
    parted = (group[runs[order]][1:] == group[runs[order]][:-1]) & (own[runs[order]][1:] == own[runs[order]][:-1])
    missing = np.sort(place + group * len(buffer)) != np.sort(given + group * len(buffer))
    clashing = np.unique(np.concatenate([group[near[~equal]], group[runs[order]][1:][parted], group[missing]]))
    near = near[equal]
    near = near[~np.isin(group[near], clashing)]
    one, other = [place[near]], [place[near - 1]]
    for g in clashing.tolist():
        mine = np.flatnonzero(group == g)
        strings = [buffer[p : p + LENGTH].tobytes() for p in given[mine].tolist()]
        by_bytes = sorted(range(len(mine)), key=strings.__getitem__)
        pairs = [(a, b) for a, b in zip(by_bytes, by_bytes[1:], strict=False) if strings[a] == strings[b]]
        one.append(given[mine[[a for a, _ in pairs]]] if pairs else given[:0])
        other.append(given[mine[[b for _, b in pairs]]] if pairs else given[:0])
    return np.concatenate(one), np.concatenate(other)


def _sorted_out(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(row, start, n) of strings that are in two stretches or more, of whole groups of (row, start, n, anchor, left, bytes)."""
    buffer = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    hashes = Hashes(buffer)
    n = np.array([r[2] for r in rows], np.int64)
    offset = np.cumsum([0, *(len(r[5]) for r in rows)])[:-1]
    anchor = np.unique(np.array([r[3] for r in rows], np.int64), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(rows)), n)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    group = anchor[owner] * SPAN + (np.array([r[4] for r in rows], np.int64)[owner] - j)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    size = np.diff(np.concatenate([first, [len(order)]]))
    at = offset[owner] + j
    string_at = np.zeros(len(buffer), np.int64)
    string_at[at] = np.arange(len(at))
    place = sort_suffixes(hashes, buffer, at[order], first, size)
    again = np.zeros(len(at), bool)
    for a, b in zip(*_twins(hashes, buffer, at[order], place, first), strict=True):
        again[string_at[a]] = again[string_at[b]] = True
    out = []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])) | np.concatenate([np.isin(np.arange(len(at)), np.cumsum(n)[:-1]), [False]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if again[a] and rows[owner[a]][0] is not None:
            out.append((rows[owner[a]][0], rows[owner[a]][1] + int(j[a]), int(b - a)))
    return out


def _sort_stretches(stretches: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def found(rows: list[tuple]) -> pa.RecordBatch:
            out = _sorted_out(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["row", "start", "n"])

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in ("row", "start", "n", "anchor", "left", "bytes")), strict=True):
                if size >= SORTED_BYTES and held[-1][3] != r[3]:
                    yield found(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield found(held)

    bound_batches(stretches.sparkSession)
    once = stretches.where("row IS NULL").dropDuplicates(["anchor", "whole"]).unionByName(stretches.where("row IS NOT NULL"))
    dealt = once.select("row", "start", "n", "anchor", "left", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "row long, start long, n long")


def _count_strings(hot: DataFrame) -> DataFrame:
    """For anchors of very many stretches: strings that are there twice, without any group in one place. Only strings whose hash repeats are compared."""
    once = hot.where("row IS NULL").dropDuplicates(["anchor", "whole"]).unionByName(hot.where("row IS NOT NULL"))
    once = written(once.select("row", "start", "n", "bytes", F.monotonically_increasing_id().alias("id")), "hot-stretches")
    string = F.substring("bytes", F.col("j") + 1, F.lit(LENGTH))
    strings = once.select("row", "start", "id", "bytes", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("j")).select("row", "start", "id", "j", F.xxhash64(string).alias("hash"))
    likely = strings.groupBy(F.col("hash").alias("of")).agg(F.count("*").alias("times")).where("times > 1").select("of")
    likely = strings.join(likely, F.col("hash") == F.col("of")).select("row", "start", "id", "j").join(once.select(F.col("id").alias("of"), "bytes"), F.col("id") == F.col("of"))
    likely = written(likely.select("row", "start", "j", string.alias("string")), "hot-strings")
    again = likely.groupBy(F.col("string").alias("of")).agg(F.count("*").alias("times")).where("times > 1")
    return likely.where("row IS NOT NULL").join(again, F.col("string") == F.col("of")).select("row", (F.col("start") + F.col("j")).alias("start"), F.lit(1).cast("long").alias("n"))


def repeats(docs: DataFrame, group: int = GROUP, shard_bytes: int = SHARD_BYTES, with_kept: bool = True, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, spans, kept and kept_sha256 for each row of docs.

    spans: bytes covered by a LENGTH-byte string that starts elsewhere too, as sorted disjoint start, end, start, end, ...
    kept: the other bytes (null unless with_kept). A null text is empty, with no spans. Rows that repeat are each
    answered, and are copies of each other. Strings never cross texts. A very long text is hashed in parts that overlap, so nothing of it is lost.
    group: stretches of one anchor that a task sorts; beyond, their strings are counted. hash_bits: fewer than 64 make hashes clash, for tests.
    """
    docs, folder = documents(docs), fresh_uri(docs.sparkSession, "repeats")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shard_count(total, shard_bytes)
    _count(docs, folder, shards, hash_bits)
    _represent(docs, folder, shards, hash_bits)
    rows = _judge(docs, folder, shards, group, with_kept, hash_bits)
    found, hot = _sort_stretches(rows.where("kind = 'stretch'")), rows.where("kind = 'hot'")
    if not hot.isEmpty():
        found = found.unionByName(_count_strings(hot))
    more = found.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("more"))
    result = ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"]
    opened = rows.where("kind = 'open'").select("row", "doc_id", "n_bytes", "spans", "text").join(more, "row", "left").drop("row")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, n_bytes, spans, text, extra in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_bytes", "spans", "text", "more")), strict=True):
            start = np.array([*spans[::2], *(x["start"] for x in extra or ())], np.int64)
            n = np.array([*(b - a - LENGTH + 1 for a, b in zip(spans[::2], spans[1::2], strict=True)), *(x["n"] for x in extra or ())], np.int64)
            spans = _runs(start, n)
            kept = without(text, spans)
            out.append((doc_id, n_bytes, spans, kept if with_kept else None, hashlib.sha256(kept).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string()), strict=True)], names=result)

    finished = map_batches(opened, finish, "doc_id long, n_bytes long, spans array<long>, kept binary, kept_sha256 string")
    return rows.where("kind = 'done'").select(*result).unionByName(finished)

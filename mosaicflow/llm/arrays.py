"""Sorted hash arrays in files of the shared folder, mapped into memory by workers."""

from __future__ import annotations

import mmap
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import repeat

import numpy as np

from .common import filesystem


#: Files that a worker keeps mapped, and bytes of files that it keeps read where a store can't be mapped.
MOST_MAPPED, MOST_READ = 4096, 256 << 20
#: Files of one kind in one folder.
FOLDER_FILES = 1000


def shard_count(total: int, each: int) -> int:
    """Shards for so much in all, of each so much."""
    return max(1, -(-total // each))


def by_shard(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, its part of each array, in order), by one sort: time doesn't grow with the number of shards."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    arrays = [a[order] for a in arrays]
    for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=False):
        yield int(shard[begin]), [a[begin:end] for a in arrays]


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the least of 1, 2, 4 or 8 bytes that hold the largest of them."""
    most = int(counts.max(initial=0))
    return counts.astype(next(f"<u{n}" for n in (1, 2, 4, 8) if most >> 8 * n == 0))


def _place(path: str, name: str) -> str:
    """Where an array file is: numbered ones lie FOLDER_FILES to a folder."""
    kind, _, number = name.rpartition("-")
    return f"{path}/{kind}/{int(number) // FOLDER_FILES}/{number}" if kind and number.isdigit() else f"{path}/{name}"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each from a multiple of 8 on: searching a mapped array that isn't aligned would copy it."""
    return b"".join([np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes(), *(a.dtype.str.encode().ljust(8) for a in arrays), *(x for a in arrays for x in (a.tobytes(), bytes(-a.nbytes % 8)))])


def unpacked(data) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    lengths, at, out = np.frombuffer(data, "<i8", n, 8), 8 + 16 * n, []
    for k, length in enumerate(lengths):
        kind = np.dtype(bytes(data[8 + 8 * n + 8 * k : 16 + 8 * n + 8 * k]).decode().strip())
        out.append(np.frombuffer(data, kind, length, at))
        at += -(-int(length) * kind.itemsize // 8) * 8
    return out


def save_bytes(folder: str, name: str, data) -> None:
    """Under a name of the task's own, then moved: a task that runs again puts the same in its place."""
    files, path = filesystem(folder)
    place = _place(path, name)
    files.create_dir(place.rpartition("/")[0], recursive=True)
    with files.open_output_stream(mine := f"{place}.{uuid.uuid4().hex}", compression=None) as out:
        out.write(data)
    files.move(mine, place)


def save(folder: str, name: str, *arrays: np.ndarray) -> None:
    save_bytes(folder, name, packed(*arrays))


def opened(folder: str, name: str):
    """A file of save_bytes() for reading at places; nothing of it stays in memory."""
    files, path = filesystem(folder)
    return files.open_input_file(_place(path, name))


#: Arrays by file, last used last: (arrays, map or None, bytes read).
_kept: OrderedDict[tuple[str, str], tuple[list[np.ndarray] | None, mmap.mmap | None, int]] = OrderedDict()


def mapped(folder: str, name: str) -> list[np.ndarray] | None:
    """Arrays of a file, None if it isn't there: mapped into memory from a folder that all machines mount, read from any other store."""
    if (key := (folder, name)) in _kept:
        _kept.move_to_end(key)
        return _kept[key][0]
    from pyarrow import fs

    files, path = filesystem(folder)
    place = _place(path, name)
    if files.get_file_info(place).type == fs.FileType.NotFound:
        _kept[key] = (None, None, 0)
    elif isinstance(files, fs.LocalFileSystem):
        with open(place, "rb") as source:
            memory = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ)
        _kept[key] = (unpacked(memory), memory, 0)
    else:
        with files.open_input_file(place) as source:
            data = source.read()
        _kept[key] = (unpacked(data), None, len(data))
    while len(_kept) > 1 and (len(_kept) > MOST_MAPPED or sum(n for *_, n in _kept.values()) > MOST_READ):
        _kept.popitem(last=False)
    return _kept[key][0]


def release() -> None:
    """Give back the memory of mapped pages; they are read again when they are next used."""
    for _, memory, _ in _kept.values():
        if memory is not None:
            memory.madvise(mmap.MADV_DONTNEED)


def looked_up(needles: np.ndarray, shard: np.ndarray, open_shard, width: int) -> np.ndarray:
    """Values (width, needles) beside each needle in the sorted first array of its shard's arrays; 0 where it isn't."""
    out = np.zeros((width, len(needles)), np.int64)
    order = np.lexsort((needles, shard))
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        keys, *values = open_shard(int(shard[part[0]])) or (np.zeros(0, np.uint64), *repeat(np.zeros(0), width))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, needles[part]), len(keys) - 1)
            same = keys[at] == needles[part]
            for k in range(width):
                out[k, part[same]] = values[k][at[same]]
    return out

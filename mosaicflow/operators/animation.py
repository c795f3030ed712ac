"""One palette for all frames of an animation, and its GIF encoding."""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

#: Colour of what is transparent; not the chroma key.
TRANSPARENT = (255, 0, 254)
OPAQUE_FROM = 128


def hard_mask(alpha: np.ndarray) -> np.ndarray:
    return alpha >= OPAQUE_FROM


def opaque(frames: np.ndarray) -> np.ndarray:
    """Frames in RGB, with TRANSPARENT where they aren't opaque."""
    return np.where(hard_mask(frames[..., 3:]), frames[..., :3], np.array(TRANSPARENT, np.uint8))


def indexed(rgb: np.ndarray, colours: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """quantise() of each of a stack of pictures: (n, height, width) indexes and (n, 256, 3) palettes."""
    n, height, width = rgb.shape[:3]
    flat = rgb.reshape(n, height * width, 3).astype(np.int64)
    code = (flat[..., 0] << 16 | flat[..., 1] << 8 | flat[..., 2] | np.arange(n)[:, None] << 24).ravel()
    # Of runs of one colour only the first pixels are sorted.
    runs = np.flatnonzero(np.diff(code, prepend=-1))
    found, back = np.unique(code[runs], return_inverse=True)
    start = np.searchsorted(found, np.arange(n + 1) << 24)
    owner = found >> 24
    few = np.diff(start) <= colours
    own = few[owner]
    palettes = np.zeros((n, 256, 3), np.uint8)
    place = np.arange(len(found)) - start[owner]
    palettes[owner[own], place[own]] = np.stack([found >> 16 & 255, found >> 8 & 255, found & 255], axis=1)[own]
    index = np.repeat(place[back].astype(np.uint8), np.diff(runs, append=len(code))).reshape(n, height, width)
    for i in np.flatnonzero(~few):
        index[i], palettes[i] = quantise(rgb[i], colours)
    return index, palettes


def quantise(rgb: np.ndarray, colours: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, palette) by median cut over distinct colours, without dithering; exact where there are no more than colours."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    code, back, count = np.unique(flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2], return_inverse=True, return_counts=True)
    points = np.stack([code >> 16, code >> 8 & 255, code & 255], axis=1)

    if len(points) <= colours:
        palette = np.zeros((256, 3), np.uint8)
        palette[: len(points)] = points
        return back.astype(np.uint8).reshape(rgb.shape[:2]), palette
    ages = itertools.count(1)

    def ranked(box: np.ndarray, age: int) -> tuple[int, int, np.ndarray, int]:
        own = points[box]
        spread = own.max(axis=0) - own.min(axis=0)
        return (-int(spread.max() * count[box].sum()) if len(box) > 1 else 1, age, box, int(np.argmax(spread)))

    heap = [ranked(np.arange(len(points)), 0)]
    while len(heap) < min(colours, len(points)):
        _, _, box, axis = heapq.heappop(heap)
        box = box[np.argsort(points[box, axis], kind="stable")]
        total = np.cumsum(count[box])
        cut = int(np.clip(np.searchsorted(total, total[-1] / 2) + 1, 1, len(box) - 1))
        for part in (box[:cut], box[cut:]):
            heapq.heappush(heap, ranked(part, next(ages)))
    boxes = [box for _, _, box, _ in sorted(heap, key=lambda x: x[1])]
    number, palette = np.zeros(len(points), np.uint8), np.zeros((256, 3), np.uint8)
    for i, b in enumerate(boxes):
        number[b] = i
        palette[i] = np.round(np.average(points[b], axis=0, weights=count[b]))
    return number[back].reshape(rgb.shape[:2]), palette


def nearest(palettes: np.ndarray, colour=TRANSPARENT) -> np.ndarray:
    """Of each palette the first entry that is the colour, or else the first of those nearest to it."""
    return ((palettes.astype(np.int64) - colour) ** 2).sum(axis=-1).argmin(axis=-1)


def key_first(index: np.ndarray, palettes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same picture, or each of a stack of them, with the transparent colour's entry at 0."""
    found = palettes.reshape(-1, *palettes.shape[-2:]).copy()
    n, key = np.arange(len(found)), nearest(found)
    found[n, 0], found[n, key] = found[n, key], found[n, 0]
    at = key.astype(np.uint8).reshape(*palettes.shape[:-2], 1, 1)
    return np.where(index == at, 0, np.where(index == 0, at, index)), found.reshape(palettes.shape)


#: Of GIF's codes after one that clears the table: the widths until the table is full and cleared again.
_WIDTHS = np.array([9 if k <= 512 else 10 if k <= 1024 else 11 if k <= 2048 else 12 for k in range(258, 4096)] + [12], np.uint8)


def _codes(index: bytes) -> list[int]:
    """GIF's codes of 8-bit pixels, the first of which clears the table and the last of which stops."""
    #: By the code of a word, times 256, and the byte after it.
    codes: dict[int, int] = {}
    out, number = [256], 258
    if not index:
        return [256, 257]
    word = index[0]
    for byte in index[1:]:
        key = word << 8 | byte
        if key in codes:
            word = codes[key]
            continue
        out.append(word)
        codes[key] = number
        if number == 4095:
            out.append(256)
            codes, number = {}, 257
        number += 1
        word = byte
    out += (word, 257)
    return out


#: Words that a table has room for, bytes of the tables of pictures whose codes are found at once, and the fewest pictures for which that pays.
_ROOM, TABLE_BYTES, _LEAST = 4096 - 258, 48 << 20, 16


def codes_of(pictures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_codes() of each of (n, pixels), one after another, and how many each has."""
    n, size = pictures.shape
    colours = int(pictures.max(initial=0)) + 1
    at_once = TABLE_BYTES // (2 * colours * (colours + min(size, _ROOM)))
    if not size or min(n, at_once) < _LEAST:
        found = [_codes(x.tobytes()) for x in pictures]
        return np.array([c for own in found for c in own], np.uint16), np.array([len(own) for own in found], np.int64)
    found = [_codes_in_step(pictures[k : k + at_once], colours) for k in range(0, n, at_once)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _codes_in_step(pictures: np.ndarray, colours: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, pixel by pixel for all pictures. Words are rows of each picture's table: colours, then those of more pixels; the entry of a word and a colour is the row of both, or 0."""
    n, size = pictures.shape
    rows = colours + min(size, _ROOM)
    table = np.zeros((n, rows * colours), np.uint16)
    entries = table.reshape(-1)
    pixels = np.ascontiguousarray(pictures.T).astype(np.int64)
    starts = pixels + np.arange(n) * (rows * colours)
    words, ends, cleared = np.empty((size, n), np.uint16), np.ones((size, n), bool), np.zeros((size, n), bool)
    free, word, key = np.full(n, colours), pixels[0].copy(), np.empty(n, np.int64)
    for i in range(1, size):
        np.multiply(word, colours, out=key)
        key += starts[i]
        longer = entries.take(key)
        new = longer == 0
        words[i - 1], ends[i - 1] = word, new
        np.copyto(longer, free, where=new, casting="unsafe")
        entries[key] = longer
        free += new
        np.copyto(word, longer)
        np.copyto(word, pixels[i], where=new)
        if i >= _ROOM and (full := free == colours + _ROOM).any():
            cleared[i - 1], table[full], free[full] = full, 0, colours
    words[-1] = word
    codes = np.empty((n, size + 2), np.uint16)
    codes[:, 0], codes[:, -1] = 256, 257
    codes[:, 1:-1] = np.where(words < colours, words, words + np.uint16(258 - colours)).T
    times = np.ones((n, size + 2), np.uint8)
    times[:, 1:-1] = (ends + cleared.astype(np.uint8)).T
    out = np.repeat(codes.ravel(), times.ravel())
    # A code that fills the table is followed by one that clears it.
    out[np.cumsum(times, dtype=np.int64)[times.ravel() == 2] - 1] = 256
    return out, times.sum(axis=1, dtype=np.int64)


def _packed(codes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of each picture's codes, which are put into bits of all at once."""
    end = np.cumsum(counts)
    start = end - counts
    width = _WIDTHS[(np.arange(len(codes)) - np.repeat(start, counts) - 1) % len(_WIDTHS)]
    width[start] = 9
    width[end - 1] = width[end - 2]
    bits = np.add.reduceat(width, start, dtype=np.int64)
    codes, width = np.insert(codes, end, 0), np.insert(width, end, (-bits % 8).astype(np.uint8))
    places = np.arange(12, dtype=np.uint16)
    data = np.packbits((codes[:, None] >> places & 1).astype(np.uint8)[places < width[:, None]], bitorder="little").tobytes()
    ends = np.cumsum(-(-bits // 8)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _lzw(index: bytes) -> bytes:
    """GIF's variable-length codes of 8-bit pixels."""
    return _packed(*codes_of(np.frombuffer(index, np.uint8)[None]))[0]


def gif(frames: list[np.ndarray], duration: int = 200) -> bytes:
    """An endless animation, duration milliseconds a frame, each cleared before the next."""
    if not len(frames):
        raise ValueError("an animation needs frames")
    return gifs(np.stack(frames)[None], duration)[0]


def gifs(stack: np.ndarray, duration: int = 200) -> list[bytes]:
    """The animations of a stack of them, (n, frames, height, width, 4)."""
    n, count, height, width = stack.shape[:4]
    index, palettes = indexed(opaque(stack).reshape(n, count * height, width, 3))
    index, palettes = key_first(index, palettes)
    data = _packed(*codes_of(index.reshape(n * count, height * width)))
    start = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0)
    after = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    each = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2 | 1, duration // 10, 0, 0) + struct.pack("<BHHHHBB", 0x2C, 0, 0, width, height, 0, 8)
    out = []
    for i in range(n):
        parts = [start, palettes[i].tobytes(), after]
        for own in data[i * count : (i + 1) * count]:
            parts.append(each)
            parts += [bytes([len(part)]) + part for part in (own[k : k + 255] for k in range(0, len(own), 255))]
            parts.append(b"\x00")
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def read_gif(data: bytes) -> tuple[list[np.ndarray], int]:
    """Frames of a GIF as gif() writes them, in RGBA, and their duration in milliseconds."""
    return next(read_gifs([data]))


class _Parsed(NamedTuple):
    width: int
    height: int
    duration: int
    palette: np.ndarray
    bodies: list[bytes]


def _parsed(data: bytes) -> _Parsed:
    width, height = struct.unpack_from("<HH", data, 6)
    at, duration, found = 13 + 768, 0, []
    palette = np.full((256, 4), 255, np.uint8)
    palette[:, :3] = np.frombuffer(data, np.uint8, 768, 13).reshape(256, 3)
    palette[0, 3] = 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                duration = struct.unpack_from("<H", data, at + 4)[0] * 10
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        at += 11
        body = bytearray()
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        found.append(bytes(body))
    return _Parsed(width, height, duration, palette, found)


#: Pixels of the animations that are decoded at once.
READ_PIXELS = 1 << 18


def read_gifs(files: Iterable[bytes]) -> Iterator[tuple[list[np.ndarray], int]]:
    """read_gif() of each, decoded by groups of bounded size."""
    held, pixels = [], 0
    for data in itertools.chain(files, [None]):
        if data is not None:
            held.append(_parsed(data))
            pixels += held[-1].width * held[-1].height * len(held[-1].bodies)
        if held and (data is None or pixels >= READ_PIXELS):
            words = iter(unlzw_all([body for own in held for body in own.bodies]))
            for own in held:
                shown = b"".join(next(words)[: own.width * own.height] for _ in own.bodies)
                yield list(own.palette[np.frombuffer(shown, np.uint8)].reshape(len(own.bodies), own.height, own.width, 4)), own.duration
            held, pixels = [], 0


#: Where each code after one that clears the table ends, the clearing one included, and its bits.
_READ = np.array([9, *_WIDTHS[:-1]], np.int64)
_ENDS = np.cumsum(_READ)


def unlzw_all(bodies: list[bytes]) -> list[bytes]:
    """_unlzw() of each. All whose codes are of one table, that is cleared first and never full, are decoded at once: a word is what stood where its entry was made, so each pixel is that of an earlier one."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    n = np.where(8 * sizes <= _ENDS[-1], np.searchsorted(_ENDS, 8 * sizes, "right"), 0)
    frame, begin = np.repeat(np.arange(len(bodies)), n), np.cumsum(n) - n
    place = np.arange(len(frame)) - begin[frame]
    held = np.frombuffer(b"".join([*bodies, bytes(2)]), np.uint8).astype(np.uint32)
    held = held[:-2] | held[1:-1] << 8 | held[2:] << 16
    bit = 8 * (np.cumsum(sizes) - sizes)[frame] + _ENDS[place] - _READ[place]
    codes = (held[bit >> 3] >> (bit & 7)).astype(np.int64) & (1 << _READ[place]) - 1
    stops = np.flatnonzero(codes == 257)
    stopped, at = np.unique(frame[stops], return_index=True)
    stop = np.zeros(len(bodies), np.int64)
    stop[stopped] = place[stops[at]]
    inside = place < stop[frame]
    odd = inside & np.where(place == 0, codes != 256, (codes == 256) | (codes - 257 >= place) & (codes >= 258))
    plain = stop > 1
    plain[frame[odd]] = False
    keep = inside & (place > 0) & plain[frame]
    codes, frame = codes[keep], frame[keep]
    word, begin = np.arange(len(codes)), np.cumsum(np.where(plain, stop - 1, 0)) - np.where(plain, stop - 1, 0)
    single = codes < 256
    entry = np.where(single, word, begin[frame] + codes - 258)
    # A word is one pixel longer than the one where its entry was made.
    length, up = np.where(single, 0, 1), entry
    while (more := length[up]).any():
        length, up = length + more, up[up]
    length += 1
    start = np.cumsum(length) - length
    owner = np.repeat(word, length)
    source = start[entry][owner] + np.arange(len(owner)) - start[owner]
    while not np.array_equal(up := source[source], source):
        source = up
    data = codes[owner[source]].astype(np.uint8).tobytes()
    ends = np.cumsum(np.bincount(frame, length, len(bodies)).astype(np.int64)).tolist()
    return [data[a:b] if one else _unlzw(body) for a, b, one, body in zip([0, *ends], ends, plain.tolist(), bodies, strict=False)]


#: Single bytes, and two codes that are no words.
_WORDS = [*(bytes([i]) for i in range(256)), b"", b""]


def _unlzw(data: bytes) -> bytes:
    own, width, bits, held, last, out = list(_WORDS), 9, 0, 0, b"", []
    for at in range(0, len(data), 64):
        part = data[at : at + 64]
        held |= int.from_bytes(part, "little") << bits
        bits += 8 * len(part)
        while bits >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            bits -= width
            if code == 256:
                own, width, last = list(_WORDS), 9, b""
                continue
            if code == 257:
                return b"".join(out)
            word = own[code] if code < len(own) else last + last[:1]
            out.append(word)
            if last:
                own.append(last + word[:1])
            last = word
            if len(own) == 1 << width and width < 12:
                width += 1
    return b"".join(out)

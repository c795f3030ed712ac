"""PNG in both directions, of 8-bit pictures, with the standard library alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """An RGBA raster, unfiltered."""
    return encode_all(pixels[None])[0]


def encode_all(stack: np.ndarray) -> list[bytes]:
    """The same of each of a stack of rasters."""
    n, height, width = stack.shape[:3]
    lines = np.zeros((n, height, 1 + width * 4), np.uint8)
    lines[..., 1:] = stack.reshape(n, height, width * 4)
    start, end = _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)), _chunk(b"IEND", b"")
    return [b"".join([start, _chunk(b"IDAT", zlib.compress(x, 6)), end]) for x in lines]


def decode(data: bytes) -> np.ndarray:
    """RGBA of an 8-bit PNG of any colour type, not interlaced; ValueError for others."""
    if data[:8] != _MAGIC:
        raise ValueError("no PNG")
    at, body, palette, clear = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body += part
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG without interlacing is read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * n + 1)
    out = lines[:, 1:].copy()
    for y in lines[:, 0].nonzero()[0]:
        line, above = lines[y, 1:], out[y - 1] if y else np.zeros(width * n, np.uint8)
        kind = lines[y, 0]
        if kind == 1:
            out[y] = np.cumsum(line.reshape(width, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = line + above
        else:
            _by_pixel(out[y], line, above, n, kind)
    picture = out.reshape(height, width, n)
    if colour == 3:
        alpha = np.full(256, 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = clear
        return np.concatenate([palette[picture[..., 0]], alpha[picture[..., 0]][..., None]], axis=-1)
    if colour == 6:
        return picture
    rgb = picture[..., :3] if n > 2 else np.repeat(picture[..., :1], 3, axis=-1)
    alpha = picture[..., -1:] if n in (2, 4) else np.full((height, width, 1), 255, np.uint8)
    return np.concatenate([rgb, alpha], axis=-1)


def _by_pixel(out: np.ndarray, line: np.ndarray, above: np.ndarray, n: int, kind: int) -> None:
    """Filters 3 and 4, whose pixels need the one before."""
    for k in range(len(line)):
        a, b = int(out[k - n]) if k >= n else 0, int(above[k])
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = int(above[k - n]) if k >= n else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[k] = (int(line[k]) + guess) & 255

"""Numpy kernels over one raster, a (height, width, 4) array of bytes, or over a stack of rasters of one size, (n, height, width, 4).

Regions are found over runs of pixels, not pixels: neighbouring runs of one row and the next are linked, and labels sink to
the smallest until they stand still. Runs are in reading order, so the smallest run of a region holds its first pixel.
A stack is one tall mask with an empty row below each of its own, so that numpy's cost of a call is paid once a stack.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np

KEY = (255, 0, 255)
#: Distance from the key below which pixels of a cell's border ring go, and the value below which they count as black.
RING_THRESHOLD, RING_BLACK = 150, 40


class Runs(NamedTuple):
    """Runs of set pixels in reading order, and the number of the region that each is in."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    region: np.ndarray


class Components(NamedTuple):
    """Regions by area, largest first; ties in the order of their first pixels."""

    area: np.ndarray
    box: np.ndarray  # x0, y0, x1, y1
    first: np.ndarray  # x, y of the first pixel
    touches_edge: np.ndarray


def key_distance2(pixels: np.ndarray) -> np.ndarray:
    """Squared distances from the key."""
    far = np.zeros(pixels.shape[:-1], np.int32)
    for k, value in enumerate(KEY):
        part = pixels[..., k].astype(np.int32)
        part -= value
        part *= part
        far += part
    return far


def key_distance(pixels: np.ndarray) -> np.ndarray:
    return np.sqrt(key_distance2(pixels).astype(np.float64))


@functools.lru_cache(64)
def reach2(threshold: float) -> int:
    """The least squared distance whose root, in double precision, isn't below threshold: what is less is nearer."""
    return int(np.searchsorted(np.sqrt(np.arange(3 * 255**2 + 1, dtype=np.float64)), threshold))


def runs(mask: np.ndarray, diagonal: bool) -> Runs:
    """Runs of a mask with regions of 8 neighbours, or of 4 unless diagonal."""
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    return linked(row, start, np.nonzero(edges == -1)[1], mask.shape[1], diagonal)


def linked(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, diagonal: bool) -> Runs:
    """Runs, in reading order and apart from each other, with their regions."""
    reach, stride = int(diagonal), width + 4
    first = np.searchsorted(row * stride + end + reach, (row - 1) * stride + start, "right")
    last = np.searchsorted(row * stride + start, (row - 1) * stride + end + reach, "left")
    n = np.maximum(last - first, 0)
    below = np.repeat(np.arange(len(row)), n)
    above = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    region = np.arange(len(row))
    while len(below):
        a, b = region[below], region[above]
        if not (apart := a != b).any():
            break
        below, above, a, b = below[apart], above[apart], a[apart], b[apart]
        np.minimum.at(region, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := region[region], region):
            region = up
    return Runs(row, start, end, region)


def _tall(masks: np.ndarray) -> np.ndarray:
    """Masks (n, height, width) below each other, with an empty row after each."""
    n, height, width = masks.shape
    out = np.zeros((n, height + 1, width), bool)
    out[:, :height] = masks
    return out.reshape(n * (height + 1), width)


def _fill(shape: tuple[int, int], found: Runs, chosen: np.ndarray) -> np.ndarray:
    steps = np.zeros((shape[0], shape[1] + 1), np.int8)
    steps[found.row[chosen], found.start[chosen]] = 1
    steps[found.row[chosen], found.end[chosen]] = -1
    return np.cumsum(steps, axis=1, dtype=np.int8)[:, :-1] > 0


def border_regions(mask: np.ndarray) -> np.ndarray:
    """The pixels of a mask's 8-regions that touch the border: what a flood from the border reaches, in whatever order."""
    height, width = mask.shape[-2:]
    n = math.prod(mask.shape[:-2])
    tall = _tall(mask.reshape(n, height, width))
    found = runs(tall, diagonal=True)
    y = found.row % (height + 1)
    outer = (y == 0) | (y == height - 1) | (found.start == 0) | (found.end == width)
    reached = np.zeros(len(found.row), bool)
    reached[found.region[outer]] = True
    return _fill(tall.shape, found, reached[found.region]).reshape(n, height + 1, width)[:, :height].reshape(mask.shape)


def remove_background(pixels: np.ndarray, threshold: float = 100, edge_threshold: float = 150) -> np.ndarray:
    """Clear pixels near the key everywhere, then those less near that reach the border through such pixels or clear ones."""
    distance2 = key_distance2(pixels)
    transparent, near = pixels[..., 3] == 0, distance2 < reach2(threshold)
    gone = border_regions(transparent | near | (distance2 < reach2(edge_threshold))) | near & ~transparent
    return _without(pixels, gone)


def _without(pixels: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Pixels, each as one number, with some cleared."""
    whole = np.ascontiguousarray(pixels).view(np.uint32)[..., 0]
    return np.where(gone, np.uint32(0), whole)[..., None].view(np.uint8)


def trim(pixels: np.ndarray, px: int = 4) -> np.ndarray:
    """Without px pixels at each side, where both sides are longer than twice that."""
    height, width = pixels.shape[-3:-1]
    return pixels[..., px : height - px, px : width - px, :] if px > 0 and width > 2 * px and height > 2 * px else pixels


def clean_ring(pixels: np.ndarray, depth: int = 3) -> np.ndarray:
    """Clear visible pixels nearer than depth to an edge if they are black or near the key."""
    height, width = pixels.shape[-3:-1]
    y, x = np.ogrid[:height, :width]
    ring = np.minimum(np.minimum(x, width - 1 - x), np.minimum(y, height - 1 - y)) < depth
    black = (pixels[..., 0] < RING_BLACK) & (pixels[..., 1] < RING_BLACK) & (pixels[..., 2] < RING_BLACK)
    return _without(pixels, ring & (pixels[..., 3] != 0) & (black | (key_distance2(pixels) < reach2(RING_THRESHOLD))))


def components(mask: np.ndarray, min_area: int = 1) -> Components:
    """4-regions of at least min_area pixels."""
    return components_of(mask[None], min_area)[1]


def components_of(masks: np.ndarray, min_area: int = 1) -> tuple[np.ndarray, Components]:
    """4-regions of at least min_area pixels of each of a stack of masks, and the number of the mask that each is in; those of one mask follow each other."""
    _, height, width = masks.shape
    found = runs(_tall(masks), diagonal=False)
    root = found.region == np.arange(len(found.region))
    first, number = np.flatnonzero(root), (np.cumsum(root) - 1)[found.region]
    n, y = len(first), found.row % (height + 1)
    area = np.bincount(number, found.end - found.start, n).astype(np.int64)
    box = np.empty((n, 4), np.int64)
    box[:, 0], box[:, 1], box[:, 2], box[:, 3] = width, height, 0, 0
    np.minimum.at(box[:, 0], number, found.start)
    np.minimum.at(box[:, 1], number, y)
    np.maximum.at(box[:, 2], number, found.end)
    np.maximum.at(box[:, 3], number, y + 1)
    edge = (box[:, 0] == 0) | (box[:, 1] == 0) | (box[:, 2] == width) | (box[:, 3] == height)
    owner = found.row[first] // (height + 1)
    order = np.lexsort((-area, owner))
    order = order[area[order] >= min_area]
    return owner[order], Components(area[order], box[order], np.stack([found.start[first], y[first]], axis=1)[order], edge[order])


def visible_box(pixels: np.ndarray) -> tuple[int, int, int, int] | None:
    seen, box = visible_boxes(pixels[None])
    return tuple(map(int, box[0])) if seen[0] else None


def visible_boxes(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether anything of each raster is visible, and the box of what is."""
    n, height, width = stack.shape[:3]
    if not (n and height and width):
        return np.zeros(n, bool), np.zeros((n, 4), np.int64)
    seen = stack[..., 3] > 0
    x, y = seen.any(axis=1), seen.any(axis=2)
    return x.any(axis=1), np.stack([x.argmax(axis=1), y.argmax(axis=1), width - x[:, ::-1].argmax(axis=1), height - y[:, ::-1].argmax(axis=1)], axis=1)


@functools.lru_cache(4096)
def _weights(size: int, new: int, support: float = 3.0) -> np.ndarray:
    """Rows of windowed-sinc weights, of three lobes, that resample size points to new ones."""
    scale = max(size / new, 1.0)
    centre = (np.arange(new) + 0.5) * size / new
    at = (np.arange(size)[None] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(at) < support, np.sinc(at) * np.sinc(at / support), 0.0)
    return w / w.sum(axis=1, keepdims=True)


@functools.lru_cache(4096)
def _single_weights(size: int, new: int) -> tuple[np.ndarray, float]:
    """_weights() in single precision, and what sums of bytes so weighted may err by at most, with room."""
    w = _weights(size, new)
    return w.astype(np.float32), float(255 * np.finfo(np.float32).eps * ((w != 0).sum(axis=1).max() + 2) * np.abs(w).sum(axis=1).max())


def _resampled(lines: np.ndarray, new: int) -> np.ndarray:
    """Lines (size, numbers) of bytes, as floats, resampled to new ones and rounded to bytes.

    Single precision tells all but those within its error of a half, which are summed anew in double precision, old point by old point:
    no rounding depends on what lies beside a number.
    """
    weights, error = _single_weights(len(lines), new)
    out = weights @ lines
    rounded = np.rint(out)
    np.abs(np.subtract(out, rounded, out=out), out=out)
    row, at = np.divmod(np.flatnonzero(out.ravel() >= 0.5 - error), lines.shape[1])
    if len(row):
        weights, total = _weights(len(lines), new), np.zeros(len(row))
        for k, line in enumerate(lines):
            total += weights[row, k] * line[at]
        rounded[row, at] = np.rint(total)
    np.maximum(rounded, 0, out=rounded)
    return np.minimum(rounded, 255, out=rounded)


@functools.cache
def _straight() -> np.ndarray:
    """Of 256 * alpha + a premultiplied value, the value without alpha."""
    alpha, value = np.mgrid[:256.0, :256.0]
    return np.where(alpha > 0, np.clip(np.round(value * 255 / np.maximum(alpha, 1)), 0, 255), 0).astype(np.uint8).ravel()


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos resampling with premultiplied alpha, rounded to bytes after each of the two passes."""
    h, w = pixels.shape[-3:-1]
    if (height, width) == (h, w):
        return pixels.copy()
    # The axis that is resampled comes first, and pictures last.
    stack = np.ascontiguousarray(pixels.reshape(-1, h, w, 4).transpose(2, 1, 3, 0)).astype(np.uint16)
    rgb = stack[:, :, :3]
    rgb *= stack[:, :, 3:]
    rgb += 128
    rgb += rgb >> 8
    rgb >>= 8
    value = stack.astype(np.float32)
    if width != w:
        value = _resampled(value.reshape(w, -1), width).reshape(width, h, 4, -1)
    value = np.ascontiguousarray(value.swapaxes(0, 1))
    if height != h:
        value = _resampled(value.reshape(h, -1), height).reshape(height, width, 4, -1)
    found = value.astype(np.uint16)
    alpha = found[:, :, 3:] << 8
    out = np.empty((value.shape[3], height, width, 4), np.uint8)
    out[..., :3] = _straight()[found[:, :, :3] | alpha].transpose(3, 0, 1, 2)
    out[..., 3] = found[:, :, 3].transpose(2, 0, 1)
    return out.reshape(*pixels.shape[:-3], height, width, 4)


def paste(canvas: np.ndarray, image: np.ndarray, x: int, y: int, masked: bool = False) -> None:
    """Put an image on a canvas, in place, clipped; masked blends all channels by the image's alpha, else it overwrites."""
    height, width = canvas.shape[-3:-1]
    x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + image.shape[-2]), min(height, y + image.shape[-3])
    if x0 >= x1 or y0 >= y1:
        return
    part, under = image[..., y0 - y : y1 - y, x0 - x : x1 - x, :], canvas[..., y0:y1, x0:x1, :]
    if masked:
        # At most 255 * 255 + 128, and 254 more, so 16 bits hold it.
        a = part[..., 3:].astype(np.uint16)
        blend = part * a + under * (255 - a) + np.uint16(128)
        under[...] = (blend + (blend >> 8)) >> 8
    else:
        under[...] = part


def compose(frames: list[np.ndarray], rows: int, cols: int, cell: int) -> np.ndarray:
    """Frames in reading order on one sheet."""
    canvas = np.zeros((*frames[0].shape[:-3], rows * cell, cols * cell, 4), np.uint8)
    for i, frame in enumerate(frames):
        paste(canvas, frame, i % cols * cell, i // cols * cell, masked=True)
    return canvas


def placement(width: int, height: int, cell: int, fit: float, align: str = "center", largest: tuple[int, int] | None = None) -> dict[str, int]:
    """What scalars.placement() computes for columns, in the same order of operations."""
    if not (width > 0 and height > 0):
        return {"new_w": 0, "new_h": 0, "paste_x": 0, "paste_y": 0}
    scale = min(cell / largest[0], cell / largest[1]) * fit if largest and largest[0] and largest[1] else 0.0
    scale = scale or min(cell / width, cell / height) * fit
    w, h = max(1, math.floor(width * scale)), max(1, math.floor(height * scale))
    y = cell - h - max(0, int(cell * (1 - fit) * 0.5)) if align in ("bottom", "feet") else (cell - h) // 2
    return {"new_w": w, "new_h": h, "paste_x": (cell - w) // 2, "paste_y": y}


def canvases_of(stack: np.ndarray, boxes: np.ndarray, size: int, placed: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Clear squares of size, each with the box of a raster resampled and put on it by (new_w, new_h, x, y). Boxes of one size that become one size are resampled at once."""
    out = np.zeros((len(stack), size, size, 4), np.uint8)
    alike: dict[tuple[int, ...], list[int]] = {}
    corners = boxes.tolist()
    for i, ((x0, y0, x1, y1), at) in enumerate(zip(corners, placed, strict=True)):
        alike.setdefault((x1 - x0, y1 - y0, *at), []).append(i)
    for (w, h, new_w, new_h, x, y), own in alike.items():
        if w and h and new_w and new_h:
            crops = np.empty((len(own), h, w, 4), np.uint8)
            for k, i in enumerate(own):
                crops[k] = stack[i, corners[i][1] : corners[i][3], corners[i][0] : corners[i][2]]
            canvas = np.zeros((len(own), size, size, 4), np.uint8)
            paste(canvas, resize(crops, new_w, new_h), x, y)
            out[own] = canvas
    return out


def centred(pixels: np.ndarray, size: int = 256, threshold: float = 100, edge_threshold: float = 150) -> np.ndarray:
    """The visible part of a single sprite on a square canvas, at nine tenths of it; of each of a stack of them."""
    if pixels.ndim == 3:
        return centred(pixels[None], size, threshold, edge_threshold)[0]
    clean = remove_background(pixels, threshold, edge_threshold)
    seen, boxes = visible_boxes(clean)
    boxes = np.where(seen[:, None], boxes, (0, 0, clean.shape[2], clean.shape[1]))
    placed = []
    for x0, y0, x1, y1 in boxes.tolist():
        w = h = 0
        if x1 > x0 and y1 > y0:
            scale = min(size / (x1 - x0), size / (y1 - y0)) * 0.9
            w, h = max(1, int((x1 - x0) * scale)), max(1, int((y1 - y0) * scale))
        placed.append((w, h, (size - w) // 2, (size - h) // 2))
    return canvases_of(clean, boxes, size, placed)

"""Processing of sheets and single sprites: from rasters to files, as rows (sheet_id, name, content)."""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import frames as fr
from ..operators import kernels
from ..operators.animation import gifs, read_gifs
from ..operators.frames import Params
from ..sources import png
from ..sources.rasters import STACK_BYTES, Made, mapped, plain, stacks

FILES = "sheet_id long, name string, content binary"
PICTURES = "sheet_id long, name string, frame int, width int, height int, rgba binary"


class Request:
    """What is asked for a sheet: target, mode, prompt and role, own grid or label prefix, sizes and limits.

    An own grid needs both rows and columns; a mode without grid, and any unknown one unless strict, is a single sprite.
    """

    def __init__(self, target: str, mode: str, prompt: str = "", role: str = "", source: str = "", rows: int | None = None, cols: int | None = None, cell_size: int | None = None, label_prefix: str | None = None,
                 single_size: int = 256, duration: int = 200, reject_edge_touch: bool = False, prompt_text: str | None = None, strict: bool = False, **params):
        if target not in catalog.TARGET_MODES:
            raise ValueError(f"target {target!r} is none of {', '.join(sorted(catalog.TARGET_MODES))}")
        if strict and mode not in catalog.TARGET_MODES[target]:
            raise ValueError(f"mode {mode!r} is none of {', '.join(catalog.TARGET_MODES[target])}")
        if (rows is None) != (cols is None):
            raise ValueError("an own grid needs rows and columns")
        self.target, self.mode, self.prompt, self.role, self.source = target, mode, prompt or "", role or "", source
        self.own_grid, self.single_size, self.duration, self.reject = rows is not None, single_size, duration, reject_edge_touch
        self.prompt_text = prompt_text if prompt_text is not None else prompt or None
        shape = (rows, cols) if self.own_grid else catalog.GRID_SHAPES.get(mode)
        self.is_sheet = shape is not None
        rows, cols = shape or (1, 1)
        self.params = Params(rows=rows, cols=cols, cell_size=cell_size or (96 if (rows, cols) == (4, 4) else 128), **params)
        self.labels = [f"{label_prefix or mode}-{i + 1}" for i in range(rows * cols)] if self.own_grid else catalog.FRAME_LABELS.get(mode, [])
        self.by_direction = mode == "player_sheet" and not self.own_grid

    def metadata(self) -> dict:
        p = self.params
        return {"target": self.target, "mode": self.mode, "prompt": self.prompt, "role": self.role, "input": self.source, "threshold": p.threshold, "edge_threshold": p.edge_threshold, "duration": self.duration}


class _Sheets:
    """What files of a stack of sheets are made from, each made once and only when a file asks for it."""

    def __init__(self, rasters: np.ndarray, ask: Request):
        self.rasters, self.ask = rasters, ask

    def __len__(self) -> int:
        return len(self.rasters)

    @functools.cached_property
    def clean(self) -> np.ndarray:
        return kernels.remove_background(self.rasters, self.ask.params.threshold, self.ask.params.edge_threshold)

    @functools.cached_property
    def cut(self) -> fr.Cut:
        return fr.cut_stack(self.clean, self.ask.params)

    @functools.cached_property
    def edge_touch(self) -> np.ndarray:
        """Of all frames, as fr.checked() tells."""
        p, f = self.ask.params, self.cut
        width, height = (f.cells.shape[2], f.cells.shape[1]) if p.symmetric else f.cell_size
        return f.has_box & ((f.box[:, :2] <= p.edge_touch_margin) | (f.box[:, 2:] >= np.array([width, height]) - p.edge_touch_margin)).any(axis=1)

    @functools.cached_property
    def placed(self) -> list[tuple[int, int, int, int]]:
        """new_w, new_h, paste_x and paste_y of all frames, as fr.placed() tells."""
        p, f = self.ask.params, self.cut
        largest = zip(f.max_width.tolist(), f.max_height.tolist(), strict=True) if p.shared_scale else itertools.repeat(None)
        return [tuple(kernels.placement(w, h, p.cell_size, p.fit_scale, p.align, m).values()) for w, h, m in zip(f.width.tolist(), f.height.tolist(), largest, strict=False)]

    @functools.cached_property
    def canvases(self) -> np.ndarray:
        """(sheets, frames, size, size, 4)."""
        p = self.ask.params
        return kernels.canvases_of(self.cut.cells, self.cut.crop, p.cell_size, self.placed).reshape(len(self), p.rows * p.cols, p.cell_size, p.cell_size, 4)

    @functools.cached_property
    def sheet(self) -> np.ndarray:
        """All frames of each sheet on one."""
        p = self.ask.params
        return kernels.compose(list(self.canvases.swapaxes(0, 1)), p.rows, p.cols, p.cell_size)

    @functools.cached_property
    def single(self) -> np.ndarray:
        p = self.ask.params
        return kernels.centred(self.rasters, self.ask.single_size, p.threshold, p.edge_threshold)

    def metadata(self) -> list[bytes]:
        ask, p = self.ask, self.ask.params
        if not ask.is_sheet:
            return [json.dumps(ask.metadata() | {"single_size": ask.single_size}, indent=2).encode()] * len(self)
        meta = ask.metadata() | ({"directions": catalog.DIRECTIONS} if ask.by_direction else {})
        meta |= {k: v for k, v in p.as_dict().items() if k not in ("threshold", "edge_threshold", "symmetric")}
        f, n = self.cut, p.rows * p.cols
        w, h = f.cell_size
        count, area, touch = f.count.tolist(), f.area.tolist(), self.edge_touch.tolist()
        chosen, box = ([x if there else None for x, there in zip(v.tolist(), has.tolist(), strict=True)] for v, has in ((f.chosen, f.has_chosen), (f.box, f.has_box)))
        records = []
        for i, (new_w, new_h, x, y) in enumerate(self.placed):
            r, c = divmod(i % n, p.cols)
            # Names of the metadata's fields, which results must match.
            records.append({
                "grid": [r, c], "source_box": [c * w, r * h, (c + 1) * w, (r + 1) * h], "component_mode": p.component_mode, "component_count": count[i],
                "selected_component_area": area[i] if chosen[i] else None, "selected_component_bbox": chosen[i], "crop_bbox": box[i],
                "edge_touch": touch[i], "output_size": [new_w, new_h], "paste_position": [x, y],
            })
        out = []
        for k in range(0, len(records), n):
            own = records[k : k + n]
            out.append(json.dumps(meta | {"frame_labels": ask.labels, "frames": own, "edge_touch_frames": [r["grid"] for r in own if r["edge_touch"]]}, indent=2).encode())
        return out


#: By name, what makes the bytes of a file of each of a stack of sheets.
Makers = dict[str, Callable[[_Sheets], list[bytes]]]


def _makers(ask: Request) -> Makers:
    """All files that are asked for, in order, but for the prompt's."""
    p = ask.params
    if not ask.is_sheet:
        return {"raw.png": lambda s: png.encode_all(s.rasters), "clean.png": lambda s: png.encode_all(s.single), "pipeline-meta.json": _Sheets.metadata}
    out: Makers = {"raw-sheet.png": lambda s: png.encode_all(s.rasters), "raw-sheet-clean.png": lambda s: png.encode_all(s.clean)}
    for i, label in enumerate(ask.labels[: p.rows * p.cols]):
        out[f"{label}.png"] = lambda s, i=i: png.encode_all(s.canvases[:, i])
    out["sheet-transparent.png"] = lambda s: png.encode_all(s.sheet)
    if ask.by_direction:
        for i, direction in enumerate(catalog.DIRECTIONS):
            own = slice(i * p.cols, (i + 1) * p.cols)
            strip = slice(i * p.cell_size, (i + 1) * p.cell_size)
            out[f"{direction}-strip.png"] = lambda s, strip=strip: png.encode_all(s.sheet[:, strip])
            out[f"{direction}.gif"] = lambda s, own=own: gifs(s.canvases[:, own], ask.duration)
    else:
        out["animation.gif"] = lambda s: gifs(s.canvases, ask.duration)
    return out | {"pipeline-meta.json": _Sheets.metadata}


def frame_rows(rasters: DataFrame | Made, p: Params) -> DataFrame:
    """Frames cut, checked, placed and rendered, one row each; nothing is shuffled."""
    return fr.render(fr.placed(fr.checked(fr.cut(rasters, p), p), p), p)


PROMPT_FILE = "prompt-used.txt"


def process(rasters: DataFrame | Made, ask: Request, only: Iterable[str] | None = None) -> DataFrame:
    """All files of each sheet or sprite, or only those named, in one pass without a shuffle; nothing is made that no file needs.

    With reject_edge_touch, reading fails at a frame that touches its cell's edge, before any file of its sheet is there, whatever files are named.
    """
    wanted = None if only is None else set(only)
    makers = {name: make for name, make in _makers(ask).items() if wanted is None or name in wanted}
    if ask.prompt_text is not None and (wanted is None or PROMPT_FILE in wanted):
        makers[PROMPT_FILE] = lambda s, text=ask.prompt_text.encode(): [text] * len(s)
    p = ask.params
    pixels = p.rows * p.cols * p.cell_size**2 if ask.is_sheet else ask.single_size**2

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, stack in stacks(batch, pixels):
            sheets = _Sheets(stack, ask)
            if ask.reject and ask.is_sheet and sheets.edge_touch.any():
                first = int(np.argmax(sheets.edge_touch)) // (p.rows * p.cols)
                raise ValueError(f"a frame touches its cell's edge: sheet {own.column('sheet_id')[first].as_py()}")
            made = [make(sheets) for make in makers.values()]
            numbers = own.column("sheet_id").take(pa.array(np.repeat(np.arange(len(sheets)), len(made))))
            yield fr._columns(FILES, numbers, pa.array(list(makers) * len(sheets), pa.string()), pa.array([x for of_sheet in zip(*made, strict=True) for x in of_sheet], pa.binary()))

    return mapped(plain(rasters), run, FILES)


def decoded(files: DataFrame) -> DataFrame:
    """(sheet_id, name, frame, width, height, rgba) of the pictures among FILES: PNG have one frame, 0, GIF as many as they have."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        names, contents = (batch.column(k).to_pylist() for k in ("name", "content"))
        animations = read_gifs(content for name, content in zip(names, contents, strict=True) if name.endswith(".gif"))
        for sheet, name, content in zip(batch.column("sheet_id").to_pylist(), names, contents, strict=True):
            for i, x in enumerate(next(animations)[0] if name.endswith(".gif") else [png.decode(content)]):
                rows.append((sheet, name, i, x.shape[1], x.shape[0], x.tobytes()))
                size += x.size
            if size >= STACK_BYTES:
                yield fr._batch(rows, PICTURES)
                rows, size = [], 0
        if rows:
            yield fr._batch(rows, PICTURES)

    return mapped(files.where(F.col("name").rlike(r"\.(png|gif)$")), run, PICTURES)


def weighted_sums(files: DataFrame, picture: str) -> DataFrame:
    """(sheet_id, name, content) of all FILES in one pass: of PNG files of one name the sum of x + 2y and weighted channels over all pixels, of others null."""

    def total(content: bytes) -> int:
        x = png.decode(content)
        height, width = x.shape[:2]
        # Places add up to the same in every picture of a size.
        places = height * (width * (width - 1) // 2) + 2 * width * (height * (height - 1) // 2)
        return places + int(x.reshape(-1, 4).sum(axis=0, dtype=np.int64) @ (1, 3, 5, 7))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums = [total(content) if name == picture else None for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("sheet_id"), batch.column("name"), pa.array(sums, pa.int64())], names=["sheet_id", "name", "content"])

    # No other file's bytes are sent.
    return mapped(files.select("sheet_id", "name", F.when(F.col("name") == picture, F.col("content")).alias("content")), run, "sheet_id long, name string, content long")

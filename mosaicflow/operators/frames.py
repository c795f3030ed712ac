"""Frames of sheets: cutting, components, quality checks and placement.

A sheet is one row, so all its frames come out of one call of a kernel and nothing is shuffled: what a frame needs of
its sheet, the largest width and height, comes with it. Placement is arithmetic on those columns. Kernels take sheets of
one size by stacks of bounded bytes, so small sheets don't pay for a call each, and a task holds a stack, not its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import edge_touch, placement
from ..sources.rasters import RASTERS, Made, mapped, plain, stacks
from . import kernels


@dataclass(frozen=True)
class Params:
    """How sheets are processed. symmetric measures edge touch in the trimmed frame, otherwise against the whole cell."""

    threshold: float = 100
    edge_threshold: float = 150
    rows: int = 2
    cols: int = 2
    cell_size: int = 128
    fit_scale: float = 0.85
    trim_border: int = 4
    edge_clean_depth: int = 3
    align: str = "center"
    shared_scale: bool = False
    component_mode: str = "all"
    component_padding: int = 0
    min_component_area: int = 1
    edge_touch_margin: int = 0
    symmetric: bool = False

    def __post_init__(self):
        if self.rows < 1 or self.cols < 1:
            raise ValueError("a grid needs rows and columns")
        if self.align not in ("center", "bottom", "feet") or self.component_mode not in ("all", "largest"):
            raise ValueError("align is center, bottom or feet; component_mode is all or largest")

    def but(self, **changes) -> Params:
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)


#: For a single prop that stands on the ground.
PROP = Params(rows=1, cols=1, cell_size=256, fit_scale=0.9, align="feet", component_mode="largest", component_padding=8, min_component_area=200, edge_clean_depth=2)

COMPONENTS = "sheet_id long, grid_row int, grid_col int, rank int, area long, x0 int, y0 int, x1 int, y1 int, first_x int, first_y int, touches_edge boolean"
FRAMES = (
    "sheet_id long, grid_row int, grid_col int, cell_width int, cell_height int, trimmed_width int, trimmed_height int, component_count long, selected_area long, "
    "sel_x0 int, sel_y0 int, sel_x1 int, sel_y1 int, x0 int, y0 int, x1 int, y1 int, frame_width int, frame_height int, max_width int, max_height int, rgba binary"
)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _columns(schema: str, *columns) -> pa.RecordBatch:
    """Arrays of numbers, or of Arrow, as a batch of a schema."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(kinds[t].to_pandas_dtype(), copy=False), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def remove_background(rasters: DataFrame | Made, threshold: float = 100, edge_threshold: float = 150) -> DataFrame:
    """Rasters with key colour cleared, everywhere near the key and, less near, as far as it reaches the border."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, stack in stacks(batch):
            out = [x.tobytes() for x in kernels.remove_background(stack, threshold, edge_threshold)]
            yield pa.RecordBatch.from_arrays([own.column("sheet_id"), own.column("width"), own.column("height"), pa.array(out, pa.binary())], names=["sheet_id", "width", "height", "rgba"])

    return mapped(plain(rasters), run, RASTERS)


def cells_of(stack: np.ndarray, p: Params) -> np.ndarray:
    """The cells of a stack of sheets, trimmed and with their ring cleaned, sheet by sheet in reading order; what the grid leaves over is dropped."""
    n, h, w = len(stack), stack.shape[1] // p.rows, stack.shape[2] // p.cols
    cells = stack[:, : p.rows * h, : p.cols * w].reshape(n, p.rows, h, p.cols, w, 4).swapaxes(2, 3).reshape(n * p.rows * p.cols, h, w, 4)
    cells = kernels.trim(cells, p.trim_border)
    return kernels.clean_ring(cells, p.edge_clean_depth) if p.edge_clean_depth > 0 else cells


def component_table(rasters: DataFrame | Made, p: Params) -> DataFrame:
    """One row a component of each frame, ranked from 1 by area; ties in reading order of their first pixels."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, stack in stacks(batch):
            cells = cells_of(kernels.remove_background(stack, p.threshold, p.edge_threshold), p)
            frame, c = kernels.components_of(cells[..., 3] > 0, p.min_component_area)
            rank = np.arange(len(frame)) - np.searchsorted(frame, frame) + 1
            sheet, at = np.divmod(frame, p.rows * p.cols)
            yield _columns(COMPONENTS, own.column("sheet_id").take(pa.array(sheet)), at // p.cols, at % p.cols, rank, c.area, *c.box.T, *c.first.T, c.touches_edge)

    return mapped(rasters, run, COMPONENTS)


class Cut(NamedTuple):
    """The frames of a stack of sheets, sheet by sheet in reading order. chosen and box count only where has_chosen and has_box say so."""

    cells: np.ndarray  # trimmed, (n, height, width, 4)
    cell_size: tuple[int, int]  # width, height of the untrimmed ones
    count: np.ndarray
    area: np.ndarray
    has_chosen: np.ndarray
    chosen: np.ndarray
    has_box: np.ndarray
    box: np.ndarray
    crop: np.ndarray  # the box, or the whole cell without one
    width: np.ndarray
    height: np.ndarray
    max_width: np.ndarray  # of all frames of its sheet
    max_height: np.ndarray


def cut_stack(clean: np.ndarray, p: Params) -> Cut:
    """The frames of sheets whose background is removed."""
    cells = cells_of(clean, p)
    n, th, tw = cells.shape[:3]
    owner, found = kernels.components_of(cells[..., 3] > 0, p.min_component_area)
    count = np.bincount(owner, minlength=n)
    area, chosen, has_chosen = np.zeros(n, np.int64), np.zeros((n, 4), np.int64), np.zeros(n, bool)
    has_box, box = kernels.visible_boxes(cells)
    if p.component_mode == "largest":
        has_chosen = count > 0
        first = np.searchsorted(owner, np.flatnonzero(has_chosen))
        area[has_chosen], chosen[has_chosen] = found.area[first], found.box[first]
        pad = np.array([-1, -1, 1, 1]) * p.component_padding
        box[has_chosen] = np.clip(chosen[has_chosen] + pad, 0, (tw, th, tw, th))
        has_box = has_box | has_chosen
    crop = np.where(has_box[:, None], box, (0, 0, tw, th))
    width, height = crop[:, 2] - crop[:, 0], crop[:, 3] - crop[:, 1]
    largest = [np.repeat(x.reshape(-1, p.rows * p.cols).max(axis=1), p.rows * p.cols) for x in (width, height)]
    return Cut(cells, (clean.shape[2] // p.cols, clean.shape[1] // p.rows), count, area, has_chosen, chosen, has_box, box, crop, width, height, *largest)


def cut(rasters: DataFrame | Made, p: Params, with_pixels: bool = True) -> DataFrame:
    """FRAMES: frames cut to their box, with components counted and, for the largest, selected. An empty frame isn't cut.

    A sheet's frames follow each other in reading order. with_pixels=False leaves rgba null: what a frame measures needs none of them.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, stack in stacks(batch):
            f = cut_stack(kernels.remove_background(stack, p.threshold, p.edge_threshold), p)
            n = len(f.count)
            sheet, at = np.divmod(np.arange(n), p.rows * p.cols)
            rgba = pa.array([f.cells[i, y0:y1, x0:x1].tobytes() for i, (x0, y0, x1, y1) in enumerate(f.crop.tolist())], pa.binary()) if with_pixels else pa.nulls(n, pa.binary())
            size = [np.full(n, v) for v in (*f.cell_size, f.cells.shape[2], f.cells.shape[1])]
            known = lambda values, there, kind: pa.array(values, kind, mask=~there)
            yield _columns(
                FRAMES, own.column("sheet_id").take(pa.array(sheet)), at // p.cols, at % p.cols, *size, f.count, known(f.area, f.has_chosen, pa.int64()),
                *(known(v.astype(np.int32), f.has_chosen, pa.int32()) for v in f.chosen.T), *(known(v.astype(np.int32), f.has_box, pa.int32()) for v in f.box.T), f.width, f.height, f.max_width, f.max_height, rgba,
            )

    return mapped(rasters, run, FRAMES)


def checked(frames: DataFrame, p: Params) -> DataFrame:
    """frames with edge_touch.

    Boxes are in the trimmed frame. Measured against the untrimmed cell, as results must be by default, the right and the bottom touch
    only if the margin makes up for the trim; symmetric measures against the trimmed frame.
    """
    width, height = ("trimmed_width", "trimmed_height") if p.symmetric else ("cell_width", "cell_height")
    touch = edge_touch(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col(width), F.col(height), p.edge_touch_margin)
    return frames.withColumn("edge_touch", touch)


def placed(frames: DataFrame, p: Params) -> DataFrame:
    """frames with new_w, new_h, paste_x and paste_y; with shared_scale, by the largest frame of their sheet."""
    shared = (F.col("max_width"), F.col("max_height")) if p.shared_scale else (None, None)
    return frames.withColumns(placement(F.col("frame_width"), F.col("frame_height"), p.cell_size, p.fit_scale, p.align, *shared))


def edge_touch_frames(frames: DataFrame) -> DataFrame:
    """(sheet_id, flagged): row:column of the frames that touch, in reading order; an empty text for none."""
    at = F.when(F.col("edge_touch"), F.struct("grid_row", "grid_col"))
    flagged = F.transform(F.array_sort(F.collect_list(at)), lambda s: F.concat_ws(":", s["grid_row"].cast("string"), s["grid_col"].cast("string")))
    return frames.groupBy("sheet_id").agg(F.array_join(flagged, ",").alias("flagged"))


def labelled(frames: DataFrame, labels: list[str], cols: int) -> DataFrame:
    """frames with frame_index from 0 in reading order and label, by position. Frames without label go."""
    index = F.col("grid_row") * cols + F.col("grid_col")
    label = F.get(F.array(*map(F.lit, labels)), F.col("frame_index"))
    return frames.withColumn("frame_index", index).withColumn("label", label).where("label IS NOT NULL")


def largest_per_frame(components: DataFrame) -> DataFrame:
    """The component of rank 1 of each frame, by area, then first pixel, from a component table as a relation."""
    order = Window.partitionBy("sheet_id", "grid_row", "grid_col").orderBy(F.desc("area"), "first_y", "first_x")
    return components.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def render(frames: DataFrame, p: Params) -> DataFrame:
    """placed frames with canvas: the frame resampled and put on a clear cell."""
    columns = [c for c in frames.columns if c != "rgba"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = {"frame_width": "width", "frame_height": "height"}
        sized = batch.rename_columns([names.get(c, c) for c in batch.schema.names])
        for own, stack in stacks(sized, p.cell_size**2):
            whole = np.tile((0, 0, stack.shape[2], stack.shape[1]), (len(stack), 1))
            placed = list(zip(*(own.column(k).to_pylist() for k in ("new_w", "new_h", "paste_x", "paste_y")), strict=True))
            out = [x.tobytes() for x in kernels.canvases_of(stack, whole, p.cell_size, placed)]
            yield pa.RecordBatch.from_arrays([*(own.column(names.get(c, c)) for c in columns), pa.array(out, pa.binary())], names=[*columns, "canvas"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.drop("rgba").schema)
    return mapped(frames, run, f"{schema}, canvas binary")


def centred(rasters: DataFrame | Made, size: int = 256, threshold: float = 100, edge_threshold: float = 150) -> DataFrame:
    """Single sprites on a square canvas: (sheet_id, width, height, rgba)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, stack in stacks(batch, size * size):
            side = np.full(own.num_rows, size)
            yield _columns(RASTERS, own.column("sheet_id"), side, side, pa.array([x.tobytes() for x in kernels.centred(stack, size, threshold, edge_threshold)], pa.binary()))

    return mapped(rasters, run, RASTERS)

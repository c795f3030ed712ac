"""Shapes as few quadtree cells of mixed sizes, so that points meet them in equi-joins.

A cell of level k is a square of side 2 ** k, whose number is the floor of a place over that side. A shape takes large cells for its inside, which need no
further test, and smaller ones along its border. A point is in one cell of each level, so it probes as many rows as there are levels in use.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a shape, at most, and the least level: smaller cells wouldn't tell points apart that are given in pixels.
MOST_CELLS, LEAST_LEVEL = 64, -6
#: Points of one cell from which on it is cut into smaller ones, and how often that is tried.
HOT_POINTS, HOT_TURNS = 1 << 20, 12
OUT, ON, IN = 0, 1, 2
CELLS = "number long, level int, cell_x long, cell_y long, inner boolean"


def _rect(s: dict, x0: float, y0: float, x1: float, y1: float) -> int:
    a, b, c, d = s["x"], s["y"], s["x"] + s["w"], s["y"] + s["h"]
    if x1 < a or x0 > c or y1 < b or y0 > d:
        return OUT
    return IN if a <= x0 and x1 <= c and b <= y0 and y1 <= d else ON


def _ellipse(s: dict, x0: float, y0: float, x1: float, y1: float) -> int:
    far = lambda a, b, m, r: max(abs(a - m), abs(b - m)) / r
    near = lambda a, b, m, r: max(a - m, m - b, 0.0) / r
    if far(x0, x1, s["x"], s["rx"]) ** 2 + far(y0, y1, s["y"], s["ry"]) ** 2 < 1 - 1e-9:
        return IN
    return OUT if near(x0, x1, s["x"], s["rx"]) ** 2 + near(y0, y1, s["y"], s["ry"]) ** 2 > 1 + 1e-9 else ON


def _polygon(s: dict, x0: float, y0: float, x1: float, y1: float) -> int:
    p = s["xy"]
    q = np.roll(p, -1, axis=0)
    low, high = np.minimum(p, q), np.maximum(p, q)
    close = (low[:, 0] <= x1) & (high[:, 0] >= x0) & (low[:, 1] <= y1) & (high[:, 1] >= y0)
    # An edge whose box meets the cell misses it only if all corners are clearly on one side of its line.
    a, b = p[close], q[close]
    corners = np.array([(x0, y0), (x0, y1), (x1, y0), (x1, y1)])
    side = (b[:, None, 0] - a[:, None, 0]) * (corners[None, :, 1] - a[:, None, 1]) - (b[:, None, 1] - a[:, None, 1]) * (corners[None, :, 0] - a[:, None, 0])
    slack = 1e-9 * (1 + np.abs(b - a).sum(axis=1) * (np.abs(a).sum(axis=1) + np.abs(corners).sum()))[:, None]
    if len(a) and not ((side > slack).all(axis=1) | (side < -slack).all(axis=1)).all():
        return ON
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    rises = (p[:, 1] > y) != (q[:, 1] > y)
    at = p[rises, 0] + (q[rises, 0] - p[rises, 0]) * (y - p[rises, 1]) / (q[rises, 1] - p[rises, 1])
    return IN if (x < at).sum() % 2 else OUT


_KINDS = {"rect": (_rect, ("x", "y", "w", "h")), "ellipse": (_ellipse, ("x", "y", "rx", "ry")), "polygon": (_polygon, ("xy",))}


def _prepared(s: dict) -> tuple | None:
    """What tells a cell's side, and the shape's box; None for a shape without extent or of no known type."""
    side, needs = _KINDS.get(s["type"], (None, ()))
    if s["type"] == "polygon" and s["points"]:
        s = s | {"xy": np.array([(p["x"], p["y"]) for p in s["points"]], float)}
    if side is None or any(s.get(n) is None for n in needs):
        return None
    if s["type"] == "rect":
        box = (s["x"], s["y"], s["x"] + s["w"], s["y"] + s["h"])
    elif s["type"] == "ellipse":
        box = (s["x"] - s["rx"], s["y"] - s["ry"], s["x"] + s["rx"], s["y"] + s["ry"]) if s["rx"] > 0 and s["ry"] > 0 else (1, 1, 0, 0)
    else:
        box = (*s["xy"].min(axis=0), *s["xy"].max(axis=0))
    good = all(map(math.isfinite, box)) and box[0] <= box[2] and box[1] <= box[3]
    return (lambda *cell: side(s, *cell)), tuple(map(float, box))


def _bounds(level: int, x: int, y: int) -> tuple[float, float, float, float]:
    size = 2.0**level
    return x * size, y * size, (x + 1) * size, (y + 1) * size


def _children(level: int, x: int, y: int) -> list[tuple[int, int, int]]:
    return [(level - 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]


def cells_of(shape: dict, most: int = MOST_CELLS) -> list[tuple[int, int, int, bool]]:
    """(level, x, y, inner) of cells that cover a shape: border cells are cut, the largest first, while there may be more."""
    if (prepared := _prepared(shape)) is None:
        return []
    side, (x0, y0, x1, y1) = prepared
    level = max(LEAST_LEVEL, math.ceil(math.log2(max(x1 - x0, y1 - y0, 2.0**LEAST_LEVEL))))
    size = 2.0**level
    todo, done = [], []

    def judge(cell: tuple[int, int, int]) -> None:
        if (where := side(*_bounds(*cell))) == IN or where == ON and cell[0] <= LEAST_LEVEL:
            done.append((*cell, where == IN))
        elif where == ON:
            heapq.heappush(todo, (-cell[0], *cell))

    for x in range(math.floor(x0 / size), math.floor(x1 / size) + 1):
        for y in range(math.floor(y0 / size), math.floor(y1 / size) + 1):
            judge((level, x, y))
    while todo and len(todo) + len(done) + 3 <= most:
        for child in _children(*heapq.heappop(todo)[1:]):
            judge(child)
    return [*done, *((*cell, False) for _, *cell in todo)]


def _mapped(df: DataFrame, of: str, make, schema: str) -> DataFrame:
    """Rows (number, *cell) that make gives for the struct column of and the row's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows = [(r["number"], *cell) for r in batch.to_pylist() for cell in make(r[of], r)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def cover(shapes: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """CELLS of shapes, of number and shape: a struct of type, x, y, w, h, rx, ry and points."""
    return _mapped(shapes.select("number", "shape"), "shape", lambda s, _: cells_of(s, most), CELLS)


def probes(px: Column, py: Column, levels: list[int]) -> Column:
    """A point's cell of each level."""
    number = lambda c, k: F.floor(c / 2.0**k).cast("long")
    return F.array(*(F.struct(F.lit(k).alias("level"), number(px, k).alias("cell_x"), number(py, k).alias("cell_y")) for k in levels))


def levels_of(cells: DataFrame) -> list[int]:
    """Levels in use: no more than numbers have exponents."""
    return sorted(r.level for r in cells.select("level").distinct().collect())


def subdivided(cells: DataFrame, shapes: DataFrame, points: DataFrame, most: int = HOT_POINTS, turns: int = HOT_TURNS) -> DataFrame:
    """cells of which none that can be cut holds more than most points (px, py) any more: hot ones give way to those of their quarters that touch their shape.

    Points are counted by cell before they are shuffled, once a turn; cells of a point that occurs so often itself stay as they are at the least level.
    """

    def cut(shape: dict, row: dict) -> list[tuple[int, int, int, bool]]:
        side, out = _prepared(shape)[0], []
        for child in _children(row["level"], row["cell_x"], row["cell_y"]):
            if row["inner"] or (where := side(*_bounds(*child))) != OUT:
                out.append((*child, row["inner"] or where == IN))
        return out

    key = ["level", "cell_x", "cell_y"]
    for _ in range(turns):
        levels = levels_of(cells)
        counts = points.select(F.inline(probes(F.col("px"), F.col("py"), levels))).groupBy(*key).agg(F.count("*").alias("n")) if levels else None
        if counts is None or (hot := counts.where((F.col("n") > most) & (F.col("level") > LEAST_LEVEL)).join(cells.select(*key).distinct(), key, "left_semi")).isEmpty():
            return cells
        hot = hot.select(*key).withColumn("hot", F.lit(True))
        marked = cells.join(hot, key, "left")
        quarters = _mapped(marked.where("hot").join(shapes.select("number", "shape"), "number").select("number", *key, "inner", "shape"), "shape", cut, CELLS)
        from ..sinks.tables import written

        cells = written(marked.where("hot IS NULL").select("number", *key, "inner").unionByName(quarters), "cells")
    return cells

"""Connected regions of grids that no single task could hold.

A grid is cut into square tiles. Each tile labels its own cells, by runs, with the first cell of their region in reading order. Cells on either side
of a seam link the labels of their tiles; links are contracted to their smallest label by joins; and only regions that touch a seam are relabelled.
Where only regions are asked for, cells stay runs, tiles are labelled as they stream past, many at once, and what leaves them is a row a region.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.tables import discard, written
from .kernels import linked, runs

TILE = 512
#: Parts that the links of one node are dealt over while the smallest is sought.
SALTS = 32
_HALF = 1 << 31
#: Rows that a task takes at once, about, when it labels tiles as they stream past.
ROWS = 20_000


def label_of(x: Column, y: Column) -> Column:
    """Place in reading order as one number: greater y first, then x."""
    return y.cast("long") * (1 << 32) + (x.cast("long") + _HALF)


def first_cell(label: Column) -> tuple[Column, Column]:
    """x and y of a label."""
    return F.pmod(label, F.lit(1 << 32)) - _HALF, F.shiftright(label, 32)


def _least_beside(edges: DataFrame) -> DataFrame:
    """edges (a, b) with the smallest b of their a. A node of many links is many parts, each with its own smallest; those few are compared, and the result goes back to the parts."""
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = edges.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy(F.col("a").alias("a_")).agg(F.min("m").alias("least"))
    dealt = parts.join(least, F.col("a") == F.col("a_")).select(F.col("a").alias("a_"), F.col("salt").alias("salt_"), "least")
    return edges.join(dealt, (F.col("a") == F.col("a_")) & (F.col("salt") == F.col("salt_"))).select("a", "b", "least")


def contracted(links: DataFrame) -> DataFrame:
    """(node, root) of every node that links (a, b) tie to another: the smallest that any path of links leads to.

    Turns of linking greater neighbours to the smallest, then smaller ones and the node itself, until nothing changes; each turn is a written table. Links
    may repeat and go either way; those to null or to the node itself are none.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges, last = written(links.dropna().where("a <> b").select(a, b).distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last, before = state, edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least_beside(both).where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b")).distinct()
        small = _least_beside(large).select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))))
        edges = written(small.where("a <> b").distinct(), "links")
        discard(before)


def regions(cells: DataFrame, keys: list[str], diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """cells, of keys, x and y, with region: the label_of() the first cell of their region in reading order; neighbours at the four sides, or all eight if diagonal.

    Cells that repeat are one; keys may be null, x and y not. A task holds tile * tile cells of one grid, however large that is.
    """
    if bad := {"region", "tile_x_", "tile_y_"} & set(cells.columns):
        raise ValueError(f"columns of these names are made here: {', '.join(sorted(bad))}")

    def run(group: pa.Table) -> pa.Table:
        x, y = (group.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        mask = np.zeros((tile, tile), bool)
        mask[y % tile, x % tile] = True
        found = runs(mask, diagonal=diagonal)
        first = (found.row[found.region] + y[0] // tile * tile << 32) + found.start[found.region] + x[0] // tile * tile + _HALF
        # The run of a cell: the last that begins at it or before, in reading order.
        label = first[np.searchsorted(found.row * tile + found.start, y % tile * tile + x % tile, "right") - 1]
        return group.drop_columns(["tile_x_", "tile_y_"]).append_column("region", pa.array(label, pa.int64()))

    place = lambda c: F.floor(F.col(c) / tile).cast("long")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    tiled = cells.withColumns({"tile_x_": place("x"), "tile_y_": place("y")}).groupBy(*keys, "tile_x_", "tile_y_").applyInArrow(run, f"{schema}, region long")
    local = written(tiled, "tiles")

    node = _node(keys)
    at_edge = F.pmod("x", F.lit(tile)).isin(0, tile - 1) | F.pmod("y", F.lit(tile)).isin(0, tile - 1)
    root = _roots(local.where(at_edge).select(_grid(keys), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), node.alias("node")).distinct(), diagonal, tile)
    root = root.select(F.col("node").alias("node_"), F.col("root.region" if keys else "root").alias("root_"))
    return local.join(root, node == F.col("node_"), "left").select(*cells.columns, F.coalesce("root_", "region").alias("region"))


def _grid(keys: list[str]) -> Column:
    return (F.struct(*keys) if keys else F.lit(0)).alias("grid")


def _node(keys: list[str]) -> Column:
    """What links tie together: the label alone where there is one grid, as numbers are compared and hashed faster than structs."""
    return F.struct(*keys, "region") if keys else F.col("region")


def _roots(edge: DataFrame, diagonal: bool, tile: int) -> DataFrame:
    """contracted() of the links over seams between cells (grid, x, y, node) at the edges of tiles."""
    steps = [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if diagonal else [])]
    step = F.inline(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps)))
    beside = edge.select("grid", "x", "y", F.col("node").alias("a"), step)
    beyond = (F.floor(F.col("x") / tile) != F.floor((F.col("x") + F.col("dx")) / tile)) | (F.floor(F.col("y") / tile) != F.floor((F.col("y") + F.col("dy")) / tile))
    beside = beside.where(beyond).select("grid", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "a")
    # Without diagonals, what is beyond a seam is first in its tile's row or column.
    other = edge if diagonal else edge.where((F.pmod("x", F.lit(tile)) == 0) | (F.pmod("y", F.lit(tile)) == 0))
    return contracted(beside.join(other.withColumnRenamed("node", "b"), ["grid", "x", "y"]).select("a", "b").distinct())


class _Rows(NamedTuple):
    """Runs of cells of tiles, by tile, row and start; of each: its tile's number, place (in tiles) and its own within the tile."""

    number: np.ndarray
    tile_x: np.ndarray
    tile_y: np.ndarray
    y: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def take(self, which) -> _Rows:
        return _Rows(*(v[which] for v in self))

    def merged(self, tile: int) -> _Rows:
        """The same cells as runs that are apart: those that overlap or meet are one."""
        row = (self.number * (tile + 1) + self.y) * (tile + 1)
        reach = np.maximum.accumulate(row + self.end)
        first = np.flatnonzero(np.append(True, (row + self.start)[1:] > reach[:-1]))
        out = self.take(first)
        return out._replace(end=np.maximum.reduceat(self.end, first))


def _tile_regions(rows: _Rows, tile: int, diagonal: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """Of each region of whole tiles: the number of its tile, and its label, area, box and cells at the tile's edge, as labels of these cells."""
    found = linked(rows.number * (tile + 1) + rows.y, rows.start, rows.end, tile, diagonal)
    root = found.region == np.arange(len(found.region))
    first, region = np.flatnonzero(root), (np.cumsum(root) - 1)[found.region]
    n = len(first)
    left, top = rows.tile_x * tile, rows.tile_y * tile + rows.y
    x0, x1, y1 = (left + rows.start)[first], (left + rows.end)[first], top[first] + 1
    np.minimum.at(x0, region, left + rows.start)
    np.maximum.at(x1, region, left + rows.end)
    np.maximum.at(y1, region, top + 1)
    area = np.bincount(region, rows.end - rows.start, n).astype(np.int64)
    label = (top << 32) + left + _HALF
    # All cells of a run in the first or the last row, else those in the first and the last column.
    outer = (rows.y == 0) | (rows.y == tile - 1)
    size = np.where(outer, rows.end - rows.start, 0)
    at = np.repeat(np.arange(len(size)), size)
    x = rows.start[at] + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    begins, ends = np.flatnonzero(~outer & (rows.start == 0)), np.flatnonzero(~outer & (rows.end == tile))
    at, x = np.concatenate([at, begins, ends]), np.concatenate([x, rows.start[begins], rows.end[ends] - 1])
    order = np.argsort(region[at], kind="stable")
    places = np.concatenate([[0], np.cumsum(np.bincount(region[at], minlength=n))]).astype(np.int32)
    edge = pa.ListArray.from_arrays(pa.array(places), pa.array((label[at] + x)[order]))
    return rows.number[first], [*(pa.array(v) for v in ((label + rows.start)[first], area, x0, top[first], x1, y1)), edge]


def _labelled_tiles(cells: DataFrame, keys: list[str], end: str | None, diagonal: bool, tile: int) -> DataFrame:
    """Keys, region, area, x0, y0, x1, y1 and edge of each tile's regions. A task holds some ROWS rows, and the runs of a tile that isn't over."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    place = lambda c: F.floor(c / tile).cast("long")
    stop = F.col(end).cast("long") if end else x + 1
    spans = cells.select(*keys, x.alias("from_"), stop.alias("to_"), place(y).alias("tile_y_"), F.pmod(y, F.lit(tile)).alias("y_")).where("from_ < to_")
    spans = spans.select("*", F.explode(F.sequence(place(F.col("from_")), place(F.col("to_") - 1))).alias("tile_x_"))
    left = F.col("tile_x_") * tile
    spans = spans.select(*keys, "tile_x_", "tile_y_", "y_", (F.greatest("from_", left) - left).alias("start_"), (F.least("to_", left + tile) - left).alias("end_"))
    order = Window.partitionBy(*keys, "tile_x_", "tile_y_").orderBy("y_", "start_")
    spans = spans.withColumn("first_", F.row_number().over(order) == 1)
    places = ("tile_x_", "tile_y_", "y_", "start_", "end_")
    names = [*keys, "region", "area", "x0", "y0", "x1", "y1", "edge"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs of the tile that isn't over, and its keys.
        rest, rest_keys = None, None

        def regions_of(rows: _Rows, own: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(rows.number):
                number, columns = _tile_regions(rows, tile, diagonal)
                yield from pa.Table.from_arrays([*(c.take(pa.array(number)) for c in own.columns), *columns], names=names).to_batches()

        for chunk in chunks(batches):
            first = chunk.column("first_").to_numpy()
            number = np.cumsum(first)
            rows = _Rows(number, *(chunk.column(c).to_numpy() for c in places))
            # Tile 0 is the one that the last chunk left; without one, numbers begin at 1.
            own = chunk.select(keys).filter(pa.array(first))
            if rest is not None:
                rows = _Rows(*(np.concatenate(x) for x in zip(rest, rows, strict=True)))
            own = pa.concat_tables([chunk.select(keys).slice(0, 1) if rest_keys is None else rest_keys, own])
            rows = rows.merged(tile)
            last = rows.number == rows.number[-1]
            yield from regions_of(rows.take(~last), own)
            rest = rows.take(last)
            rest_keys = own.slice(int(rest.number[0]), 1)
            rest = rest._replace(number=np.zeros_like(rest.number))
        if rest is not None:
            yield from regions_of(rest, rest_keys)

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cells.select(*keys).schema)
    return spans.select(*keys, *places, "first_").mapInArrow(run, f"{kept}region long, area long, x0 long, y0 long, x1 long, y1 long, edge array<long>")


def region_table(cells: DataFrame, keys: list[str], diagonal: bool = False, tile: int = TILE, end: str | None = None) -> DataFrame:
    """One row a region: keys, first_x, first_y, area, and its box x0, y0, x1, y1, half open. Tiles give a row a region, so a region of any size is many tasks'.

    Cells that repeat are one. With end, a column, rows are runs of cells from x up to that, without it; empty ones are nothing.
    """
    if bad := {"region", "area", "x0", "y0", "x1", "y1", "edge", "tile_x_", "tile_y_", "y_", "start_", "end_", "from_", "to_", "first_"} & set(keys):
        raise ValueError(f"columns of these names are made here: {', '.join(sorted(bad))}")
    local = written(_labelled_tiles(cells, keys, end, diagonal, tile), "tiles")
    node = _node(keys)
    x, y = first_cell(F.col("cell"))
    edge = local.select(_grid(keys), node.alias("node"), F.explode("edge").alias("cell")).select("grid", x.alias("x"), y.alias("y"), "node")
    root = _roots(edge, diagonal, tile).select(F.col("node").alias("node_"), F.col("root.region" if keys else "root").alias("root_"))
    found = local.drop("edge").join(root, node == F.col("node_"), "left").withColumn("region", F.coalesce("root_", "region"))
    x, y = (cells.schema[c].dataType for c in ("x", "y"))
    box = [F.min("x0").cast(x).alias("x0"), F.min("y0").cast(y).alias("y0"), F.max("x1").cast(x).alias("x1"), F.max("y1").cast(y).alias("y1")]
    first = first_cell(F.col("region"))
    return found.groupBy(*keys, "region").agg(F.sum("area").alias("area"), *box).select(*keys, first[0].alias("first_x"), first[1].alias("first_y"), "area", "x0", "y0", "x1", "y1")


def reachable(cells: DataFrame, keys: list[str], diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """cells, of keys, x, y, walkable and start, with reached: by steps over walkable cells from a walkable start. Null flags are false."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = regions(cells.where(yes("walkable")), keys, diagonal, tile)
    started = found.where(yes("start")).groupBy(*keys, "region").agg(F.lit(True).alias("hit_")).select(F.struct(*keys, "region").alias("node_"), "hit_")
    walked = found.join(started, F.struct(*keys, "region") == F.col("node_"), "left").select(*cells.columns, yes("hit_").alias("reached"))
    return walked.unionByName(cells.where(~yes("walkable")).withColumn("reached", F.lit(False)))

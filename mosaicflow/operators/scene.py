"""Scene geometry: walkability, zones, depth order, placement of props, reachability.

Rectangles are given by their top left corner, ellipses by their centre, and boundaries are inside. Shapes meet points in an equi-join on
cells of mixed sizes, not by testing every pair, so neither side is broadcast for the join's sake.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.tables import written
from . import covering, regions

#: Side of the tiles of a canvas that tasks draw.
PREVIEW_TILE = 64
_TILES = "scene_id long, tile_x int, tile_y int, rgba binary"
LAYERS = ["base", "ground", "props", "actors", "foreground", "debug", "hud"]


def inside(px: Column, py: Column, s: str = "") -> Column:
    """Whether a point is in a rect, ellipse or polygon of the columns type, x, y, w, h, rx, ry and points."""
    c = lambda name: F.col(f"{s}{name}")
    rect = (px >= c("x")) & (px <= c("x") + c("w")) & (py >= c("y")) & (py <= c("y") + c("h"))
    ellipse = ((px - c("x")) / c("rx")) * ((px - c("x")) / c("rx")) + ((py - c("y")) / c("ry")) * ((py - c("y")) / c("ry")) <= 1
    points = c("points")
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    edges = F.arrays_zip(points.alias("p"), after.alias("q"))
    cross = lambda e: (e["q"]["x"] - e["p"]["x"]) * (py - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (px - e["p"]["x"])
    on = lambda e: (cross(e) == 0) & px.between(F.least(e["p"]["x"], e["q"]["x"]), F.greatest(e["p"]["x"], e["q"]["x"])) & py.between(F.least(e["p"]["y"], e["q"]["y"]), F.greatest(e["p"]["y"], e["q"]["y"]))
    crossed = lambda e: ((e["p"]["y"] > py) != (e["q"]["y"] > py)) & (px < e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) * (py - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]))
    polygon = F.exists(edges, on) | (F.size(F.filter(edges, crossed)) % 2 == 1)
    return F.coalesce(F.when(c("type") == "rect", rect).when(c("type") == "ellipse", ellipse).when(c("type") == "polygon", polygon), F.lit(False))


def hits(points: DataFrame, shapes: DataFrame, map_key: str | None = None, most_cells: int = covering.MOST_CELLS, hot: int = covering.HOT_POINTS) -> DataFrame:
    """Points beside each shape they are in: columns of points, then shape_id and role. A shape without extent is in no cell.

    Shapes are covered by at most most_cells cells each; only points in cells on a border are tested. A cell of more than hot points is cut further.
    """
    columns = ("id", "role", "type", "x", "y", "w", "h", "rx", "ry", "points")
    s = shapes.select(F.struct(*[F.col(c) for c in columns]).alias("s"), *([F.col(map_key).alias("map_key_")] if map_key else []))
    # Numbers by content, so that a task that runs again gives the same; equal shapes of one map share theirs.
    s = s.withColumn("number", F.xxhash64(F.to_json("s"), *(["map_key_"] if map_key else [])))
    numbered = written(s.groupBy("number", *(["map_key_"] if map_key else [])).agg(F.collect_list("s").alias("all")), "shapes")
    shape = numbered.select("number", F.col("all")[0].alias("shape"))
    cells = covering.subdivided(written(covering.cover(shape, most_cells), "cells"), shape, points, hot)
    levels = covering.levels_of(cells)
    if not levels:
        return points.where(F.lit(False)).select("*", *(F.lit(None).cast("string").alias(c) for c in ("shape_id", "role")))
    wanted = cells.join(numbered, "number").select("level", "cell_x", "cell_y", "inner", "all", *(["map_key_"] if map_key else []))
    p = points.select(F.struct("*").alias("p"), F.inline(covering.probes(F.col("px"), F.col("py"), levels)))
    joined = p.join(wanted, ["level", "cell_x", "cell_y"])
    if map_key:
        joined = joined.where(F.col("p")[map_key] == F.col("map_key_"))
    found = joined.select("p", "inner", F.explode("all").alias("s"))
    return found.where(F.col("inner") | inside(F.col("p.px"), F.col("p.py"), "s.")).select("p.*", F.col("s.id").alias("shape_id"), F.col("s.role").alias("role"))


def walkable(points: DataFrame, shapes: DataFrame, point_key: str, map_key: str | None = None) -> DataFrame:
    """points with walkable: in a walk bound and in no blocker."""
    found = hits(points.select(point_key, "px", "py", *([map_key] if map_key else [])), shapes.where("role <> 'zone'"), map_key)
    by_point = found.groupBy(F.col(point_key).alias("key_")).agg(F.bool_or(F.col("role") == "walk").alias("in_"), F.bool_or(F.col("role") == "block").alias("out_"))
    return points.join(by_point, F.col(point_key) == F.col("key_"), "left").withColumn("walkable", F.coalesce(F.col("in_") & ~F.col("out_"), F.lit(False))).drop("key_", "in_", "out_")


def render_order(items: DataFrame) -> DataFrame:
    """items, of layer, sort_y and id, with draw_order from 1: by layer, then depth, then id. Drawing later covers."""
    from pyspark.sql import Window

    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")), F.lit(0)), F.lit(len(LAYERS) + 1))
    # One scene is drawn in one place; where there are more, scene_id keeps them apart.
    keys = ["scene_id"] if "scene_id" in items.columns else []
    return items.withColumn("draw_order", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(rank, "sort_y", "id")))


def prop_boxes(props: DataFrame) -> DataFrame:
    """props with the box they are drawn in: x is the middle of their base and y its bottom."""
    return props.withColumns({"left": F.col("x") - F.col("w") / 2, "top": F.col("y") - F.col("h"), "right": F.col("x") + F.col("w") / 2, "bottom": F.col("y")})


def missing_images(props: DataFrame, images: DataFrame) -> DataFrame:
    """Props whose imageKey no image has."""
    return props.join(images.select("imageKey").distinct(), "imageKey", "left_anti")


def with_metadata(props: DataFrame, metadata: DataFrame) -> DataFrame:
    """Props with their pipeline metadata, by asset."""
    return props.join(metadata, "asset")


def blocker_shape(obstacle: Column) -> Column:
    """ellipse or rect by kind of obstacle; polygon for others, that neither fits."""
    from ..functions.catalog import OBSTACLE_SHAPES

    kinds = F.create_map(*[F.lit(x) for pair in OBSTACLE_SHAPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.lower(obstacle)), F.lit("polygon"))


def reachable(cells: DataFrame, keys: list[str], tile: int = regions.TILE) -> DataFrame:
    """cells, of keys, gx, gy, walkable and start, with reached: by steps to the four sides from a start over walkable cells. Maps of any size; see regions."""
    named = cells.withColumnsRenamed({"gx": "x", "gy": "y"})
    return regions.reachable(named, keys, tile=tile).withColumnsRenamed({"x": "gx", "y": "gy"})


def validation(maps: DataFrame) -> DataFrame:
    """Maps with problems: sizes that differ, props without alpha, frames that touch edges, or collision data that doesn't parse.

    Columns asked for: width, height, expected_width, expected_height, has_alpha, edge_touch_frames (text), collision (text).
    """
    from ..sources.scenes import parse_collision

    parsed = parse_collision(F.col("collision"))
    rules = {
        "size": ~(F.col("width").eqNullSafe(F.col("expected_width")) & F.col("height").eqNullSafe(F.col("expected_height"))),
        "alpha": ~F.coalesce("has_alpha", F.lit(False)),
        "edge_touch": F.coalesce(F.col("edge_touch_frames"), F.lit("")) != "",
        "collision": F.col("collision").isNotNull() & (parsed.isNull() | parsed["mapSize"].isNull()),
    }
    return maps.withColumn("problems", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def preview(items: DataFrame, width: int, height: int, tile: int = PREVIEW_TILE) -> DataFrame:
    """(scene_id, width, height, rgba): items of one scene, with left, top, item_width, item_height and rgba, drawn in order.

    A scene is drawn by tiles of its canvas, which go to tasks of their own with the items that they see, sorted by Spark. A task draws them as they come:
    it holds one tile and one batch, however many items a scene has.
    """
    from ..sources.rasters import array_of, bound_batches
    from .frames import _batch
    from .kernels import paste

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, canvas = None, None
        done = lambda: _batch([(*now, canvas.tobytes())], _TILES)
        for batch in batches:
            for *at, left, top, w, h, rgba in zip(*(batch.column(c).to_pylist() for c in ("scene_id", "tile_x", "tile_y", "left", "top", "item_width", "item_height", "rgba")), strict=True):
                x, y = at[1] * tile, at[2] * tile
                if at != now:
                    if now is not None:
                        yield done()
                    now, canvas = at, np.zeros((min(tile, height - y), min(tile, width - x), 4), np.uint8)
                paste(canvas, array_of(w, h, rgba), int(left) - x, int(top) - y, masked=True)
        if now is not None:
            yield done()

    def join(group: pa.Table) -> pa.Table:
        canvas = np.zeros((height, width, 4), np.uint8)
        for x, y, rgba in zip(*(group.column(c).to_pylist() for c in ("tile_x", "tile_y", "rgba")), strict=True):
            part = canvas[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile]
            part[...] = np.frombuffer(rgba, np.uint8).reshape(part.shape)
        return pa.Table.from_batches([_batch([(group.column("scene_id")[0].as_py(), width, height, canvas.tobytes())], "scene_id long, width int, height int, rgba binary")])

    def tiles(start: str, size: str, whole: int) -> Column:
        """Numbers of the tiles that an item reaches; an item beside the canvas goes to the nearest, so that its scene has a row."""
        first, last = F.col(start).cast("int"), F.col(start).cast("int") + F.col(size) - 1
        place = lambda c: F.floor(F.least(F.greatest(c, F.lit(0)), F.lit(whole - 1)) / tile).cast("int")
        return F.sequence(place(first), F.greatest(place(first), place(last)))

    bound_batches(items.sparkSession)
    seen = items.withColumn("tile_x", F.explode(tiles("left", "item_width", width))).withColumn("tile_y", F.explode(tiles("top", "item_height", height)))
    keys = ["scene_id", "tile_x", "tile_y"]
    drawn = seen.repartition(*keys).sortWithinPartitions(*keys, "draw_order").mapInArrow(draw, _TILES)
    return drawn.groupBy("scene_id").applyInArrow(join, "scene_id long, width int, height int, rgba binary")

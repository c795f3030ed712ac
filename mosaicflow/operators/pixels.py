"""Per-pixel filters over the pixel relation, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import RING_BLACK, RING_THRESHOLD


def key_distance2(r: Column, g: Column, b: Column) -> Column:
    """Squared distance from the chroma key."""
    return (r - 255) * (r - 255) + g * g + (b - 255) * (b - 255)


def near_key(threshold: float) -> Column:
    """Strictly nearer than threshold; nothing is for a threshold of 0 or less."""
    return (key_distance2(F.col("r"), F.col("g"), F.col("b")) < threshold * threshold) & F.lit(threshold > 0)


def _cleared(pixels: DataFrame, gone: Column) -> DataFrame:
    return pixels.withColumns({c: F.when(gone, 0).otherwise(F.col(c)) for c in "rgba"})


def chroma_key(pixels: DataFrame, threshold: float = 100) -> DataFrame:
    return _cleared(pixels, (F.col("a") != 0) & near_key(threshold))


def split_cells(pixels: DataFrame, width: int, height: int, rows: int, cols: int, trim_px: int = 0) -> DataFrame:
    """Pixels with grid_row and grid_col, in their cell's coordinates; what is left over at the right and bottom is dropped.

    trim_px goes from each side of cells that are longer than twice that both ways.
    """
    if rows < 1 or cols < 1:
        raise ValueError("a grid needs rows and columns")
    w, h = width // cols, height // rows
    t = trim_px if trim_px > 0 and w > 2 * trim_px and h > 2 * trim_px else 0
    inside = pixels.where((F.col("x") < cols * w) & (F.col("y") < rows * h))
    x, y = F.col("x") % w - t, F.col("y") % h - t
    cells = inside.withColumns({"grid_row": F.floor(F.col("y") / h).cast("int"), "grid_col": F.floor(F.col("x") / w).cast("int"), "x": x, "y": y})
    return cells.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < w - 2 * t) & (F.col("y") < h - 2 * t))


def grid_cells(sheets: DataFrame, rows: int, cols: int) -> DataFrame:
    """sheets, of width and height, with a row for each cell: grid_row, grid_col and its half-open box in the sheet."""
    if rows < 1 or cols < 1:
        raise ValueError("a grid needs rows and columns")
    w, h = F.floor(F.col("width") / cols).cast("int"), F.floor(F.col("height") / rows).cast("int")
    cells = sheets.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    cells = cells.withColumns({"grid_row": F.floor(F.col("i") / cols).cast("int"), "grid_col": F.col("i") % cols}).drop("i")
    return cells.withColumns({"box_x0": F.col("grid_col") * w, "box_y0": F.col("grid_row") * h, "box_x1": (F.col("grid_col") + 1) * w, "box_y1": (F.col("grid_row") + 1) * h})


def clean_ring(cells: DataFrame, width: int, height: int, depth: int = 3) -> DataFrame:
    """Cells of width and height with black and near-key pixels cleared in the ring of depth along their edges."""
    ring = F.least("x", "y", F.lit(width - 1) - F.col("x"), F.lit(height - 1) - F.col("y")) < depth
    black = (F.col("r") < RING_BLACK) & (F.col("g") < RING_BLACK) & (F.col("b") < RING_BLACK)
    return _cleared(cells, ring & (F.col("a") != 0) & (black | near_key(RING_THRESHOLD)))


def visible_boxes(cells: DataFrame, *keys: str) -> DataFrame:
    """Number of visible pixels and their box, by keys; boxes are half open, and null where nothing is visible."""
    seen = F.col("a") > 0
    pick = lambda agg, c: agg(F.when(seen, F.col(c)))
    return cells.groupBy(*keys).agg(F.count_if(seen).alias("visible"), pick(F.min, "x").alias("x0"), pick(F.min, "y").alias("y0"), (pick(F.max, "x") + 1).alias("x1"), (pick(F.max, "y") + 1).alias("y1"))

"""Column functions: seeds, slugs, defaults and placement arithmetic. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_SLUG = "sprite"


def stable_seed(target: Column, mode: Column, prompt: Column, role: Column) -> Column:
    """The first eight hex digits of SHA-256 of target|mode|prompt|role, as a number; a missing role or prompt is empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (target, mode, prompt, role)]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def slug(text: Column) -> Column:
    """Lower-case words of letters and digits joined by hyphens; EMPTY_SLUG for none."""
    joined = F.regexp_replace(F.lower(text), "[^a-zA-Z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^-+|-+$", ""), F.lit("")), F.lit(EMPTY_SLUG))


def or_default(value: Column, default) -> Column:
    """value unless it is null, zero or empty."""
    empty = F.coalesce(value.cast("string"), F.lit("")).isin("", "0", "0.0")
    return F.when(~empty, value).otherwise(default if isinstance(default, Column) else F.lit(default))


def floor_div(a: Column, b: Column) -> Column:
    """Division that rounds down, for negative numbers too."""
    return F.floor(a / b)


def default_cell_size(cell_size: Column, rows: Column, cols: Column) -> Column:
    return or_default(cell_size, F.when((rows == 4) & (cols == 4), 96).otherwise(128))


def edge_touch(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: int = 0) -> Column:
    """Whether a box comes within margin of an edge; a null box doesn't."""
    return F.coalesce((x0 <= margin) | (y0 <= margin) | (x1 >= width - margin) | (y1 >= height - margin), F.lit(False))


def placement(width: Column, height: Column, cell: int, fit: float, align: str = "center", max_width: Column | None = None, max_height: Column | None = None) -> dict[str, Column]:
    """new_w, new_h, paste_x and paste_y of a frame in a cell, in doubles and in this order of operations.

    With the largest width and height of the sheet, all its frames have one scale. bottom and feet stand on a pad; an empty frame is at 0, 0.
    """
    size = F.lit(float(cell))
    own = F.least(size / width, size / height) * F.lit(fit)
    shared = F.least(size / max_width, size / max_height) * F.lit(fit) if max_width is not None else F.lit(None).cast("double")
    scale = F.coalesce(F.nullif(shared, F.lit(0.0)), own)
    there = (width > 0) & (height > 0)
    new_w, new_h = (F.when(there, F.greatest(F.lit(1), F.floor(d * scale).cast("int"))).otherwise(0) for d in (width, height))
    pad = max(0, int(cell * (1 - fit) * 0.5))
    y = F.lit(cell) - new_h - pad if align in ("bottom", "feet") else F.floor((F.lit(cell) - new_h) / 2).cast("int")
    return {"new_w": new_w, "new_h": new_h, "paste_x": F.when(there, F.floor((F.lit(cell) - new_w) / 2).cast("int")).otherwise(0), "paste_y": F.when(there, y.cast("int")).otherwise(0)}

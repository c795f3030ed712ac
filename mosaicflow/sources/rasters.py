"""Rasters as rows: (sheet_id, width, height, rgba), rgba in reading order, and their pixels as a relation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import png

RASTERS = "sheet_id long, width int, height int, rgba binary"
PIXELS = "sheet_id long, x int, y int, r int, g int, b int, a int"

#: Bytes and rows of the Arrow batches that Spark hands to a task, and of the stacks that kernels take at once: what a task holds follows from these, not from its input.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000
STACK_BYTES, STACK_ROWS = 1 << 20, 500


def array_of(width: int, height: int, rgba: bytes) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def arrays(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for width, height, rgba in zip(*(batch.column(k).to_pylist() for k in ("width", "height", "rgba")), strict=True):
        yield array_of(width, height, rgba)


def stacks(batch: pa.RecordBatch, pixels: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch of rasters in stacks of one size, (n, height, width, 4), each with its rows. pixels: how many a raster becomes, where that is more than it has."""
    alike: dict[tuple[int, int], list[int]] = {}
    for i, size in enumerate(zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True)):
        alike.setdefault(size, []).append(i)
    for (width, height), rows in alike.items():
        n = max(1, min(STACK_ROWS, STACK_BYTES // max(1, 4 * width * height, 4 * pixels)))
        for k in range(0, len(rows), n):
            own = batch.take(pa.array(rows[k : k + n]))
            yield own, np.frombuffer(b"".join(own.column("rgba").to_pylist()), np.uint8).reshape(own.num_rows, height, width, 4)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, not only their rows; rows by less than Spark does, as what is made of a row may be larger than the row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What is made of a batch, batch by batch.
Run = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


class Made(NamedTuple):
    """RASTERS, none of them null or empty, that are made in the pass that takes them: their pixels never leave the worker, and a task has no second one."""

    rows: DataFrame
    make: Run

    def rasters(self) -> DataFrame:
        return mapped(self.rows, self.make, RASTERS)


def mapped(df: DataFrame | Made, run: Run, schema: str) -> DataFrame:
    """What run makes of each batch, in batches that are bounded; run should give what it made of each of a batch's stacks before it takes the next."""
    rows, make = df if isinstance(df, Made) else (df, lambda batch: iter((batch,)))
    bound_batches(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in make(batch):
                yield from run(own)

    return rows.mapInArrow(each, schema)


def plain(rasters: DataFrame | Made) -> DataFrame | Made:
    """Rasters without what other columns they have."""
    return rasters if isinstance(rasters, Made) else rasters.select("sheet_id", "width", "height", "rgba")


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """PNG files below a path, with their path: decoded to RGBA as they are, colours under clear pixels included.

    A file that isn't a PNG of 8 bits fails the read. sheet_id is the hash of the path.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png.decode(x) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sheet_id"), batch.column("path"), pa.array([x.shape[1] for x in found], pa.int32()), pa.array([x.shape[0] for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())],
                names=["sheet_id", "path", "width", "height", "rgba"],
            )

    return files.select(F.xxhash64("path").alias("sheet_id"), "path", "content").mapInArrow(run, "sheet_id long, path string, width int, height int, rgba binary")


def read_image_source(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's image source, for pictures in any format it reads, with its B, G, R, A order turned round."""
    image = spark.read.format("image").load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, height, width, data in zip(*(batch.column(k).to_pylist() for k in ("nChannels", "height", "width", "data")), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(height, width, n)
                rgb = x[..., 2::-1] if n > 2 else np.repeat(x, 3, axis=-1)
                alpha = x[..., 3:] if n == 4 else np.full((height, width, 1), 255, np.uint8)
                out.append(np.concatenate([rgb, alpha], axis=-1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("sheet_id"), batch.column("path"), batch.column("width"), batch.column("height"), pa.array(out, pa.binary())], names=["sheet_id", "path", "width", "height", "rgba"])

    rows = image.select(F.xxhash64("origin").alias("sheet_id"), F.col("origin").alias("path"), "width", "height", "nChannels", "data")
    return rows.mapInArrow(run, "sheet_id long, path string, width int, height int, rgba binary")


def read_prompt(spark: SparkSession, path: str | None) -> str | None:
    """A prompt file's text, or null if there is none at the path."""
    if path is None:
        return None
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    try:
        row = files.load(path).select(F.decode("content", "UTF-8").alias("text")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row.text if row else None


def keyed_by(rasters: DataFrame, key: str) -> DataFrame:
    """RASTERS with a column as sheet_id, of a table that has more."""
    return rasters.select(F.col(key).alias("sheet_id"), "width", "height", "rgba")


def sums(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, visible and content of each raster: the number of pixels that aren't clear, and the sum of their place times weighted channels."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, stack in stacks(batch):
            flat = stack.reshape(own.num_rows, -1, 4)
            seen = flat[..., 3] > 0
            weight = flat[..., 0] + 3 * flat[..., 1].astype(np.int64) + 7 * flat[..., 2].astype(np.int64) + flat[..., 3]
            content = (weight * seen * np.arange(flat.shape[1])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), pa.array(np.count_nonzero(seen, axis=1), pa.int64()), pa.array(content, pa.int64())], names=[*keys, "visible", "content"])

    return mapped(rasters.select(*dict.fromkeys([*keys, "width", "height", "rgba"])), run, f"{schema}, visible long, content long")


def pixels(rasters: DataFrame | Made, made: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row a pixel, of rasters or of what is made of each stack of them: a raster gives a number a pixel, which the JVM takes apart. Rasters without pixels have no rows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, stack in stacks(batch):
            numbers = np.ascontiguousarray(made(stack) if made else stack).view(">u4").astype(np.int64).reshape(own.num_rows, -1)
            ends = pa.array(np.arange(own.num_rows + 1) * numbers.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([own.column("sheet_id"), own.column("width"), pa.ListArray.from_arrays(ends, pa.array(numbers.ravel()))], names=["sheet_id", "width", "numbers"])

    found = mapped(rasters if isinstance(rasters, Made) else plain(rasters).where("length(rgba) > 0"), run, "sheet_id long, width int, numbers array<long>")
    value = lambda k: F.shiftright("v", 24 - 8 * k).bitwiseAND(255).cast("int")
    rows = found.select("sheet_id", "width", F.posexplode("numbers").alias("i", "v"))
    return rows.select("sheet_id", (F.col("i") % F.col("width")).cast("int").alias("x"), F.expr("i div width").cast("int").alias("y"), *(value(k).alias(c) for k, c in enumerate("rgba")))


# Sheets made from parts, so that SQL can make the same: SIDE pixels square, 2 x 2 cells, whole numbers only.
SIDE, CELL = 32, 16


def part_pixels(part: DataFrame) -> DataFrame:
    """PIXELS of a sheet for each part: a disc with a hole of in-between colour, a halo, a sparkle, dark and half-clear spots, shifted by its key."""
    n = F.posexplode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("pos", "i")
    p = part.select(F.col("p_partkey").alias("sheet_id"), F.col("p_size").alias("size"), n)
    p = p.select("sheet_id", "size", (F.col("i") % SIDE).cast("int").alias("x"), F.expr(f"i div {SIDE}").cast("int").alias("y"))
    key = F.pmod("sheet_id", F.lit(5)).cast("int")
    p = p.withColumns({"dx": F.col("x") % CELL - 8 - key * 2 + 4, "dy": F.col("y") % CELL - 8, "grow": F.col("size") % 8, "seven": F.pmod("sheet_id", F.lit(7)).cast("int")})
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    hole = (F.col("dx") == 0) & (F.col("dy") == 0)
    disc = (d2 <= 9 + F.col("grow")) & ~hole
    halo = hole | (d2 <= 20 + F.col("grow"))
    sparkle = F.col("dx").isin(6, 7) & F.col("dy").isin(-6, -5)
    dark = (F.col("x") % CELL == 1) & (F.col("y") % CELL == 11) & (F.col("seven") == 0)
    colour = lambda a, b, c, d, e: F.when(disc, a).when(halo, b).when(sparkle, c).when(dark, d).otherwise(e).cast("int")
    return p.select(
        "sheet_id", "x", "y", colour(40 + 3 * F.col("grow"), 180, 250, 10, 255).alias("r"), colour(F.lit(120), 80, 250, 10, 0).alias("g"), colour(F.lit(40), 180, 40, 10, 255).alias("b"),
        F.when(sparkle & (F.col("seven") == 1), 90).otherwise(255).cast("int").alias("a"),
    )


def part_rasters(part: DataFrame) -> DataFrame:
    """The same sheets as RASTERS, made in numpy."""
    return made_of_parts(part).rasters()


def made_of_parts(part: DataFrame) -> Made:
    """The same, made where they are taken."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # Cells of a sheet are alike.
        y, x = np.mgrid[:CELL, :CELL].astype(np.int16)
        byte = np.uint8
        for at in range(0, batch.num_rows, STACK_ROWS):
            own = batch.slice(at, STACK_ROWS)
            key, size = (own.column(c).to_numpy().astype(np.int64)[:, None, None] for c in ("sheet_id", "size"))
            # Numbers are small from here on.
            five, seven, grow = ((v % k).astype(np.int16) for v, k in ((key, 5), (key, 7), (size, 8)))
            dx, dy = x - 8 - five * 2 + 4, y - 8
            d2, hole = dx * dx + dy * dy, (dx == 0) & (dy == 0)
            sparkle = ((dx == 6) | (dx == 7)) & ((dy == -6) | (dy == -5))
            dark = (x == 1) & (y == 11) & (seven == 0)
            disc, halo = (d2 <= 9 + grow) & ~hole, hole | (d2 <= 20 + grow)
            cell = np.empty((own.num_rows, CELL, CELL, 4), np.uint8)
            for k, (a, b, c, d, e) in enumerate([((40 + 3 * grow).astype(byte), 180, 250, 10, 255), (byte(120), 80, 250, 10, 0), (byte(40), 180, 40, 10, 255)]):
                cell[..., k] = np.where(disc, a, np.where(halo, byte(b), np.where(sparkle, byte(c), np.where(dark, byte(d), byte(e)))))
            cell[..., 3] = np.where(sparkle & (seven == 1), byte(90), byte(255))
            picture = np.tile(cell, (1, SIDE // CELL, SIDE // CELL, 1))
            side = pa.array(np.full(own.num_rows, SIDE, np.int32))
            yield pa.RecordBatch.from_arrays([own.column("sheet_id"), side, side, pa.array([p.tobytes() for p in picture], pa.binary())], names=["sheet_id", "width", "height", "rgba"])

    return Made(part.select(F.col("p_partkey").cast("long").alias("sheet_id"), F.col("p_size").cast("int").alias("size")), make)

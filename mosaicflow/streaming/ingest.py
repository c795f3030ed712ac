"""Pictures as they arrive: a file stream through the stateless sheet plan. An extension; each sheet is independent, so there is no state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.frames import Params, checked, cut, placed
from ..sources import png

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def stream_rasters(spark: SparkSession, path: str, glob: str = "*.png", files_per_trigger: int = 100) -> DataFrame:
    """RASTERS of new PNG files below a path."""
    files = spark.readStream.format("binaryFile").schema(SOURCE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png.decode(x) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sheet_id"), pa.array([x.shape[1] for x in found], pa.int32()), pa.array([x.shape[0] for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())],
                names=["sheet_id", "width", "height", "rgba"],
            )

    return files.select(F.xxhash64("path").alias("sheet_id"), "content").mapInArrow(run, "sheet_id long, width int, height int, rgba binary")


def stream_frames(spark: SparkSession, path: str, p: Params, **options) -> DataFrame:
    """Frames of new sheets, cut, checked and placed."""
    return placed(checked(cut(stream_rasters(spark, path, **options), p), p), p).drop("rgba")


def write_frames(frames: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append frames to Parquet, of what is there now, exactly once."""
    return frames.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

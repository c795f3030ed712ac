"""Sessions of a stream of events: repeated rows dropped, late ones left out by the watermark, and windows that end after a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def stream_table(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, delay: str, row_id: str | None = None, **totals) -> DataFrame:
    """keys, session_start, session_end, n_events and totals (columns by name) of sessions: rows of one key with no more than gap between neighbours, up to gap after the last.

    Of a stream, rows older than delay before the latest time seen when the batch before theirs began are dropped, so are rows whose row_id was seen within delay, and a session is given out
    once, when the watermark has passed its end. State is what is open: one row a session, and one an id within delay. Of a table,
    nothing is late, and each row_id counts once. Rows without time are in no session.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, delay)
    if row_id:
        rows = rows.dropDuplicatesWithinWatermark([row_id]) if events.isStreaming else rows.dropDuplicates([row_id])
    # Start and end are aggregates: a filter on the window's own would be moved below the merging of its rows, and cut sessions.
    bounds = [F.min(time).alias("session_start"), (F.max(time) + F.expr(f"INTERVAL {gap}")).alias("session_end"), F.count("*").alias("n_events")]
    return rows.groupBy(*keys, F.session_window(time, gap)).agg(*bounds, *(c.alias(n) for n, c in totals.items())).drop("session_window")


def append_available(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet what the stream gives now, in its batches, from where the checkpoint left off; exactly once."""
    return df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Queries over events as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.files import shared_folder
from ..streaming import sessions
from .qc import read
from .registry import query

SLICES, DELAY_HOURS, GAP_HOURS = 4, 24, 12
EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def cut(events: DataFrame, folder: str) -> None:
    """events as files of SLICES equal spans of time, one after the other. Each tenth event comes twice, and each 37th of the first span comes with the last, too late."""
    ts = F.col("ts").cast("timestamp")
    rows = events.select("event_id", ts.alias("ts"), "user_id", "event_type").where("ts IS NOT NULL")
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if first is None:
        return
    span = (last - first) // SLICES + 1
    number = F.floor((F.unix_micros("ts") - first) / span)
    number = F.when((number == 0) & (F.col("event_id") % 37 == 0), SLICES - 1).otherwise(number)
    for k in range(SLICES):
        own = rows.where(number == k)
        own.unionByName(own.where("event_id % 10 = 0")).coalesce(1).write.mode("append").parquet(folder)


def event_sessions(stream: DataFrame) -> DataFrame:
    return sessions.sessions(stream, ["user_id"], "ts", f"{GAP_HOURS} hours", f"{DELAY_HOURS} hours", "event_id", first_id=F.min("event_id"), last_id=F.max("event_id"), n_purchases=F.count_if(F.col("event_type") == "purchase"))


@query(
    f"""WITH b AS (SELECT min(epoch_us(ts)) AS a, (max(epoch_us(ts)) - min(epoch_us(ts))) // {SLICES} + 1 AS span, max(epoch_us(ts)) // 1000 * 1000 - {DELAY_HOURS} * 3600000000 AS mark FROM events),
    e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events, b WHERE NOT ((epoch_us(ts) - a) // span = 0 AND event_id % 37 = 0)),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {GAP_HOURS} * 3600000000 THEN 0 ELSE 1 END AS begins FROM e),
    s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(t) AS start_us, max(t) + {GAP_HOURS} * 3600000000 AS end_us, count(*) AS n_events, min(event_id) AS first_id, max(event_id) AS last_id, count(*) FILTER (event_type = 'purchase') AS n_purchases
    FROM s GROUP BY user_id, n HAVING max(t) + {GAP_HOURS} * 3600000000 <= (SELECT mark FROM b)"""
)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed, of all events as a stream of four batches with repeated and late rows."""
    folder = shared_folder(spark)
    cut(read(spark, sf_dir, "events"), f"{folder}/in")
    stream = sessions.stream_table(spark, f"{folder}/in", EVENTS)
    sessions.append_available(event_sessions(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.schema("user_id long, session_start timestamp, session_end timestamp, n_events long, first_id long, last_id long, n_purchases long").parquet(f"{folder}/out")
    return found.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_events", "first_id", "last_id", "n_purchases")

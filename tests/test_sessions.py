import datetime as dt

import pytest
from pyspark.sql import functions as F

from mosaicflow.plans import event_streams
from mosaicflow.streaming import sessions

AT = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, t timestamp"


def at(minutes):
    return AT + dt.timedelta(minutes=minutes)


def put(spark, folder, rows):
    spark.createDataFrame([(i, k, None if m is None else at(m)) for i, k, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, root):
    stream = sessions.sessions(sessions.stream_table(spark, str(root / "in"), SCHEMA), ["k"], "t", "10 minutes", "30 minutes", "id", ids=F.sum("id"))
    sessions.append_available(stream, str(root / "out"), str(root / "checkpoint")).awaitTermination()
    rows = spark.read.schema("k string, session_start timestamp, session_end timestamp, n_events long, ids long").parquet(str(root / "out")).collect()
    return sorted(((r.k, int((r.session_start - AT).total_seconds() // 60), int((r.session_end - AT).total_seconds() // 60), r.n_events, r.ids) for r in rows), key=repr)


BATCHES = [
    [(1, "a", 0), (2, "a", 9), (3, "b", 5), (4, None, 1), (5, "a", None)],
    [(2, "a", 9), (6, "a", 18), (7, "b", 15), (8, "a", 60)],  # 2 again; 18 goes on, and so does 15, just a gap after 5
    [(12, "c", 61)],
    [(9, "a", 20), (10, "b", 62), (11, "a", 100)],  # 20 is late: the watermark was 30 when the batch before began
]
EXPECTED = [("a", 0, 28, 3, 9), ("a", 60, 70, 1, 8), ("b", 5, 25, 2, 10), (None, 1, 11, 1, 4)]


def test_late_and_repeated_rows(spark, tmp_path):
    for rows in BATCHES:
        put(spark, tmp_path / "in", rows)
    assert run(spark, tmp_path) == EXPECTED  # up to the last watermark, of 70


def test_restart_from_the_checkpoint(spark, tmp_path):
    """The same batches, each by a run of its own: state outlives the query."""
    for rows in BATCHES:
        put(spark, tmp_path / "in", rows)
        got = run(spark, tmp_path)
    assert got == EXPECTED and run(spark, tmp_path) == EXPECTED


def test_stream_gives_what_the_table_gives(spark, sf_dir, tmp_path):
    """But for late rows, and sessions that are open at the end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    event_streams.cut(events.where("event_id % 37 <> 0"), str(tmp_path / "in"))
    stream = event_streams.event_sessions(sessions.stream_table(spark, str(tmp_path / "in"), event_streams.EVENTS))
    sessions.append_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    table = event_streams.event_sessions(events.where("event_id % 37 <> 0"))
    mark = events.where("event_id % 37 <> 0").agg(F.max("ts").cast("timestamp") - F.expr(f"INTERVAL {event_streams.DELAY_HOURS} HOURS")).first()[0]
    streamed = spark.read.schema(table.schema).parquet(str(tmp_path / "out"))
    closed = table.where(F.col("session_end") <= F.lit(mark))
    assert len(closed.collect()) > 10 and sorted(closed.collect()) == sorted(streamed.collect())


def test_nothing(spark, tmp_path):
    event_streams.cut(spark.createDataFrame([], event_streams.EVENTS), str(tmp_path / "in"))
    assert event_streams.event_sessions(spark.createDataFrame([], event_streams.EVENTS)).collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(str(tmp_path / "in")).count()

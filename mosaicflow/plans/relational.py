"""Queries of joins by time, regions of large grids and the like, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions, samples, temporal, timelines
from ..sinks.tables import written
from .qc import read
from .registry import query


@query(
    """WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts)
    SELECT l.event_id, l.user_id, r.event_id AS prior_id, r.event_type AS prior_type, r.value AS prior_value, epoch_us(l.ts) - epoch_us(r.ts) AS microseconds FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""
)
def asof_events(spark, sf_dir):
    """Each purchase with the latest event of another type, up to then, of its user."""
    events = read(spark, sf_dir, "events")
    found = temporal.asof_join(events.where("event_type = 'purchase'"), events.where("event_type <> 'purchase'"), ["user_id"], "ts", {"prior_id": "event_id", "prior_type": "event_type", "prior_value": "value", "prior_ts": "ts"}, tie="event_id", bucket=24 * temporal.HOUR)
    return found.select("event_id", "user_id", "prior_id", "prior_type", "prior_value", (temporal.instant(found, "ts") - temporal.instant(found, "prior_ts")).alias("microseconds"))


@query(
    """WITH r AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
    SELECT l.event_id, CASE WHEN epoch_us(r.ts) - epoch_us(l.ts) <= 86400000000 THEN r.event_id END AS next_id FROM (SELECT * FROM events WHERE event_type = 'view') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts < r.ts"""
)
def asof_events_forward(spark, sf_dir):
    """Each view with its user's first purchase after it, within a day."""
    events = read(spark, sf_dir, "events").withColumn("sooner", -F.col("event_id"))
    found = temporal.asof_join(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), ["user_id"], "ts", {"next_id": "event_id"}, tie="sooner", direction="forward", exact=False, within=24 * temporal.HOUR)
    return found.select("event_id", "next_id")


#: Hours that an event's interval is long: up to two days, and a month for one in fifty.
_HOURS = "CASE WHEN event_id % 50 = 0 THEN 720 ELSE event_id % 48 + 1 END"


@query(
    f"""WITH i AS (SELECT *, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 * ({_HOURS}) AS b FROM events)
    SELECT l.event_id AS left_id, r.event_id AS right_id, greatest(l.a, r.a) AS overlap_start, least(l.b, r.b) - greatest(l.a, r.a) AS overlap_us
    FROM i l JOIN i r ON l.user_id = r.user_id AND l.a < r.b AND r.a < l.b WHERE l.event_type = 'purchase' AND r.event_type = 'error'"""
)
def overlapping_events(spark, sf_dir):
    """Intervals of purchases and errors of one user that overlap, with what they share."""
    hours = F.when(F.col("event_id") % 50 == 0, 720).otherwise(F.col("event_id") % 48 + 1)
    events = read(spark, sf_dir, "events")
    begin = temporal.instant(events, "ts")
    spans = events.select("event_id", "user_id", "event_type", begin.alias("a"), (begin + hours * temporal.HOUR).alias("b"))
    found = temporal.overlap_join(spans.where("event_type = 'purchase'"), spans.where("event_type = 'error'"), "a", "b", ["user_id"])
    begin = F.greatest("left.a", "right.a")
    return found.select(F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"), begin.alias("overlap_start"), (F.least("left.b", "right.b") - begin).alias("overlap_us"))


#: A tall grid that grows with lineitem: row l_orderkey // 5, and eight cells from each fourth column on.
_STROKES = "SELECT DISTINCT l_partkey % 200 AS s, l_orderkey // 5 AS y FROM lineitem"


@query(
    f"""WITH RECURSIVE n AS ({_STROKES}),
    lab(s, y, label) USING KEY (s, y) AS (
      SELECT s, y, y * 1000 + s FROM n
      UNION
      SELECT w.s, w.y, min(l.label) FROM lab l, (VALUES (1, 0), (2, 0), (-1, 0), (-2, 0), (-1, 1), (0, 1), (1, 1), (-1, -1), (0, -1), (1, -1)) AS o(os, oy), recurring.lab w
      WHERE w.s = l.s + os AND w.y = l.y + oy AND l.label < w.label GROUP BY w.s, w.y
    ), c AS (SELECT DISTINCT label, 4 * s + i AS x, y FROM lab, range(8) AS t(i))
    SELECT label % 1000 * 4 AS first_x, label // 1000 AS first_y, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM c GROUP BY label"""
)
def tiled_regions(spark, sf_dir):
    """Connected regions of one grid made from all of lineitem, by tiles of 128 x 128 cells."""
    begin = F.col("l_partkey") % 200 * 4
    strokes = read(spark, sf_dir, "lineitem").select(begin.alias("x"), (begin + 8).alias("end"), F.expr("l_orderkey div 5").alias("y"))
    return regions.region_table(strokes, [], tile=128, end="end")


@query(
    """SELECT event_id, user_id, count(*) OVER w AS n_day, max(event_id) OVER w AS last_id, count(*) FILTER (event_type = 'error') OVER w AS n_errors
    FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)"""
)
def rolling_events(spark, sf_dir):
    """For each event, its user's events and errors in the day up to it."""
    found = timelines.rolling(read(spark, sf_dir, "events"), ["user_id"], "ts", 24 * temporal.HOUR, n_day=F.count("*"), last_id=F.max("event_id"), n_errors=F.count_if(F.col("event_type") == "error"))
    return found.select("event_id", "user_id", "n_day", "last_id", "n_errors")


@query(
    """WITH g AS (SELECT *, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS b FROM events),
    i AS (SELECT *, CAST(sum(b) OVER (PARTITION BY event_type ORDER BY us RANGE UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g)
    SELECT event_type, island, count(*) AS n_events, min(us) AS start_us, max(us) AS end_us FROM i GROUP BY ALL"""
)
def event_islands(spark, sf_dir):
    """Runs of events of one type no more than an hour apart; five types hold all events, so each is many tasks."""
    found = timelines.islands(read(spark, sf_dir, "events"), ["event_type"], "ts", temporal.HOUR)
    at = temporal.instant(found, "ts")
    return found.groupBy("event_type", "island").agg(F.count("*").alias("n_events"), F.min(at).alias("start_us"), F.max(at).alias("end_us"))


_HASH = "CAST('0x' || substr(sha256(CAST({0} AS VARCHAR)), 1, 13) AS BIGINT)"


@query(
    f"""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY -ln(({_HASH.format("o_orderkey")} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / o_totalprice, CAST(o_orderkey AS VARCHAR)) AS n
    FROM orders WHERE o_totalprice > 0) WHERE n <= 25"""
)
def weighted_orders(spark, sf_dir):
    """25 orders of each priority, drawn by price."""
    return samples.weighted_sample(read(spark, sf_dir, "orders"), 25, "o_orderkey", "o_totalprice", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query(
    f"""WITH h AS (SELECT DISTINCT date_trunc('week', ts) AS w, user_id, {_HASH.format("user_id")} AS h FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY h) AS n, count(*) OVER (PARTITION BY w) AS total FROM h)
    SELECT epoch_us(w) AS week_us, any_value(total) AS exact, round(CASE WHEN any_value(total) < 64 THEN any_value(total) ELSE 283726776524341248.0::DOUBLE / (max(h) FILTER (n = 64) + 1) END, 6) AS estimated, true AS within FROM r GROUP BY w"""
)
def weekly_users(spark, sf_dir):
    """Users of each week from stored sketches of days, beside their exact number, and whether the estimate is within four standard errors."""
    days = read(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    stored = written(samples.distinct_sketch(days, ["day"], "user_id", 64), "sketches")
    week = F.date_trunc("week", "day")
    merged = samples.merged_sketches(stored.withColumn("week", week), ["week"], 64)
    exact = days.groupBy(week.alias("week")).agg(F.countDistinct("user_id").alias("exact"))
    guess = samples.estimate(F.col("sketch"), 64)
    return merged.join(exact, "week").select(F.unix_micros(F.col("week").cast("timestamp")).alias("week_us"), "exact", F.round(guess, 6).alias("estimated"), (F.abs(guess - F.col("exact")) <= 0.5 * F.col("exact")).alias("within"))


@query(
    """WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem), b AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 49),
    x AS (SELECT *, 1 AS l, 0 AS r FROM a UNION ALL SELECT *, 0, 1 FROM b)
    SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right FROM x GROUP BY ALL HAVING sum(l) <> sum(r)"""
)
def lineitem_difference(spark, sf_dir):
    """What two versions of a table with repeated rows and nulls don't have alike."""
    a = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    b = a.where("l_quantity < 49").withColumn("l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")))
    return samples.multiset_difference(a, b)


@query(
    """SELECT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year, CAST(grouping_id(l_returnflag, l_linestatus, year(l_shipdate)) AS BIGINT) AS level, count(*) AS n_lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, year(l_shipdate)), (l_returnflag, l_linestatus), (year(l_shipdate)), ())"""
)
def lineitem_levels(spark, sf_dir):
    """Lines and their price by flag, status and year, and by levels of these, in one shuffle."""
    lines = read(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("long"))
    keys = [F.col(c) for c in ("l_returnflag", "l_linestatus", "ship_year")]
    sets = [keys, keys[:2], keys[2:], []]
    level = F.grouping_id(*keys).cast("long").alias("level")
    return lines.groupingSets(sets, *keys).agg(level, F.count("*").alias("n_lines"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))

"""Joins by time: as-of, and overlap of intervals. No entity and no interval is one task's, and no pair is tested that shares no bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Bins of an interval, each a multiple of the one before: an interval takes wide ones for its middle and narrow ones for its ends.
WIDTHS = (HOUR, 32 * HOUR, 1024 * HOUR)


def instant(df: DataFrame, column: str) -> Column:
    """A time as a whole number: microseconds of timestamps, those without zone by the session's, days of dates, numbers as they are."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column).cast("long") if kind == "date" else F.col(column).cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: dict[str, str], *, right_time: str | None = None, tie: str | None = None,
              direction: str = "backward", exact: bool = True, within: int | None = None, bucket: int = HOUR) -> DataFrame:
    """left with values, by new name, of the row of right that has the same by and the latest time not after left's.

    direction="forward" takes the earliest not before instead, exact=False leaves equal times out, and within bounds the difference. Of rows of right at one
    time that of the greatest tie counts; without tie any may. Rows of left without match, or with a null in by or time, have nulls; such rows of right match nothing.
    Both sides are dealt out by entity and bucket of time, so an entity of any size is many tasks. What is carried over a bucket's border comes from a summary
    of one row for each bucket that holds anything.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction {direction!r} is neither backward nor forward")
    sign, n = 1 if direction == "backward" else -1, len(by)
    keys = [f"key{i}_" for i in range(n)]
    at = F.col("t_")
    cell = (at - F.pmod(at, F.lit(bucket))).alias("bucket_")
    r = right.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), (sign * instant(right, right_time or time)).alias("t_"), (F.col(tie) if tie else F.lit(0)).alias("tie_"), F.struct(*(F.col(c).alias(v) for v, c in values.items())).alias("v"))
    r = r.dropna(subset=[*keys, "t_"]).select(*keys, "t_", F.lit(int(not exact)).alias("side_"), "tie_", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("row_"), F.struct("t_", "v").alias("value_"))
    kinds = {f.name: f.dataType for f in r.schema}
    l = left.select(*(F.col(b).cast(kinds[k]).alias(k) for b, k in zip(by, keys, strict=True)), (sign * instant(left, time)).alias("t_"), F.lit(int(exact)).alias("side_"), F.lit(None).cast(kinds["tie_"]).alias("tie_"), F.struct("*").alias("row_"), F.lit(None).cast(kinds["value_"]).alias("value_"))  # noqa: E741
    both = l.unionByName(r).select("*", cell)

    here = Window.partitionBy(*keys, "bucket_").orderBy("t_", "side_", "tie_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("found_", F.last("value_", ignorenulls=True).over(here)).where("row_ IS NOT NULL")
    order = F.when(F.col("value_").isNotNull(), F.struct("t_", "tie_"))
    last = both.groupBy(*keys, "bucket_").agg(F.max_by("value_", order).alias("last_"), F.bool_or(F.col("row_").isNotNull()).alias("asked_"))
    before = Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried_", F.last("last_", ignorenulls=True).over(before)).where("asked_ AND carried_ IS NOT NULL").select(*keys, "bucket_", "carried_")
    joined = found.join(carried, [*keys, "bucket_"], "left").withColumn("m_", F.coalesce("found_", "carried_"))
    match = F.when(at - F.col("m_.t_") <= within, F.col("m_.v")) if within is not None else F.col("m_.v")
    return joined.select("row_.*", *(match[v].alias(v) for v in values))


def _floor(x: Column, by: int) -> Column:
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def covering_bins(start: Column, end: Column, widths: tuple[int, ...] = WIDTHS) -> Column:
    """Bins (level, bin) that cover [start, end), none in another: at most two widths' ratio a level, and as many of the widest as it takes."""
    empty = F.array().cast("array<struct<level: int, bin: bigint>>")

    def cells(level: int, a: Column, b: Column) -> Column:
        return F.when(b > a, F.transform(F.sequence(a, b - 1), lambda c: F.struct(F.lit(level).alias("level"), c.alias("bin")))).otherwise(empty)

    a, b, out = _floor(start, widths[0]), _floor(end - 1, widths[0]) + 1, []
    for level, (width, wider) in enumerate(zip(widths, widths[1:], strict=False)):
        ratio = wider // width
        up_a, up_b = _floor(a + ratio - 1, ratio), _floor(b, ratio)
        inner = up_b > up_a
        out += [cells(level, a, F.when(inner, up_a * ratio).otherwise(b)), F.when(inner, cells(level, up_b * ratio, b)).otherwise(empty)]
        a, b = F.when(inner, up_a).otherwise(F.lit(0)), F.when(inner, up_b).otherwise(F.lit(0))
    return F.concat(*out, cells(len(widths) - 1, a, b))


def overlap_join(left: DataFrame, right: DataFrame, start: str, end: str, on: list[str] | None = None, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(left, right), structs of rows whose half-open intervals overlap and whose columns on are equal, each pair once.

    Of two intervals that overlap, one holds the start of the other (or both starts are one). So one side's intervals meet the other's starts in the bins that cover them, once
    each way; the bins of an interval don't overlap, and a start is in one of each width, so a pair comes from one bin. An interval of any
    length takes few bins. Empty intervals, and such with a null, overlap nothing.
    """
    on = on or []
    if any(b % a for a, b in zip(widths, widths[1:], strict=False)):
        raise ValueError("each width must be a multiple of the one before")

    def side(df: DataFrame, name: str) -> DataFrame:
        keys = [F.col(c).alias(f"{name}_on{i}_") for i, c in enumerate(on)]
        rows = df.select(F.struct("*").alias(name), instant(df, start).alias(f"{name}_start_"), instant(df, end).alias(f"{name}_end_"), *keys)
        return rows.where(f"{name}_end_ > {name}_start_")

    rows = {"left": side(left, "left"), "right": side(right, "right")}

    def meet(cover: str, point: str, strictly: bool) -> DataFrame:
        a, b = F.col(f"{cover}_start_"), F.col(f"{point}_start_")
        wide = rows[cover].select("*", F.inline(covering_bins(a, F.col(f"{cover}_end_"), widths)))
        probes = F.array(*(F.struct(F.lit(k).alias("level"), _floor(b, w).alias("bin")) for k, w in enumerate(widths)))
        narrow = rows[point].select("*", F.inline(probes))
        same = [F.col(f"left_on{i}_") == F.col(f"right_on{i}_") for i in range(len(on))]
        joined = wide.join(narrow, ["level", "bin"]).where((a < b if strictly else a <= b) & (b < F.col(f"{cover}_end_")))
        for c in same:
            joined = joined.where(c)
        return joined.select("left", "right")

    return meet("left", "right", False).unionByName(meet("right", "left", True))

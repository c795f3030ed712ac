"""Windows over long timelines in which no entity is one task's: moving frames and islands, by buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import HOUR, instant


def _bucket(t: Column, width: int) -> Column:
    return t - F.pmod(t, F.lit(width))


def rolling(df: DataFrame, by: list[str], time: str, width: int, **aggregates: Column) -> DataFrame:
    """df with aggregates by name over the rows of the same by from width before a row's time up to it, rows of that very time included.

    Each row stands in its bucket, of width, and as a helper in the next one; a frame never reaches further back, so frames are made within buckets, and
    what an entity costs a task is two buckets. Rows without time stay with null aggregates; null keys are an entity.
    """
    t = instant(df, time)
    rows = df.select(F.struct("*").alias("row_"), *(F.col(b).alias(f"key{i}_") for i, b in enumerate(by)), t.alias("t_"), _bucket(t, width).alias("b_"))
    both = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("late_")).withColumn("cell_", F.col("b_") + F.col("late_") * width)
    frame = Window.partitionBy(*(f"key{i}_" for i in range(len(by))), "cell_").orderBy("t_").rangeBetween(-width, Window.currentRow)
    wide = both.where("t_ IS NOT NULL").select("row_", "late_", "t_", "row_.*", *(f"key{i}_" for i in range(len(by))), "cell_")
    found = wide.select("row_", "late_", *(a.over(frame).alias(n) for n, a in aggregates.items())).where("late_ = 0")
    none = rows.where("t_ IS NULL").select("row_", F.lit(0).alias("late_"), *(F.lit(None).cast(found.schema[n].dataType).alias(n) for n in aggregates))
    return found.unionByName(none).select("row_.*", *aggregates)


def islands(df: DataFrame, by: list[str], time: str, gap: int, bucket: int = 24 * HOUR) -> DataFrame:
    """df with island, from 1 in time within each by: a row more than gap after the one before it begins the next one.

    The row before a bucket's first, and the islands begun before it, come from sums of one row for each bucket, added up in two levels; so a hot entity is
    as many tasks as it has buckets. Rows without time are in no island, and have a null one.
    """
    t = instant(df, time)
    keys = [f"key{i}_" for i in range(len(by))]
    rows = df.select(F.struct("*").alias("row_"), *(F.coalesce(F.col(b).cast("string"), F.lit("\0")).alias(k) for b, k in zip(by, keys, strict=True)), t.alias("t_"), _bucket(t, bucket).alias("b_"))
    timed, cell = rows.where("t_ IS NOT NULL"), [*keys, "b_"]
    earlier = Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    last = timed.groupBy(*cell).agg(F.max("t_").alias("m_")).withColumn("before_", F.max("m_").over(earlier)).drop("m_")
    own = Window.partitionBy(*cell).orderBy("t_")
    step = timed.join(last, cell).withColumn("prior_", F.coalesce(F.lag("t_").over(own), "before_"))
    step = step.withColumn("begins_", F.when(F.col("prior_").isNull() | (F.col("t_") - F.col("prior_") > gap), 1).otherwise(0))
    begun = step.groupBy(*cell).agg(F.sum("begins_").alias("n_")).withColumn("base_", F.coalesce(F.sum("n_").over(earlier), F.lit(0))).drop("n_")
    here = F.sum("begins_").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = step.withColumn("here_", here).join(begun, cell).select("row_.*", (F.col("base_") + F.col("here_")).alias("island"))
    return found.unionByName(rows.where("t_ IS NULL").select("row_.*", F.lit(None).cast("long").alias("island")))

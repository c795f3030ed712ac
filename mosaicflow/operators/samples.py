"""Samples and sketches by the smallest hashes: reproducible in any partitioning, mergeable, and small before anything is shuffled. Also differences of tables with repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a hash; whole numbers of so many are exact in most engines.
BITS = 52


def hashed(*values: Column) -> Column:
    """A number of BITS bits from the SHA-256 of values as text, joined by a line end; null as nothing."""
    text = F.concat_ws("\n", *(F.coalesce(v.cast("string"), F.lit("")) for v in values))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, BITS // 4), 16, 10).cast("long")


def weighted_sample(df: DataFrame, k: int, key: str, weight: str, strata: list[str] | None = None) -> DataFrame:
    """k rows of each stratum, or all it has, drawn without replacement with chances that grow with weight; with priority, by which a smaller k takes the first.

    A row's priority is that of an exponential clock of rate weight, driven by the hash of its key: the k least are the sample. Rows of equal key and weight tie and go by the
    key as text. Rows without a positive weight are never drawn. Ranking is cut to k rows a task and stratum before its shuffle.
    """
    u = (hashed(F.col(key)) + 0.5) / float(1 << BITS)
    rows = df.where(F.col(weight) > 0).withColumn("priority", -F.log(u) / F.col(weight))
    order = Window.partitionBy(*(strata or [F.lit(0)])).orderBy("priority", F.col(key).cast("string"))
    return rows.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= k).drop("rank_")


def distinct_sketch(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """by and sketch: the k smallest hashes of the different values of each group, sorted. Null values count for nothing."""
    return _smallest(df.where(F.col(value).isNotNull()).select(*by, hashed(F.col(value)).alias("h")), by, k)


def merged_sketches(sketches: DataFrame, by: list[str], k: int) -> DataFrame:
    """Sketches of groups of groups, without looking at rows again: what distinct_sketch() gives for all their rows."""
    return _smallest(sketches.select(*by, F.explode("sketch").alias("h")), by, k)


def _smallest(hashes: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("h")
    few = hashes.distinct().withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= k)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def estimate(sketch: Column, k: int) -> Column:
    """The number of different values: exact for fewer than k, else within 1 / sqrt(k - 2) of it in two of three cases."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(float((k - 1) << BITS)) / (F.element_at(sketch, k) + F.lit(1)))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, once each, with n_left and n_right. Null equals null.

    Both are counted in one shuffle, by all columns, after each task has counted its own; a row that makes up a third of a table is a few rows then.
    """
    if left.columns != right.columns:
        raise ValueError("tables have other columns")
    side = lambda df, a, b: df.select(F.struct("*").alias("row_"), F.lit(a).alias("l_"), F.lit(b).alias("r_"))
    counted = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy("row_").agg(F.sum("l_").alias("n_left"), F.sum("r_").alias("n_right"))
    return counted.where("n_left <> n_right").select("row_.*", "n_left", "n_right")


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left, each as many times more as it has them."""
    more = multiset_difference(left, right).where("n_left > n_right")
    return more.select(*left.columns, F.explode(F.sequence(F.lit(1), F.col("n_left") - F.col("n_right"))).alias("n_")).drop("n_")

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mosaicflow.operators import samples, timelines


def split(df, n):
    return df.repartition(n)


def test_rolling_same_as_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "hot", "hot", "hot", None]), rng.choice([None, *range(-60, 60)])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    got = timelines.rolling(df, ["k"], "t", 10, n=F.count("*"), top=F.max("id")).collect()
    expected = {}
    for i, k, t in rows:
        own = [j for j, q, s in rows if t is not None and s is not None and q == k and t - 10 <= s <= t]
        expected[i] = (len(own), max(own)) if own else (None, None)
    assert {r.id: (r.n, r.top) for r in got} == expected


@pytest.mark.parametrize("bucket", [7, 1000])
def test_islands_same_as_brute_force(spark, bucket):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "hot", "hot", None]), rng.choice([None, *range(-200, 200, 3)])) for i in range(150)]
    got = {r.id: r.island for r in timelines.islands(spark.createDataFrame(rows, "id long, k string, t long"), ["k"], "t", 5, bucket).collect()}
    for k in ("a", "hot", None):
        last, n = None, 0
        for t, i in sorted((t, i) for i, q, t in rows if q == k and t is not None):
            n += last is None or t - last > 5
            last = t
            assert got[i] == n
    assert all(got[i] is None for i, _, t in rows if t is None) and len(got) == 150


def test_hot_entity_is_split(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
        for found in (timelines.rolling(df, ["k"], "t", 50, n=F.count("*")), timelines.islands(df, ["k"], "t", 5, 50)):
            assert max(r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_weighted_sample(spark):
    """The same in any partitioning, nested in k, more of what weighs more, nothing without weight."""
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("s"), F.when(F.col("id") % 10 == 0, 50.0).when(F.col("id") % 10 == 1, 0.0).otherwise(1.0).alias("w"))
    draw = lambda df, k: {r.id for r in samples.weighted_sample(df, k, "id", "w", ["s"]).collect()}
    some = draw(df, 60)
    assert len(some) == 180 and some == draw(split(df, 7), 60) and draw(df, 20) < some
    assert sum(i % 10 == 0 for i in some) > 120 and not any(i % 10 == 1 for i in some)
    assert samples.weighted_sample(df, 5000, "id", "w").count() == 2700
    plan = samples.weighted_sample(df, 5, "id", "w", ["s"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_sketches_merge_exactly(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 11 > 0, F.col("id") % 5000).alias("v"))
    days = samples.distinct_sketch(df, ["day"], "v", 256)
    direct, merged = samples.distinct_sketch(df, [], "v", 256).first().sketch, samples.merged_sketches(split(days, 3), [], 256).first().sketch
    assert direct == merged and len(merged) == 256
    exact = df.select("v").distinct().where("v IS NOT NULL").count()
    assert abs(days.transform(lambda d: samples.merged_sketches(d, [], 256)).select(samples.estimate(F.col("sketch"), 256)).first()[0] - exact) < 0.25 * exact
    assert samples.distinct_sketch(df.where("v < 10"), [], "v", 256).select(samples.estimate(F.col("sketch"), 256)).first()[0] == 10


def test_multiset_difference(spark):
    rows = [[("a", 1)] * 3 + [("b", None)] * 2 + [(None, None)], [("a", 1), ("b", None), ("b", None), ("c", 2)] + [(None, None)] * 4]
    left, right = (spark.createDataFrame(r, "k string, n int") for r in rows)
    assert sorted(map(tuple, samples.multiset_difference(left, right).collect()), key=repr) == [("a", 1, 3, 1), ("c", 2, 0, 1), (None, None, 1, 4)]
    for a, b in ((left, right), (right, left)):
        assert Counter(map(tuple, samples.except_all(a, b).collect())) == Counter(map(tuple, a.exceptAll(b).collect()))
    with pytest.raises(ValueError):
        samples.multiset_difference(left, right.select("n", "k"))

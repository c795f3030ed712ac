import random

import pytest
from pyspark.sql import functions as F

from mosaicflow.operators import temporal


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_asof(left, right, forward, exact, within):
    """(id, matched id) by testing every pair; ids of right grow, and the greatest wins a tie."""
    out = []
    for i, key, t in left:
        fits = [(r, j) for j, k, r in right if k == key and None not in (key, t, r) and (r == t and exact or (r > t if forward else r < t)) and (within is None or abs(r - t) <= within)]
        best = (min(fits, key=lambda x: (x[0], -x[1])) if forward else max(fits)) if fits else (None, None)
        out.append((i, best[1]))
    return sorted(out)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("within", [None, 7])
def test_asof_same_as_brute_force(spark, forward, exact, within):
    """Ties, repeats, nulls on both sides, empty buckets, one entity with half of all rows, columns of clashing names."""
    rng = random.Random(5)
    keys = ["hot"] * 5 + ["a", "b", "c", "d", None]
    rows = [[(i, rng.choice(keys), rng.choice([None, *range(-40, 160)])) for i in range(n)] for n in (150, 90)]
    left, right = (spark.createDataFrame(r, f"{n}_id long, k string, t long").withColumn("t_", F.lit(1)) for r, n in zip(rows, "lr", strict=True))
    got = temporal.asof_join(left.drop("t_"), right, ["k"], "t", {"found": "r_id"}, tie="r_id", direction="forward" if forward else "backward", exact=exact, within=within, bucket=10)
    assert sorted((r.l_id, r.found) for r in got.collect()) == brute_asof(*rows, forward, exact, within)


def test_asof_hot_entity_is_split(spark):
    left = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), "id")
    got = temporal.asof_join(left, left.where("id % 7 = 0"), ["k"], "t", {"found": "id"}, bucket=100)
    parts = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2000 and got.where("found <> id - id % 7").count() == 0


def test_asof_of_nothing(spark):
    some, none = (spark.createDataFrame(r, "k string, t timestamp, v int") for r in ([("a", None, 1)], []))
    assert [r.found for r in temporal.asof_join(some, none, ["k"], "t", {"found": "v"}).collect()] == [None]
    assert temporal.asof_join(none, some, ["k"], "t", {"found": "v"}).count() == 0
    with pytest.raises(ValueError):
        temporal.asof_join(some, none, ["k"], "t", {}, direction="nearest")


@pytest.mark.parametrize("widths", [(4, 16), (4, 16, 64), (1000,)])
def test_overlap_same_as_brute_force(spark, widths):
    """Touching, equal, empty, inverted and null intervals, one over everything, negative times."""
    rng = random.Random(6)

    def some(n):
        rows = []
        for i in range(n):
            a = rng.randrange(-90, 90)
            rows.append((i, rng.choice(["x", "y"]), a, a + rng.choice([0, 1, 3, 4, 8, 50, -2])))
        return [*rows, (n, "x", -1000, 1000), (n + 1, "y", None, 5), (n + 2, "y", 5, None), (n + 3, None, 0, 9)]

    rows = [some(60), some(40)]
    left, right = (spark.createDataFrame(r, "id long, k string, a long, b long") for r in rows)
    fits = lambda p, q: None not in (p[2], p[3], q[2], q[3]) and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3]
    for on in (None, ["k"]):
        got = temporal.overlap_join(left, right, "a", "b", on, widths)
        expected = sorted((p[0], q[0]) for p in rows[0] for q in rows[1] if fits(p, q) and (on is None or p[1] is not None and p[1] == q[1]))
        assert sorted((r.left.id, r.right.id) for r in got.collect()) == expected
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_bins_cover_once(spark):
    rows = [(0, 1), (-5, 7), (3, 3000), (16, 64), (15, 65), (-70, -64)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", temporal.covering_bins(F.col("a"), F.col("b"), (4, 16, 64)).alias("c")).collect()
    for r in got:
        points = [x for level, bin_ in r.c for x in range(bin_ * 4 ** (level + 1), (bin_ + 1) * 4 ** (level + 1))]
        assert len(points) == len(set(points)) and set(range(r.a, r.b)) <= set(points)
        assert min(points) > r.a - 4 and max(points) < r.b + 4 and len(r.c) <= 14 + (r.b - r.a) // 64

import random

import pytest
from pyspark.sql import functions as F

from mosaicflow.operators import regions


def brute(cells, diagonal):
    """By grid and cell: the first cell, as (y, x), of its region."""
    todo, out = set(cells), {}
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))]
    while todo:
        own, queue = set(), [todo.pop()]
        while queue:
            k, x, y = queue.pop()
            own.add((k, x, y))
            for dx, dy in steps:
                if (n := (k, x + dx, y + dy)) in todo:
                    todo.remove(n)
                    queue.append(n)
        first = min((y, x) for _, x, y in own)
        out |= dict.fromkeys(own, first)
    return out


@pytest.mark.parametrize("diagonal", [False, True])
def test_same_as_brute_force(spark, diagonal):
    """Several grids, one without a name, negative places, repeated cells, regions that wind through many tiles."""
    rng = random.Random(8)
    cells = [(k, x, y) for k in ("a", "b", None) for x in range(-13, 14) for y in range(-9, 12) if rng.random() < 0.55]
    cells += [("line", x, 0) for x in range(-30, 30)] + [("comb", x, y) for x in range(30) for y in range(12) if x % 2 == 0 or y == 11]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate([*cells, *cells[:50]])], "k string, x int, y int, n int")
    x, y = regions.first_cell(F.col("region"))
    got = {(r.k, r.x, r.y): (r.fy, r.fx) for r in regions.regions(df, ["k"], diagonal, tile=4).select("k", "x", "y", x.alias("fx"), y.alias("fy")).collect()}
    assert got == brute(cells, diagonal)


def test_no_keys_and_nothing(spark):
    df = spark.createDataFrame([(x, 3) for x in range(100)], "x long, y long")
    assert regions.region_table(df, [], tile=8).collect() == [(0, 3, 100, 0, 3, 100, 4)]
    assert regions.region_table(df.where("x < 0"), [], tile=8).count() == 0
    with pytest.raises(ValueError):
        regions.regions(df.withColumn("region", F.lit(1)), [])


@pytest.mark.parametrize(("diagonal", "rows"), [(False, 7), (True, 20_000)])
def test_table_from_runs(spark, monkeypatch, diagonal, rows):
    """The table of cells and that of runs which overlap, meet, repeat, are empty or cross tiles, against brute force, also where a tile is many batches."""
    monkeypatch.setattr(regions, "ROWS", rows)
    monkeypatch.setattr(regions, "runs", lambda *a, **b: 1 / 0)
    rng = random.Random(4)
    spans = [(k, x, x + rng.randrange(0, 9), y) for k in ("a", "b", None) for y in range(-9, 12) for x in (rng.randrange(-20, 20) for _ in range(5))]
    spans += spans[:40] + [("long", -40, 70, 3), ("long", 0, 1, 4), ("dots", 1, 2, 1), ("dots", 2, 3, 2), ("dots", 4, 5, 3), ("dots", 3, 4, 4)]
    cells = {(k, x, y) for k, a, b, y in spans for x in range(a, b)}
    own = {}
    for (k, x, y), first in brute(cells, diagonal).items():
        own.setdefault((k, first), []).append((x, y))
    want = {(k, fx, fy, len(c), min(x for x, _ in c), min(y for _, y in c), max(x for x, _ in c) + 1, max(y for _, y in c) + 1) for (k, (fy, fx)), c in own.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        runs = regions.region_table(spark.createDataFrame(spans, "k string, x int, stop int, y int"), ["k"], diagonal, tile=4, end="stop")
        got = runs.collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        single = regions.region_table(spark.createDataFrame(sorted(cells, key=repr) * 2, "k string, x long, y int"), ["k"], diagonal, tile=4)
        assert {tuple(r) for r in single.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [t for c, t in runs.dtypes if c != "k"] == ["bigint", "bigint", "bigint", "int", "int", "int", "int"]


def test_grid_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select((F.col("id") % 200).alias("x"), F.expr("id div 200").alias("y"))
        found = regions.regions(df, [], tile=16)
        assert found.select("region").distinct().count() == 1
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 20_000


def test_contracted(spark):
    """A path, a star whose hub has more links than there are salts, a pair, a loop, repeats."""
    links = [(i, i + 1) for i in range(100, 180)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 5), (5, 7), (9, 9), (None, 3)]
    got = {r.node: r.root for r in regions.contracted(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 181)} | {1000 + i: 1000 for i in range(1, 300)} | {7: 5}


def test_reachable(spark):
    rows = [(0, x, y, not (x == 9 and y != 17), (x, y) == (0, 0)) for x in range(20) for y in range(20)] + [(1, x, 0, None if x == 5 else True, x == 9) for x in range(10)]
    got = {(r.m, r.x, r.y): r.reached for r in regions.reachable(spark.createDataFrame(rows, "m int, x int, y int, walkable boolean, start boolean"), ["m"], tile=8).collect()}
    assert len(got) == 410 and got[0, 19, 0] and not got[0, 9, 0] and got[1, 6, 0] and not got[1, 4, 0] and not got[1, 5, 0]

import math
import random

import pytest
from pyspark.sql import functions as F

from mosaicflow.operators import covering, scene
from mosaicflow.sources import scenes

NONE = dict.fromkeys(("x", "y", "w", "h", "rx", "ry", "points"))
SCHEMA = f"id string, role string, type string, x double, y double, w double, h double, rx double, ry double, points {scenes.POINTS}"


def rect(x, y, w, h):
    return NONE | {"type": "rect", "x": x, "y": y, "w": w, "h": h}


def ellipse(x, y, rx, ry):
    return NONE | {"type": "ellipse", "x": x, "y": y, "rx": rx, "ry": ry}


def polygon(*xy):
    return NONE | {"type": "polygon", "points": [{"x": float(x), "y": float(y)} for x, y in xy]}


SHAPES = [
    rect(0.0, 0.0, 1e6, 1e6), rect(-3.5, 2.0, 7.0, 0.0), rect(5.0, 5.0, 0.0, 0.0), ellipse(10.0, -20.0, 1e6, 3.0), ellipse(100.0, 100.0, 64.0, 64.0),
    polygon((0, 0), (300, 20), (160, 260)), polygon((0, 0), (100, 0), (100, 100), (50, 10), (0, 100)), polygon((-1e6, -1e6), (1e6, -1e6), (0, 1e6)), polygon((1, 1), (9, 9)),
]


def is_in(s, x, y):
    """By the definitions, for points that rounding doesn't decide."""
    if s["type"] == "rect":
        return s["x"] <= x <= s["x"] + s["w"] and s["y"] <= y <= s["y"] + s["h"]
    if s["type"] == "ellipse":
        return ((x - s["x"]) / s["rx"]) ** 2 + ((y - s["y"]) / s["ry"]) ** 2 <= 1
    p = [(q["x"], q["y"]) for q in s["points"]]
    edges = list(zip(p, p[1:] + p[:1], strict=True))
    if any((b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0]) and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]) for a, b in edges):
        return True
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for a, b in edges) % 2 == 1


def places(rng, s):
    """Points in and about a shape: corners, edges and anywhere."""
    x0, y0, x1, y1 = covering._prepared(s)[1]
    dx, dy = (x1 - x0) / 4 + 1, (y1 - y0) / 4 + 1
    return [(x0, y0), (x1, y1), (x0, y1), ((x0 + x1) / 2, y0), *((rng.uniform(x0 - dx, x1 + dx), rng.uniform(y0 - dy, y1 + dy)) for _ in range(400))]


@pytest.mark.parametrize("k", range(len(SHAPES)))
def test_cells(k):
    """Few, apart from each other, around all of the shape, and inner ones wholly in it."""
    shape, rng = SHAPES[k], random.Random(k)
    cells = covering.cells_of(shape)
    assert 0 < len(cells) <= 64 and len({c[:3] for c in cells}) == len(cells)
    for x, y in places(rng, shape):
        own = [c for c in cells if (math.floor(x / 2.0 ** c[0]), math.floor(y / 2.0 ** c[0])) == c[1:3]]
        assert len(own) <= 1 and (not is_in(shape, x, y) or own) and (is_in(shape, x, y) or not any(c[3] for c in own))
    if k in (0, 4, 7):
        assert any(c[3] for c in cells) and len({c[0] for c in cells}) > 1


def test_no_extent():
    assert [covering.cells_of(s) for s in (NONE | {"type": "rect", "x": 1.0}, NONE | {"type": "star"}, NONE | {"type": "polygon", "points": []}, ellipse(0.0, 0.0, 0.0, 1.0), rect(0.0, 0.0, -1.0, 1.0))] == [[]] * 5


def table(spark, shapes, key=""):
    rows = [(f"{i % 7}", "zone", s["type"], s["x"], s["y"], s["w"], s["h"], s["rx"], s["ry"], s["points"] and [(p["x"], p["y"]) for p in s["points"]], *([i % 2] if key else [])) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, SCHEMA + (f", {key} int" if key else ""))


@pytest.mark.parametrize("hot", [1 << 20, 40])
def test_hits_same_as_every_pair(spark, hot):
    """Hot cells cut or not, shapes that repeat, points that repeat, two maps."""
    rng = random.Random(1)
    shapes = [*SHAPES, SHAPES[5], SHAPES[5]]
    points = [(i, x, y, i % 2) for i, (x, y) in enumerate(p for s in SHAPES for p in places(rng, s)[:60])] + [(10_000 + i, 20.0, 20.0, 0) for i in range(50)]
    df = spark.createDataFrame(points, "n long, px double, py double, m int")
    got = scene.hits(df, table(spark, shapes), hot=hot)
    assert sorted((r.n, r.shape_id) for r in got.collect()) == sorted((n, f"{i % 7}") for n, x, y, _ in points for i, s in enumerate(shapes) if is_in(s, x, y))
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    by_map = scene.hits(df, table(spark, shapes, "m"), "m", hot=hot)
    assert sorted((r.n, r.shape_id) for r in by_map.collect()) == sorted((n, f"{i % 7}") for n, x, y, m in points for i, s in enumerate(shapes) if is_in(s, x, y) and i % 2 == m)


def test_hot_cell_is_cut(spark):
    shapes = spark.createDataFrame([(1, SHAPES[0])], f"number long, shape struct<type: string, x: double, y: double, w: double, h: double, rx: double, ry: double, points: {scenes.POINTS}>")
    cells = covering.cover(shapes)
    points = spark.range(6000).select((F.col("id") % 100).cast("double").alias("px"), (F.col("id") % 70).cast("double").alias("py"))

    def largest(cells):
        probes = points.select(F.inline(covering.probes(F.col("px"), F.col("py"), covering.levels_of(cells))))
        return probes.join(cells, ["level", "cell_x", "cell_y"]).groupBy("level", "cell_x", "cell_y").count().agg(F.max("count"), F.sum("count")).first()

    assert largest(cells) == (6000, 6000)
    most, total = largest(covering.subdivided(cells, shapes, points, 1000, 20))
    assert most <= 1000 and total == 6000


def test_no_shapes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "n long, px double, py double")
    assert scene.hits(df, table(spark, SHAPES).where("id = 'x'")).count() == 0

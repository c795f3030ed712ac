import json

from pyspark.sql import functions as F

from mosaicflow.operators import planner, scene
from mosaicflow.plans.queries import _EXAMPLE, example_shapes
from mosaicflow.sources import scenes

POINTS = [("in", 5.0, 5.0), ("edge", 10.0, 5.0), ("corner", 0.0, 0.0), ("out", 10.5, 5.0), ("triangle", 103.0, 102.0), ("beside", 109.0, 108.9), ("far", 900.0, 900.0)]


def shapes(spark):
    rows = [("w", "walk", "rect", 0.0, 0.0, 10.0, 10.0, None, None, None), ("t", "walk", "polygon", None, None, None, None, None, None, [(100.0, 100.0), (110.0, 100.0), (100.0, 110.0)]), ("b", "block", "ellipse", 0.0, 0.0, None, None, 1.0, 2.0, None)]
    return spark.createDataFrame(rows, f"id string, role string, type string, x double, y double, w double, h double, rx double, ry double, points {scenes.POINTS}")


def test_walkable(spark):
    got = scene.walkable(spark.createDataFrame(POINTS, "name string, px double, py double"), shapes(spark), "name")
    assert {r.name: r.walkable for r in got.collect()} == {"in": True, "edge": True, "corner": False, "out": False, "triangle": True, "beside": False, "far": False}


def test_no_nested_loop_join(spark):
    got = scene.walkable(spark.createDataFrame(POINTS, "name string, px double, py double"), shapes(spark), "name")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_collision_file(spark, tmp_path):
    (tmp_path / "collision-map.json").write_text(json.dumps(_EXAMPLE, indent=2))
    row = scenes.read_collision(spark, str(tmp_path)).first()
    assert row.spawn.x == 836 and row.zones["grass"].w == 382 and row.walkBounds[0].rx == 604
    assert scenes.shapes(scenes.read_collision(spark, str(tmp_path)), "path").count() == 5
    (tmp_path / "props").mkdir()
    (tmp_path / "props" / "p.json").write_text(json.dumps([{"id": "torii", "imageKey": "propTorii", "x": 836, "y": 850, "w": 380, "h": 306, "sortY": 850}]))
    box = scene.prop_boxes(scenes.read_props(spark, str(tmp_path / "props"))).first()
    assert (box.left, box.top, box.right, box.bottom) == (646, 544, 1026, 850)


def test_anchor_of_rects(spark):
    """The pillar is given by its top left corner: a point in that rect alone is blocked."""
    asked = spark.createDataFrame([("in", 750.0, 800.0), ("beside", 690.0, 660.0)], "name string, px double, py double")
    assert {r.name: r.walkable for r in scene.walkable(asked, example_shapes(spark), "name").collect()} == {"in": False, "beside": True}


def test_render_order(spark):
    items = spark.createDataFrame([(1, "hud", 0, "h"), (1, "props", 5, "b"), (1, "props", 5, "a"), (1, "base", 9, "g"), (2, "actors", 1, "x"), (1, "odd", 0, "z")], "scene_id int, layer string, sort_y int, id string")
    got = sorted((r.scene_id, r.draw_order, r.id) for r in scene.render_order(items).collect())
    assert got == [(1, 1, "g"), (1, 2, "a"), (1, 3, "b"), (1, 4, "h"), (1, 5, "z"), (2, 1, "x")]


def test_reachable(spark):
    rows = [(0, x, y, not (x == 2 and y != 4), (x, y) == (0, 0)) for x in range(5) for y in range(5) if not (x == 2 and y == 4)]
    got = {(r.gx, r.gy): r.reached for r in scene.reachable(spark.createDataFrame(rows, "map_id int, gx int, gy int, walkable boolean, start boolean"), ["map_id"]).collect()}
    assert got[1, 4] and not got[3, 0] and not got[2, 1]


def test_joins_and_planner(spark):
    props = spark.createDataFrame([("a", "k1", "x"), ("b", "k2", "y")], "id string, imageKey string, asset string")
    assert [r.id for r in scene.missing_images(props, spark.createDataFrame([("k1",), ("k1",)], "imageKey string")).collect()] == ["b"]
    assert scene.with_metadata(props, spark.createDataFrame([("x", 1)], "asset string, n int")).first().n == 1
    steps = spark.createDataFrame([(s,) for s in planner.STRATEGIES], "s string").select(planner.escalate(F.col("s")).alias("n")).collect()
    assert [r.n for r in steps] == [*planner.STRATEGIES[1:], "tilemap"]
    all_ = planner.expand_bundles(spark.createDataFrame([("unit_bundle",)], "bundle string"), optional=True)
    assert [r.asset for r in all_.orderBy("pos").collect()] == ["idle", "combat", "walk"]


def test_scene_files(spark, tmp_path):
    from mosaicflow.sinks.files import scene_files, write_files

    rows = spark.createDataFrame([(1, "town", bytearray(b"png"), None, "{}"), (2, "field", bytearray(b"p"), bytearray(b"q"), None)], "scene_id long, name string, base binary, preview binary, collision string")
    write_files(scene_files(rows), str(tmp_path))
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and p.name != "_SUCCESS" and not p.name.startswith(".")} == {
        "1/assets/map/town-base.png", "1/data/collision-map.json", "2/assets/map/field-base.png", "2/assets/map/field-layered-preview.png",
    }


def test_grid_cells(spark):
    from mosaicflow.operators.pixels import grid_cells

    got = grid_cells(spark.createDataFrame([(1, 10, 9)], "sheet_id long, width int, height int"), 2, 3).orderBy("grid_row", "grid_col").collect()
    assert [(r.box_x0, r.box_y0, r.box_x1, r.box_y1) for r in got] == [(0, 0, 3, 4), (3, 0, 6, 4), (6, 0, 9, 4), (0, 4, 3, 8), (3, 4, 6, 8), (6, 4, 9, 8)]


def test_prompt_sink(spark, tmp_path):
    from mosaicflow.functions import prompts
    from mosaicflow.sinks.files import write_prompts

    asked = spark.createDataFrame([("asset", "fx", "smoke", None, None)], "target string, mode string, prompt string, role string, seed long")
    write_prompts(prompts.build_prompts(asked), str(tmp_path / "p"))
    row = spark.read.json(str(tmp_path / "p" / "json")).first()
    assert row.target == "asset" and spark.read.text(str(tmp_path / "p" / "text")).first().value == row.generated_prompt


def test_preview_by_tiles(spark):
    """Items over borders of tiles, beside the canvas, half clear and in any order give what drawing them on one canvas gives; no group holds a scene's items."""
    import numpy as np

    from mosaicflow.operators.kernels import paste

    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for scene_id, n in ((1, 60), (2, 3), (3, 1), (None, 5)):
        canvas = np.zeros((50, 70, 4), np.uint8)
        for k in range(n):
            image = rng.integers(0, 256, (int(rng.integers(1, 30)), int(rng.integers(1, 40)), 4), dtype=np.uint8)
            left, top = (500, -90) if scene_id == 3 else (int(rng.integers(-20, 75)), int(rng.integers(-20, 55)))
            paste(canvas, image, left, top, masked=True)
            rows.append((scene_id, k, left, top, image.shape[1], image.shape[0], bytearray(image.tobytes())))
        expected[scene_id] = canvas.tobytes()
    items = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "scene_id long, draw_order int, left int, top int, item_width int, item_height int, rgba binary")
    found = scene.preview(items, 70, 50, tile=16)
    assert {r.scene_id: bytes(r.rgba) for r in found.collect()} == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow draw") < plan.index("RepartitionByExpression")

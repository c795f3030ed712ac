import hashlib
import random
import re

from pyspark.sql import functions as F

from mosaicflow.functions import catalog, prompts, scalars
from mosaicflow.operators import kernels


def test_labels_fit_grids():
    for mode, (rows, cols) in catalog.GRID_SHAPES.items():
        assert len(catalog.FRAME_LABELS[mode]) == rows * cols


def test_slug_and_seed(spark):
    texts = ["  Hello, World! ", "", "---", "Ünïcode ß 12", "a__b", None, "x" * 5000 + " y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.slug(F.col("t")).alias("s"), scalars.stable_seed(F.lit("npc"), F.lit("npc"), F.col("t"), F.lit(None)).alias("n")).collect()
    for t, s, n in rows:
        t = t or ""
        assert s == (re.sub(r"[^a-zA-Z0-9]+", "-", t.strip().lower()).strip("-") or "sprite")
        assert n == int(hashlib.sha256(f"npc|npc|{t}|".encode()).hexdigest()[:8], 16)


def test_placement_matches_arithmetic(spark):
    cases = [(w, h, c, f, a) for w, h in ((10, 7), (96, 96), (1, 40), (0, 5), (333, 100)) for c in (128, 96, 256) for f in (0.85, 0.9, 1.2) for a in ("center", "feet")]
    for w, h, cell, fit, align in cases:
        frame = spark.createDataFrame([(w, h)], "w int, h int")
        got = frame.select(*[c.alias(k) for k, c in scalars.placement(F.col("w"), F.col("h"), cell, fit, align).items()]).first()
        assert kernels.placement(w, h, cell, fit, align) == got.asDict() or not (w and h)
        if not (w and h):
            assert tuple(got)[:3] == (0, 0, 0)
            continue
        scale = min(cell / w, cell / h) * fit
        nw, nh = max(1, int(w * scale)), max(1, int(h * scale))
        pad = max(0, int(cell * (1 - fit) * 0.5))
        assert tuple(got) == (nw, nh, (cell - nw) // 2, cell - nh - pad if align == "feet" else (cell - nh) // 2)


def test_empty_and_zero_take_the_default(spark):
    got = spark.createDataFrame([(0, ""), (None, None), (5, "x")], "n int, s string").select(scalars.or_default(F.col("n"), 7).alias("n"), scalars.or_default(F.col("s"), "d").alias("s")).collect()
    assert [tuple(r) for r in got] == [(7, "d"), (7, "d"), (5, "x")]


def test_floor_division(spark):
    got = spark.createDataFrame([(-25, 2), (25, 2), (-24, 2)], "a int, b int").select(scalars.floor_div(F.col("a"), F.col("b")).alias("q")).collect()
    assert [r.q for r in got] == [-13, 12, -12]


def test_evolution_draws_like_the_standard_generator(spark):
    rng = random.Random(1234)
    expected = [rng.choice(x) for x in (catalog.ARCHETYPE_KEYS, catalog.SILHOUETTES, catalog.SURFACES, catalog.VIBES)]
    got = prompts.evolution_choices(spark.createDataFrame([(1234,)], "seed long")).first()
    assert [got.archetype, got.silhouette, got.surface, got.vibe] == expected


def test_prompts(spark):
    asked = [("creature", "evolution", "a fox", None, None), ("npc", "npc", "old man", "sage", None), ("npc", "npc", "x", "nobody", None), ("asset", "cast", "a spell", None, 5), ("asset", "sheet", "tree", "", None), ("dragon", "idle", "x", None, None)]
    requests = spark.createDataFrame(asked, "target string, mode string, prompt string, role string, seed long")
    got = {(r.target, r.mode): r for r in prompts.build_prompts(requests).collect()}
    assert set(got) == {("creature", "evolution"), ("npc", "npc"), ("asset", "cast"), ("asset", "sheet")}
    assert got["asset", "cast"].seed == 5 and "2x3" in got["asset", "cast"].generated_prompt
    assert "2x2" in got["asset", "sheet"].generated_prompt
    assert catalog.NPC_ROLES["sage"] in got["npc", "npc"].generated_prompt
    text = got["creature", "evolution"].generated_prompt
    assert all(f"stage {i}" in text for i in (1, 2, 3, 4)) and "{" not in text
    bad = {(r.target, r.reason) for r in prompts.invalid_requests(requests).collect()}
    assert bad == {("npc", "role"), ("dragon", "target")}


def test_options_document():
    import json

    document = json.loads(catalog.list_options())
    assert list(document) == ["targets", "npc_roles", "grid_shapes", "frame_labels", "processor"]
    assert document["processor"] == {"component_mode": ["all", "largest"], "align": ["center", "bottom", "feet"]}


def test_template_for_every_branch(spark):
    assert prompts.templates(spark).count() == sum(map(len, catalog.TARGET_MODES.values())) == 28

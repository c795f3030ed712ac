"""Registered queries and their SQL, all over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog, prompts, scalars
from ..operators import frames as fr
from ..operators import kernels
from ..operators import pixels as px
from ..operators import planner, scene
from ..sinks import files as files_sink
from ..sources import pictures, scenes
from ..sources import rasters as ra
from . import process as pr
from . import sql
from .qc import SMALL, made_sheets, parts, read, report
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def _pick(options: list, index) -> F.Column:
    return F.get(F.array(*[F.lit(x) for x in options]), index.cast("int"))


# Scalars


@query("SELECT doc_id, CAST('0x' || substr(sha256('creature|idle|' || coalesce(text, '') || '|' || coalesce(source, '')), 1, 8) AS BIGINT) AS seed FROM documents")
def stable_seed_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalars.stable_seed(F.lit("creature"), F.lit("idle"), F.col("text"), F.col("source")).alias("seed"))


_SLUG = "coalesce(nullif(trim(regexp_replace(lower(text), '[^a-zA-Z0-9]+', '-', 'g'), '-'), ''), 'sprite')"


@query(f"SELECT doc_id, sha256({_SLUG}) AS slug_sha256, CAST(length({_SLUG}) AS INTEGER) AS slug_length FROM documents")
def slug_documents(spark, sf_dir):
    slug = scalars.slug(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(slug.cast("binary"), 256).alias("slug_sha256"), F.length(slug).alias("slug_length"))


# Catalogs and prompts


@query(f"SELECT p_partkey AS sheet_id, mode, i AS frame_index, CAST(i // c AS INTEGER) AS grid_row, CAST(i % c AS INTEGER) AS grid_col, label FROM part JOIN {sql.FRAME_LABELS} ON number = p_partkey % 20")
def label_frames(spark, sf_dir):
    modes = list(catalog.GRID_SHAPES)
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sheet_id"), _pick(modes, F.col("p_partkey") % len(modes)).alias("mode"))
    rows = rows.join(F.broadcast(catalog.grid_shapes(spark)), "mode").join(F.broadcast(catalog.frame_labels(spark)), "mode")
    return rows.select("sheet_id", "mode", "frame_index", F.floor(F.col("frame_index") / F.col("grid_cols")).cast("int").alias("grid_row"), (F.col("frame_index") % F.col("grid_cols")).alias("grid_col"), "label")


@query(
    f"SELECT p_partkey AS sheet_id, mode, coalesce(r, 2) AS grid_rows, coalesce(c, 2) AS grid_cols, CASE WHEN p_size % 3 > 0 THEN (p_size % 3) * 48 WHEN r = 4 AND c = 4 THEN 96 ELSE 128 END AS cell_size FROM "
    f"(SELECT p_partkey, p_size, coalesce(mode, CASE p_partkey % 22 WHEN 20 THEN 'sheet' ELSE 'none' END) AS mode, r, c FROM part LEFT JOIN {sql.SHAPES} ON number = p_partkey % 22)"
)
def default_shapes(spark, sf_dir):
    modes = [*catalog.GRID_SHAPES, "sheet", "none"]
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sheet_id"), _pick(modes, F.col("p_partkey") % len(modes)).alias("mode"), ((F.col("p_size") % 3) * 48).alias("asked"))
    rows = rows.join(F.broadcast(catalog.grid_shapes(spark)), "mode", "left")
    size = scalars.default_cell_size(F.col("asked"), F.col("grid_rows"), F.col("grid_cols"))
    return rows.select("sheet_id", "mode", F.coalesce("grid_rows", F.lit(2)).alias("grid_rows"), F.coalesce("grid_cols", F.lit(2)).alias("grid_cols"), size.alias("cell_size"))


_TARGETS = [*catalog.TARGET_MODES, "dragon"]
_MODES = list(dict.fromkeys(m for modes in catalog.TARGET_MODES.values() for m in modes))
_ROLES = ["", "healer", "guard", "nobody"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each part: target, mode and role by its key and size, known or not."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("request_id"), _pick(_TARGETS, key % len(_TARGETS)).alias("target"), _pick(_MODES, (key + F.col("p_size")) % len(_MODES)).alias("mode"), F.col("p_name").alias("prompt"),
        _pick(_ROLES, F.col("p_size") % len(_ROLES)).alias("role"), F.when(F.col("p_size") % 9 == 0, key).alias("seed"),
    )


# Fixed values, written out so that a wrong entry of the Python tables shows.
_ASKED_TARGETS = ["creature", "player", "npc", "asset", "dragon"]
_ASKED_MODES = (
    "single evolution idle combat walk actions player player_walk player_sheet player_actions npc npc_walk cast attack hurt run hover charge projectile impact explode death fx sheet"
).split()
_ASKED_ROLES = ["", "healer", "guard", "nobody"]
_REQUESTS = (
    f"SELECT p_partkey AS request_id, {sql.choice(_ASKED_TARGETS, 'p_partkey % 5')} AS target, {sql.choice(_ASKED_MODES, '(p_partkey + p_size) % 24')} AS mode, p_name AS prompt, "
    f"{sql.choice(_ASKED_ROLES, 'p_size % 4')} AS role, CASE WHEN p_size % 9 = 0 THEN p_partkey END AS seed FROM part"
)


@query(
    f"""WITH q AS ({_REQUESTS}), known AS (SELECT target AS t, m FROM {sql.MODES}, unnest(string_split(modes, ',')) AS u(m)), r AS (SELECT *, CASE WHEN target NOT IN ('creature', 'player', 'npc', 'asset') THEN 'target'
    WHEN NOT EXISTS (SELECT 1 FROM known WHERE t = target AND m = mode) THEN 'mode' WHEN target = 'npc' AND role NOT IN (SELECT unnest(string_split('{sql.ROLE_KEYS}', ','))) THEN 'role' END AS reason FROM q)
    SELECT request_id, target, mode, role, reason FROM r WHERE reason IS NOT NULL"""
)
def invalid_mode_pairs(spark, sf_dir):
    return prompts.invalid_requests(requests(spark, sf_dir)).select("request_id", "target", "mode", "role", "reason")


@query(
    f"""WITH q AS ({_REQUESTS}) SELECT request_id, o.* FROM q JOIN ({sql.options()}) AS o ON list_contains([target, mode, role, CASE WHEN request_id % 2 = 0 THEN 'align' ELSE 'component_mode' END], key)"""
)
def list_options_flat(spark, sf_dir):
    """The options that bear on each part's request, by its target, mode and role; of roles the keys, as what is said of them is our own."""
    options = catalog.options_flat(spark).withColumn("value", F.when(F.col("catalog") != "npc_roles", F.col("value")))
    key = F.explode(F.array_distinct(F.array("target", "mode", "role", F.when(F.col("request_id") % 2 == 0, "align").otherwise("component_mode")))).alias("key")
    return requests(spark, sf_dir).select("request_id", key).join(F.broadcast(options), "key").select("request_id", "catalog", "key", "pos", "value")


_STEPS = ["background", "grid", "components", "edge", "scale", "align", "animation"]
_OBSTACLES = [*catalog.OBSTACLE_SHAPES, "statue"]


@query(
    f"""WITH n(step, n) AS (VALUES ('background', 2), ('grid', 2), ('components', 2), ('edge', 1), ('scale', 1), ('align', 1), ('animation', 1)),
    s AS (SELECT p_partkey AS request_id, p_partkey % 20 AS k, {sql.choice(["background", "grid", "components", "edge", "scale", "align", "animation"], "p_partkey % 7")} AS step, {sql.choice(["1x4", "2x2", "2x3", "3x3", "4x4"], "p_partkey % 5")} AS preset,
      {sql.choice(["lantern", "rock", "tree", "basin", "fence", "wall", "building", "gate", "bridge", "post", "statue"], "p_size % 11")} AS obstacle FROM part),
    u AS (SELECT preset, r * 10 + c AS shape, count(*) AS uses FROM {sql.PRESETS} GROUP BY ALL), o AS (SELECT obstacle, shape AS blocker FROM {sql.OBSTACLES}), f AS (SELECT number AS k, r * c AS cells FROM {sql.SHAPES})
    SELECT request_id, step, CAST(n AS INTEGER) AS n_rules, preset, CAST(shape AS INTEGER) AS shape, CAST(uses AS INTEGER) AS n_uses, obstacle, blocker, CAST(cells AS INTEGER) AS n_cells
    FROM s JOIN n USING (step) JOIN u USING (preset) LEFT JOIN o USING (obstacle) JOIN f USING (k)"""
)
def planner_catalogs(spark, sf_dir):
    """For each part: how many rules its step has, its preset with shape and number of uses, its obstacle's blocker, and how many cells its mode's rules name."""
    key = F.col("p_partkey")
    asked = read(spark, sf_dir, "part").select(key.alias("request_id"), _pick(_STEPS, key % 7).alias("step"), _pick(list(catalog.SHEET_PRESETS), key % 5).alias("preset"), _pick(_OBSTACLES, F.col("p_size") % 11).alias("obstacle"), _pick(list(catalog.GRID_SHAPES), key % 20).alias("mode"))
    counted = catalog.prompt_rules(spark).groupBy("step", "applies_to").agg(F.count("*").cast("int").alias("n"))
    steps = counted.where("step <> 'cell'").groupBy("step").agg(F.sum("n").cast("int").alias("n_rules"))
    cells = counted.where("step = 'cell'").select(F.col("applies_to").alias("mode"), F.col("n").alias("n_cells"))
    presets = catalog.sheet_presets(spark).groupBy("preset", (F.col("grid_rows") * 10 + F.col("grid_cols")).alias("shape")).agg(F.count("*").cast("int").alias("n_uses"))
    obstacles = catalog.obstacle_shapes(spark).withColumnRenamed("shape", "blocker")
    found = asked.join(F.broadcast(steps), "step").join(F.broadcast(presets), "preset").join(F.broadcast(obstacles), "obstacle", "left").join(F.broadcast(cells), "mode")
    return found.select("request_id", "step", "n_rules", "preset", "shape", "n_uses", "obstacle", "blocker", "n_cells")


# The sentences that prompts are put together from, written out.
_MONSTER = "Original monster as pixel art, outlined, on flat #FF00FF, no letters."
_OVERWORLD = "Overworld figure as 16-bit pixel art, outlined, seen from a raised three-quarter view, on flat #FF00FF, no letters."
_GRID4 = "Four equal cells, two by two, without lines."
_WHO = """CASE role WHEN 'healer' THEN 'Who holds a steaming cup, a rolled bandage on the belt. ' WHEN 'guard' THEN 'Who stands at attention with a shield and a lantern. ' END"""
_CELLS = f"""array_to_string(list_transform(range(1, 5), lambda i: list_extract(labels, i) || ' in the ' || list_extract(['top left', 'top right', 'bottom left', 'bottom right'], i)), ', ')"""


_PROMPTS = f"""WITH q AS ({_REQUESTS}), known AS (SELECT target AS t, m FROM {sql.MODES}, unnest(string_split(modes, ',')) AS u(m)),
    s AS (SELECT q.*, r, c, string_split({sql.LABELS_OF}, ',') AS labels, CASE WHEN target = 'npc' THEN {_WHO} ELSE '' END AS who, CASE WHEN target IN ('creature', 'asset') THEN '{_MONSTER}' ELSE '{_OVERWORLD}' END AS style
    FROM q JOIN known ON t = target AND m = q.mode LEFT JOIN (SELECT mode AS shape_mode, r, c FROM {sql.SHAPES}) ON shape_mode = q.mode WHERE q.mode <> 'evolution')
    SELECT target, mode, prompt, role, coalesce(seed, CAST('0x' || substr(sha256(target || '|' || mode || '|' || prompt || '|' || role), 1, 8) AS BIGINT)) AS seed,
    CASE WHEN target = 'asset' AND mode <> 'single' THEN prompt || ', animated in ' || coalesce(r, 2) || 'x' || coalesce(c, 2) || ' cells of one scale. ' || style
    WHEN mode = 'player_sheet' THEN prompt || ', walking: row 1 down, row 2 left, row 3 right, row 4 up. ' || style || ' Sixteen equal cells, four by four, without lines.'
    WHEN mode IN ('single', 'player', 'npc') THEN prompt || ', once. ' || who || style
    ELSE prompt || ', ' || CASE mode WHEN 'idle' THEN 'resting' WHEN 'combat' THEN 'fighting' WHEN 'walk' THEN 'walking' WHEN 'player_walk' THEN 'walking down' WHEN 'npc_walk' THEN 'walking down' ELSE 'acting' END || ': ' || {_CELLS} || '. ' || who || style || ' {_GRID4}' END AS generated_prompt
    FROM s WHERE who IS NOT NULL"""


@query(_PROMPTS)
def build_prompts(spark, sf_dir):
    return prompts.build_prompts(requests(spark, sf_dir).where("mode <> 'evolution'"))


@query(_PROMPTS)
def prompt_payloads(spark, sf_dir):
    """The same prompts, as the JSON lines that their sink writes, read back."""
    folder = files_sink.shared_folder(spark)
    files_sink.write_prompts(prompts.build_prompts(requests(spark, sf_dir).where("mode <> 'evolution'")), folder)
    return spark.read.schema("target string, mode string, prompt string, role string, seed long, generated_prompt string").json(f"{folder}/json")


@query()
def evolution_choice(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", scalars.stable_seed(F.lit("creature"), F.lit("evolution"), F.col("text"), F.lit("")).alias("seed"))
    return prompts.evolution_choices(rows)


@query()
def evolution_prompts(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.lit("creature").alias("target"), F.lit("evolution").alias("mode"), F.col("p_name").alias("prompt"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("long").alias("seed"))
    return prompts.build_prompts(rows)


# Planner

_BUNDLES = list(catalog.BUNDLES)


@query(f"SELECT p_partkey AS request_id, bundle, CAST(pos AS INTEGER) AS pos, asset FROM part JOIN {sql.BUNDLES} ON number = p_partkey % 5 AND d = 1")
def bundle_expand(spark, sf_dir):
    wanted = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), _pick(_BUNDLES, F.col("p_partkey") % len(_BUNDLES)).alias("bundle"))
    return planner.expand_bundles(wanted).select("request_id", "bundle", "pos", "asset")


_HINTS = [*catalog.REQUEST_HINTS, "make something else"]


@query(f"SELECT p_partkey AS request_id, request, t AS asset_type, a AS action, p AS preset, r AS role FROM part JOIN {sql.HINTS} ON number = p_partkey % 10")
def request_plan(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), _pick(_HINTS, F.col("p_partkey") % len(_HINTS)).alias("request"))
    return planner.plan_requests(rows).select("request_id", "request", "asset_type", "action", "preset", "role")


_ACTIONS = ["single", "idle", "cast", "attack", "projectile", "death", "player_sheet", "walk"]
_TYPES = ["player", "projectile", "impact", "prop", "other"]


@query(
    f"""WITH a AS (SELECT p_partkey AS request_id, {sql.choice(_ACTIONS, f"p_partkey % {len(_ACTIONS)}")} AS action, {sql.choice(_TYPES, f"p_size % {len(_TYPES)}")} AS asset_type, p_size FROM part)
    SELECT request_id, action, asset_type, CASE WHEN action = 'single' THEN '1x1' WHEN p_size > 40 AND action = 'idle' THEN '3x3' WHEN action = 'projectile' THEN '1x4' WHEN action IN ('cast', 'death') THEN '2x3'
    WHEN action = 'player_sheet' THEN '4x4' ELSE '2x2' END AS shape, action <> 'single' AS shared_scale, CASE WHEN asset_type IN ('player', 'prop') THEN 'feet' ELSE 'center' END AS align,
    CASE WHEN p_size % 2 = 0 THEN 'largest' ELSE 'all' END AS component_mode FROM a"""
)
def sheet_plan(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), _pick(_ACTIONS, F.col("p_partkey") % len(_ACTIONS)).alias("action"), _pick(_TYPES, F.col("p_size") % len(_TYPES)).alias("asset_type"), "p_size")
    frames = F.when(F.col("action") == "single", 1).otherwise(4)
    rows = rows.withColumn("shape", planner.sheet_shape(F.col("action"), F.col("p_size") > 40))
    return rows.withColumns(planner.processor_defaults(F.col("asset_type"), frames, F.col("p_size") % 2 == 0)).drop("p_size")


@query(
    """WITH s AS (SELECT event_id AS map_id, event_id % 11 = 0 AS tiles, event_id % 2 = 0 AS precise, event_id % 3 = 0 AS occ, event_id % 5 = 0 AS act, user_id % 2 = 0 AS few, user_id % 3 = 0 AS coarse FROM events),
    t AS (SELECT map_id, CASE WHEN tiles THEN 'tilemap' WHEN (precise OR occ OR act) AND NOT few THEN 'layered' WHEN precise OR occ OR act THEN 'hybrid' WHEN coarse THEN 'single_collision' ELSE 'single' END AS strategy FROM s)
    SELECT map_id, strategy, CASE strategy WHEN 'single' THEN 'single_collision' WHEN 'single_collision' THEN 'hybrid' WHEN 'hybrid' THEN 'layered' ELSE 'tilemap' END AS next_strategy FROM t"""
)
def map_strategy(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id")
    rows = read(spark, sf_dir, "events").select(n.alias("map_id"), planner.map_strategy(n % 11 == 0, n % 2 == 0, n % 3 == 0, n % 5 == 0, u % 2 == 0, u % 3 == 0).alias("strategy"))
    return rows.withColumn("next_strategy", planner.escalate(F.col("strategy")))


# Pixels and frames


@query(
    f"""{sql.BASE} SELECT sheet_id, count(*) FILTER (a > 0) AS visible, count(*) FILTER (a = 0) AS cleared, CAST(sum(CASE WHEN a > 0 THEN r + g + b ELSE 0 END) AS BIGINT) AS colour,
    count(*) FILTER (a >= 128) AS opaque FROM keyed GROUP BY 1"""
)
def chroma_key_counts(spark, sf_dir):
    keyed = px.chroma_key(ra.part_pixels(parts(spark, sf_dir, "p_partkey")))
    seen = F.col("a") > 0
    return keyed.groupBy("sheet_id").agg(
        F.count_if(seen).alias("visible"), F.count_if(~seen).alias("cleared"), F.sum(F.when(seen, F.col("r") + F.col("g") + F.col("b")).otherwise(0)).alias("colour"), F.count_if(F.col("a") >= 128).alias("opaque")
    )


@query(f"{sql.BASE}, {sql.FLOOD} SELECT sheet_id, count(*) AS visible, CAST(sum(y * 32 + x) AS BIGINT) AS places, CAST(sum((y * 32 + x) * (r + 3 * g + 7 * b + a)) AS BIGINT) AS content FROM clean GROUP BY 1")
def flood_fill_pixels(spark, sf_dir):
    clean = ra.pixels(made_sheets(spark, sf_dir), kernels.remove_background).where("a > 0")
    place = F.col("y") * 32 + F.col("x")
    return clean.groupBy("sheet_id").agg(F.count("*").alias("visible"), F.sum(place).alias("places"), F.sum(place * (F.col("r") + 3 * F.col("g") + 7 * F.col("b") + F.col("a"))).alias("content"))


_TRIMMED = "WITH RECURSIVE " + sql.PIX + """, c AS (SELECT sheet_id, y // 10 AS grid_row, x // 10 AS grid_col, x % 10 - 1 AS x, y % 10 - 1 AS y, r, g, b, a FROM pix WHERE x < 30 AND y < 30),
t AS (SELECT * FROM c WHERE x >= 0 AND y >= 0 AND x < 8 AND y < 8)"""


@query(f"{_TRIMMED} SELECT sheet_id, CAST(grid_row AS INTEGER) AS grid_row, CAST(grid_col AS INTEGER) AS grid_col, count(*) AS n_pixels, CAST(sum(x * 3 + y * 5 + r) AS BIGINT) AS content FROM t GROUP BY ALL")
def grid_split_cells(spark, sf_dir):
    cells = px.split_cells(ra.part_pixels(parts(spark, sf_dir, "p_partkey")), 32, 32, 3, 3, 1)
    return cells.groupBy("sheet_id", "grid_row", "grid_col").agg(F.count("*").alias("n_pixels"), F.sum(F.col("x") * 3 + F.col("y") * 5 + F.col("r")).alias("content"))


@query(
    f"""{_TRIMMED}, e AS (SELECT *, least(x, y, 7 - x, 7 - y) < 2 AND a <> 0 AND ((r < 40 AND g < 40 AND b < 40) OR {sql.d2()} < 22500) AS gone FROM t)
    SELECT sheet_id, CAST(grid_row AS INTEGER) AS grid_row, CAST(grid_col AS INTEGER) AS grid_col, count(*) FILTER (NOT gone) AS visible,
    CAST(min(x) FILTER (NOT gone) AS INTEGER) AS x0, CAST(min(y) FILTER (NOT gone) AS INTEGER) AS y0, CAST(max(x) FILTER (NOT gone) + 1 AS INTEGER) AS x1, CAST(max(y) FILTER (NOT gone) + 1 AS INTEGER) AS y1 FROM e GROUP BY ALL"""
)
def edge_clean_ring(spark, sf_dir):
    cells = px.split_cells(ra.part_pixels(parts(spark, sf_dir, "p_partkey")), 32, 32, 3, 3, 1)
    return px.visible_boxes(px.clean_ring(cells, 8, 8, 2), "sheet_id", "grid_row", "grid_col")


@query(
    f"""{sql.ALL} SELECT sheet_id, {sql.ints("grid_row", "grid_col", "rank")}, area, {sql.ints("x0", "y0", "x1", "y1")}, CAST(label % 64 AS INTEGER) AS first_x, CAST(label // 64 AS INTEGER) AS first_y,
    x0 = 0 OR y0 = 0 OR x1 = {sql.SIDE} OR y1 = {sql.SIDE} AS touches_edge FROM ranked"""
)
def component_table(spark, sf_dir):
    return fr.component_table(made_sheets(spark, sf_dir), SMALL)


@query(f"{sql.ALL} SELECT sheet_id, {sql.ints('grid_row', 'grid_col')}, area, {sql.ints('x0', 'y0', 'x1', 'y1')} FROM ranked WHERE rank = 1")
def largest_component_topk(spark, sf_dir):
    found = fr.component_table(made_sheets(spark, sf_dir), SMALL)
    return fr.largest_per_frame(found).select("sheet_id", "grid_row", "grid_col", "area", "x0", "y0", "x1", "y1")


_QC = f"{sql.ALL} SELECT sheet_id, {sql.ints('grid_row', 'grid_col')}, component_count, selected_area, {sql.ints('x0', 'y0', 'x1', 'y1')}, "


@query(f"{_QC} {sql.touch(16)} AS edge_touch FROM frame")
def frame_qc_compat(spark, sf_dir):
    return report(made_sheets(spark, sf_dir))


@query(f"{_QC} {sql.touch(sql.SIDE)} AS edge_touch FROM frame")
def frame_qc_symmetric(spark, sf_dir):
    return report(made_sheets(spark, sf_dir), SMALL.but(symmetric=True))


@query(
    f"""{sql.ALL}, m AS (SELECT sheet_id, max(frame_width) AS mw, max(frame_height) AS mh FROM sized GROUP BY 1),
    s AS (SELECT f.*, least(24.0::DOUBLE / mw, 24.0::DOUBLE / mh) * 0.85::DOUBLE AS scale FROM sized f JOIN m USING (sheet_id)),
    n AS (SELECT *, greatest(1, CAST(floor(frame_width * scale) AS INTEGER)) AS new_w, greatest(1, CAST(floor(frame_height * scale) AS INTEGER)) AS new_h FROM s)
    SELECT sheet_id, {sql.ints("grid_row", "grid_col")}, {sql.ints("frame_width", "frame_height")}, new_w, new_h, CAST(floor((24 - new_w) / 2) AS INTEGER) AS paste_x, 24 - new_h - 1 AS paste_y FROM n"""
)
def shared_scale_placement(spark, sf_dir):
    p = SMALL.but(shared_scale=True, align="feet")
    found = fr.placed(fr.cut(made_sheets(spark, sf_dir), p, with_pixels=False), p)
    return found.select("sheet_id", "grid_row", "grid_col", "frame_width", "frame_height", "new_w", "new_h", "paste_x", "paste_y")


@query(
    f"""{sql.ALL} SELECT sheet_id, coalesce(string_agg(CASE WHEN {sql.touch(sql.SIDE)} THEN grid_row || ':' || grid_col END, ',' ORDER BY grid_row, grid_col), '') AS flagged FROM frame GROUP BY 1"""
)
def edge_touch_frames(spark, sf_dir):
    p = SMALL.but(symmetric=True)
    return fr.edge_touch_frames(fr.checked(fr.cut(made_sheets(spark, sf_dir), p, with_pixels=False), p))


# Rasters


@query()
def resize_frames(spark, sf_dir):
    done = pr.frame_rows(made_sheets(spark, sf_dir), SMALL)
    return done.select("sheet_id", "grid_row", "grid_col", "new_w", "new_h", "paste_x", "paste_y", F.md5("canvas").alias("canvas_md5"))


@query()
def process_sheets(spark, sf_dir):
    ask = pr.Request("creature", "idle", "a part", cell_size=24, **{k: v for k, v in SMALL.as_dict().items() if k not in ("rows", "cols", "cell_size")})
    return pr.process(made_sheets(spark, sf_dir), ask).select("sheet_id", "name", F.length("content").alias("size"), F.md5("content").alias("content_md5"))


@query()
def process_singles(spark, sf_dir):
    return pr.process(made_sheets(spark, sf_dir), pr.Request("asset", "single", single_size=48)).select("sheet_id", "name", F.length("content").alias("size"), F.md5("content").alias("content_md5"))


#: Frames are whole cells at scale 1 and nothing is cleared, so every picture is known pixel by pixel.
EXACT = {"fit_scale": 1.0, "trim_border": 0, "edge_clean_depth": 0, "threshold": 0, "edge_threshold": 0}
_COMBAT, _DIRECTIONS = ["attack-1", "attack-2", "hurt-1", "hurt-2"], ["down", "left", "right", "up"]


def picture_sums(files: DataFrame) -> DataFrame:
    """(sheet_id, name, frame, visible, content) of all pictures among FILES, decoded again."""
    return ra.sums(pr.decoded(files), ["sheet_id", "name", "frame"])


@query(sql.exact_pictures(16, _COMBAT, []))
def exact_sheet_pictures(spark, sf_dir):
    return picture_sums(pr.process(made_sheets(spark, sf_dir), pr.Request("creature", "combat", cell_size=16, **EXACT)))


@query(sql.exact_pictures(8, [f"{d}-{i}" for d in _DIRECTIONS for i in (1, 2, 3, 4)], _DIRECTIONS))
def exact_player_pictures(spark, sf_dir):
    return picture_sums(pr.process(made_sheets(spark, sf_dir), pr.Request("player", "player_sheet", cell_size=8, shared_scale=True, **EXACT)))


@query(
    f"""{sql.BASE}, {sql.FLOOD} SELECT sheet_id, 'raw-sheet.png' AS name, 0 AS frame, {sql.sums("x", "y", 32)} FROM pix GROUP BY 1
    UNION ALL SELECT sheet_id, 'raw-sheet-clean.png', 0, {sql.sums("x", "y", 32)} FROM clean GROUP BY 1"""
)
def clean_sheet_pictures(spark, sf_dir):
    return picture_sums(pr.process(made_sheets(spark, sf_dir), pr.Request("asset", "none", rows=1, cols=1), only=["raw-sheet.png", "raw-sheet-clean.png"]))


@query(
    f"""WITH {sql.PIX} SELECT sheet_id, name, CAST(CASE name WHEN 'raw.png' THEN sum(x + 2 * y + r + 3 * g + 5 * b + 7 * a) END AS BIGINT) AS content FROM pix, (VALUES ('raw.png'), ('clean.png'), ('pipeline-meta.json'), ('prompt-used.txt')) AS t(name) GROUP BY sheet_id, name"""
)
def single_sprite_files(spark, sf_dir):
    return pr.weighted_sums(pr.process(made_sheets(spark, sf_dir), pr.Request("asset", "single", "a part", single_size=48)), "raw.png")


_STRIP = ["raw-sheet.png", "raw-sheet-clean.png", "bit-1.png", "bit-2.png", "bit-3.png", "bit-4.png", "sheet-transparent.png", "animation.gif", "pipeline-meta.json", "prompt-used.txt"]


@query(f"SELECT p_partkey AS sheet_id, name, CASE name WHEN 'prompt-used.txt' THEN sha256('four bits') END AS content_sha256 FROM part, unnest(string_split('{','.join(_STRIP)}', ',')) AS u(name)")
def custom_grid_files(spark, sf_dir):
    files = pr.process(made_sheets(spark, sf_dir), pr.Request("asset", "bits", "bits", rows=1, cols=4, label_prefix="bit", prompt_text="four bits", cell_size=12, trim_border=0))
    return files.select("sheet_id", "name", F.when(F.col("name") == "prompt-used.txt", F.sha2("content", 256)).alias("content_sha256"))


_META = "grid array<int>, source_box array<int>, component_mode string, component_count int, selected_component_area int, selected_component_bbox array<int>, crop_bbox array<int>, edge_touch boolean, output_size array<int>, paste_position array<int>"
_META = f"target string, mode string, prompt string, role string, input string, threshold double, edge_threshold double, duration int, rows int, cols int, cell_size int, fit_scale double, align string, component_mode string, min_component_area int, frame_labels array<string>, frames array<struct<{_META}>>, edge_touch_frames array<array<int>>".replace(": ", ":")
_AREA = 6


def _boxed(*names: str) -> str:
    return "array_to_string([" + ", ".join(f"CAST({n} AS INTEGER)" for n in names) + "], ',')"


@query(
    f"""{sql.BASE}, {sql.FLOOD}, {sql.VISIBLE}, {sql.LABELS.replace("FROM lab GROUP BY ALL", f"FROM lab GROUP BY ALL HAVING count(*) >= {_AREA}")}, seen AS (SELECT sheet_id, grid_row, grid_col, min(x) AS vx0, min(y) AS vy0, max(x) + 1 AS vx1, max(y) + 1 AS vy1 FROM vis GROUP BY ALL),
    grid AS (SELECT p_partkey AS sheet_id, gr AS grid_row, gc AS grid_col FROM part, range(2) AS a(gr), range(2) AS b(gc)), counted AS (SELECT sheet_id, grid_row, grid_col, count(*) AS n FROM comp GROUP BY ALL),
    f AS (SELECT g.*, coalesce(n, 0) AS n, area, k.x0 AS sx0, k.y0 AS sy0, k.x1 AS sx1, k.y1 AS sy1, CASE WHEN area IS NULL THEN vx0 ELSE greatest(0, k.x0 - {sql.PAD}) END AS x0, CASE WHEN area IS NULL THEN vy0 ELSE greatest(0, k.y0 - {sql.PAD}) END AS y0,
      CASE WHEN area IS NULL THEN vx1 ELSE least({sql.SIDE}, k.x1 + {sql.PAD}) END AS x1, CASE WHEN area IS NULL THEN vy1 ELSE least({sql.SIDE}, k.y1 + {sql.PAD}) END AS y1
      FROM grid g LEFT JOIN counted USING (sheet_id, grid_row, grid_col) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) k USING (sheet_id, grid_row, grid_col) LEFT JOIN seen USING (sheet_id, grid_row, grid_col)),
    w AS (SELECT *, coalesce(x1 - x0, {sql.SIDE}) AS fw, coalesce(y1 - y0, {sql.SIDE}) AS fh, coalesce(x0 <= 2 OR y0 <= 2 OR x1 >= {sql.SIDE} - 2 OR y1 >= {sql.SIDE} - 2, false) AS edge_touch FROM f),
    z AS (SELECT *, greatest(1, CAST(floor(fw * (least(24.0::DOUBLE / fw, 24.0::DOUBLE / fh) * 0.85::DOUBLE)) AS INTEGER)) AS nw, greatest(1, CAST(floor(fh * (least(24.0::DOUBLE / fw, 24.0::DOUBLE / fh) * 0.85::DOUBLE)) AS INTEGER)) AS nh FROM w)
    SELECT sheet_id, 'creature|idle|a part||' AS asked, '100.0|150.0|200|2|2|24|0.85|center|largest|{_AREA}' AS settings, 'idle-' || (grid_row * 2 + grid_col + 1) AS label, {sql.ints("grid_row", "grid_col")}, {_boxed("grid_col * 16", "grid_row * 16", "grid_col * 16 + 16", "grid_row * 16 + 16")} AS source_box, CAST(n AS INTEGER) AS component_count,
    CAST(area AS INTEGER) AS selected_area, CASE WHEN sx0 IS NOT NULL THEN {_boxed("sx0", "sy0", "sx1", "sy1")} END AS selected_box, CASE WHEN x0 IS NOT NULL THEN {_boxed("x0", "y0", "x1", "y1")} END AS crop_box, edge_touch, {_boxed("nw", "nh")} AS output_size, {_boxed("floor((24 - nw) / 2)", "floor((24 - nh) / 2)")} AS paste_position,
    CAST(count(*) FILTER (edge_touch) OVER (PARTITION BY sheet_id) AS INTEGER) AS n_flagged FROM z"""
)
def sheet_metadata(spark, sf_dir):
    """The metadata file of each sheet, read back: what was asked for, and every frame's record."""
    p = SMALL.but(min_component_area=_AREA, edge_touch_margin=2, symmetric=True)
    ask = pr.Request("creature", "idle", "a part", **{k: v for k, v in p.as_dict().items() if k not in ("rows", "cols")})
    m = pr.process(made_sheets(spark, sf_dir), ask, only=["pipeline-meta.json"]).select("sheet_id", F.from_json(F.col("content").cast("string"), _META).alias("m")).select("sheet_id", "m.*")
    m = m.select("*", F.posexplode("frames").alias("i", "f"))
    text = lambda c: F.array_join(F.col(c), ",")
    return m.select(
        "sheet_id", F.concat_ws("|", "target", "mode", "prompt", "role", "input").alias("asked"), F.concat_ws("|", "threshold", "edge_threshold", "duration", "rows", "cols", "cell_size", "fit_scale", "align", "component_mode", "min_component_area").alias("settings"),
        F.get("frame_labels", F.col("i")).alias("label"), F.col("f.grid")[0].alias("grid_row"), F.col("f.grid")[1].alias("grid_col"), text("f.source_box").alias("source_box"), "f.component_count", F.col("f.selected_component_area").alias("selected_area"),
        text("f.selected_component_bbox").alias("selected_box"), text("f.crop_bbox").alias("crop_box"), "f.edge_touch", text("f.output_size").alias("output_size"), text("f.paste_position").alias("paste_position"), F.size("edge_touch_frames").alias("n_flagged"),
    )


@query(f"{sql.ALL} SELECT sheet_id, CAST(grid_row * 2 + grid_col AS INTEGER) AS frame_index, CASE grid_row * 2 + grid_col WHEN 0 THEN 'stage-1' WHEN 1 THEN 'stage-2' WHEN 2 THEN 'stage-3' END AS label, component_count FROM frame WHERE grid_row * 2 + grid_col < 3")
def labelled_frames(spark, sf_dir):
    """Labels by position, as a relation; a frame beyond the labels goes."""
    found = fr.labelled(fr.cut(made_sheets(spark, sf_dir), SMALL, with_pixels=False), catalog.FRAME_LABELS["evolution"][:3], SMALL.cols)
    return found.select("sheet_id", "frame_index", "label", "component_count")


@query(f"WITH {sql.PIX} SELECT sheet_id, 32 AS width, 32 AS height, {sql.sums('x', 'y', 32)} FROM pix GROUP BY 1")
def png_round_trip(spark, sf_dir):
    """Sheets written as PNG files by executors and found and read again by glob."""
    folder = files_sink.shared_folder(spark)
    files_sink.write_files(pr.process(made_sheets(spark, sf_dir), pr.Request("asset", "none"), only=["raw.png"]), folder)
    pictures.register(spark)
    found = spark.read.format("mosaic").option("glob", "raw.p*").schema("path string, width int, height int, rgba binary").load(folder)
    return ra.sums(found.withColumn("sheet_id", F.regexp_extract("path", r"/(\d+)/raw\.png$", 1).cast("long")), ["sheet_id", "width", "height"])


@query(f"WITH {sql.PIX} SELECT sheet_id, CAST(sheet_id AS VARCHAR) || '/raw.png' AS path, true AS whole, count(*) AS n_pixels FROM pix GROUP BY 1")
def file_manifest(spark, sf_dir):
    """The manifest of written files beside the files: where each is, whether it has the size that is told of it, and its pixels."""
    folder = files_sink.shared_folder(spark)
    told = files_sink.write_files(pr.process(made_sheets(spark, sf_dir), pr.Request("asset", "none"), only=["raw.png"]), folder)
    pictures.register(spark)
    found = spark.read.format("mosaic").schema("path string, size long, width int, height int").load(folder)
    relative = lambda c: F.regexp_extract(c, r"(\d+/raw\.png)$", 1)
    found = found.select(relative("path").alias("path"), F.col("size").alias("length"), (F.col("width") * F.col("height")).cast("long").alias("n_pixels"))
    return told.select("sheet_id", relative("path").alias("path"), "size").join(found, "path").select("sheet_id", "path", (F.col("size") == F.col("length")).alias("whole"), "n_pixels")


@query(f"{sql.ALL} SELECT sheet_id, 'pipeline-meta.json' AS name FROM frame GROUP BY 1 HAVING NOT bool_or({sql.touch(sql.SIDE)})")
def accepted_sheets(spark, sf_dir):
    """Sheets that are processed although frames that touch their cell's edge are rejected: those without any."""
    p = SMALL.but(symmetric=True)
    found = fr.checked(fr.cut(made_sheets(spark, sf_dir), p, with_pixels=False), p)
    whole = found.groupBy("sheet_id").agg(F.bool_or("edge_touch").alias("touch")).where("NOT touch")
    ask = pr.Request("creature", "idle", reject_edge_touch=True, **{k: v for k, v in p.as_dict().items() if k not in ("rows", "cols")})
    # Keys meet before sheets are made, so no pixel is shuffled.
    accepted = parts(spark, sf_dir, keep=lambda found: found.join(whole, F.col("p_partkey") == F.col("sheet_id"), "left_semi"))
    return pr.process(ra.made_of_parts(accepted), ask, only=["pipeline-meta.json"]).select("sheet_id", "name")


@query(
    """SELECT n_nationkey AS sheet_id, path, CAST(size AS BIGINT) AS size FROM (SELECT n_nationkey, 'assets/map/' || lower(n_name) || '-base.png' AS path, length(n_name) AS size FROM nation
    UNION ALL SELECT n_nationkey, 'assets/map/' || lower(n_name) || '-layered-preview.png', length(n_name) + 1 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'data/collision-map.json', 2 FROM nation WHERE n_nationkey % 3 = 0)"""
)
def map_files(spark, sf_dir):
    """Map pictures and collision data of a scene for each nation, as their manifest tells."""
    n, name = F.col("n_nationkey"), F.col("n_name")
    scenes_ = read(spark, sf_dir, "nation").select(n.cast("long").alias("scene_id"), F.lower(name).alias("name"), name.cast("binary").alias("base"), F.when(n % 2 == 0, F.concat(name, F.lit("+"))).cast("binary").alias("preview"), F.when(n % 3 == 0, "{}").alias("collision"))
    told = files_sink.write_files(files_sink.scene_files(scenes_), files_sink.shared_folder(spark))
    return told.select(F.col("sheet_id").cast("int").alias("sheet_id"), F.regexp_extract("path", r"/\d+/((?:assets|data)/.*)$", 1).alias("path"), "size")


def packed(spark: SparkSession, sf_dir: str) -> str:
    """A folder of packs with the raw and the cleaned picture of every sheet."""
    pictures.register(spark)
    folder = files_sink.shared_folder(spark)
    pr.process(made_sheets(spark, sf_dir), pr.Request("asset", "none", rows=1, cols=1), only=["raw-sheet.png", "raw-sheet-clean.png"]).write.format("mosaic").mode("append").save(folder)
    return folder


@query(f"{sql.BASE}, {sql.FLOOD} SELECT sheet_id, 'raw-sheet-clean.png' AS name, 32 AS width, 32 AS height, {sql.sums('x', 'y', 32)} FROM clean WHERE sheet_id >= 50 GROUP BY 1")
def packed_pictures(spark, sf_dir):
    """Cleaned pictures of sheets from number 50 on, from packs that executors wrote; the rest is left out by the index."""
    found = spark.read.format("mosaic").schema("sheet_id long, name string, width int, height int, rgba binary").load(packed(spark, sf_dir))
    return ra.sums(found.where("name = 'raw-sheet-clean.png' AND sheet_id >= 50"), ["sheet_id", "name", "width", "height"])


@query("SELECT name, width, height, count(*) AS n FROM part, (VALUES ('raw-sheet.png', 32, 32), ('raw-sheet-clean.png', 32, 32)) AS v(name, width, height) GROUP BY ALL")
def picture_sizes(spark, sf_dir):
    """How many pictures of each size packs hold, from their first bytes."""
    found = spark.read.format("mosaic").schema("name string, width int, height int").load(packed(spark, sf_dir))
    return found.groupBy("name", "width", "height").agg(F.count("*").alias("n"))


# Scenes

_EXAMPLE = {
    "mapSize": {"width": 1672, "height": 941}, "spawn": {"x": 836, "y": 782}, "npc": {"x": 836, "y": 390, "collisionRadius": 32, "interactRadius": 112}, "rest": {"x": 760, "y": 548, "radius": 122},
    "zones": {"grass": {"x": 180, "y": 306, "w": 382, "h": 302}, "training": {"x": 1120, "y": 324, "w": 382, "h": 282}},
    "walkBounds": [{"id": "main-courtyard", "type": "ellipse", "x": 838, "y": 548, "rx": 604, "ry": 304}, {"id": "yard", "type": "polygon", "points": [{"x": 10, "y": 10}, {"x": 300, "y": 20}, {"x": 160, "y": 260}]}],
    "blockers": [{"id": "torii-left-pillar", "type": "rect", "x": 704, "y": 668, "w": 52, "h": 176}],
}


def example_shapes(spark: SparkSession) -> DataFrame:
    parsed = spark.createDataFrame([(0, json.dumps(_EXAMPLE))], "map_id int, json string").select("map_id", scenes.parse_collision(F.col("json")).alias("m")).select("map_id", "m.*")
    return scenes.shapes(parsed, "map_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), ((F.col("event_id") * 37) % 1700).cast("double").alias("px"), ((F.col("user_id") * 101 + F.col("event_id") * 13) % 950).cast("double").alias("py"))


_POINTS = "SELECT event_id AS point_id, CAST((event_id * 37) % 1700 AS DOUBLE) AS px, CAST((user_id * 101 + event_id * 13) % 950 AS DOUBLE) AS py FROM events"


def _edge(x0, y0, x1, y1) -> str:
    """Side of the edge a point of the triangle is on: 0 or more inside."""
    return f"({x1 - x0}) * (py - {y0}) - ({y1 - y0}) * (px - {x0})"


_TRIANGLE = " AND ".join(f"{_edge(*e)} >= 0" for e in ((10, 10, 300, 20), (300, 20, 160, 260), (160, 260, 10, 10)))
_ELLIPSE = "((px - 838) / 604) * ((px - 838) / 604) + ((py - 548) / 304) * ((py - 548) / 304) <= 1"


@query(f"SELECT point_id, px, py, (({_ELLIPSE}) OR ({_TRIANGLE})) AND NOT (px BETWEEN 704 AND 756 AND py BETWEEN 668 AND 844) AS walkable FROM ({_POINTS})")
def walkable_points(spark, sf_dir):
    return scene.walkable(points(spark, sf_dir), example_shapes(spark), "point_id")


@query(
    f"""SELECT point_id, z AS zone FROM ({_POINTS}) JOIN (VALUES ('grass', 180, 306, 382, 302), ('training', 1120, 324, 382, 282)) AS v(z, x, y, w, h) ON px BETWEEN x AND x + w AND py BETWEEN y AND y + h"""
)
def zone_hits(spark, sf_dir):
    found = scene.hits(points(spark, sf_dir), example_shapes(spark).where("role = 'zone'"))
    return found.select("point_id", F.col("shape_id").alias("zone"))


_LAYER = sql.choice(["base", "props", "actors", "foreground"], "s_suppkey % 4")


@query(f"SELECT s_nationkey AS scene_id, s_name AS id, {_LAYER} AS layer, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 4, s_suppkey % 13, s_name) AS INTEGER) AS draw_order FROM supplier")
def prop_y_sort(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    items = s.select(F.col("s_nationkey").alias("scene_id"), F.col("s_name").alias("id"), _pick(["base", "props", "actors", "foreground"], F.col("s_suppkey") % 4).alias("layer"), (F.col("s_suppkey") % 13).alias("sort_y"))
    return scene.render_order(items).drop("sort_y")


@query("SELECT s_name AS id, CAST(s_suppkey % 300 - 20 AS DOUBLE) AS \"left\", CAST(s_suppkey % 200 - 30 AS DOUBLE) AS \"top\", s_suppkey % 7 >= 5 AS image_missing, CASE WHEN s_suppkey % 3 = 0 THEN 'ellipse' WHEN s_suppkey % 3 = 1 THEN 'rect' ELSE 'polygon' END AS shape FROM supplier")
def prop_placement(spark, sf_dir):
    k = F.col("s_suppkey")
    props = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), (k % 7).cast("string").alias("imageKey"), (k % 300).cast("double").alias("x"), (k % 200).cast("double").alias("y"), F.lit(40.0).alias("w"), F.lit(30.0).alias("h"), _pick(["Tree", "fence", "statue"], k % 3).alias("obstacle"))
    images = spark.createDataFrame([(str(i),) for i in range(5)], "imageKey string")
    missing = scene.missing_images(props, images).select("id", F.lit(True).alias("gone"))
    boxes = scene.prop_boxes(props).join(missing, "id", "left")
    return boxes.select("id", "left", "top", F.coalesce("gone", F.lit(False)).alias("image_missing"), scene.blocker_shape(F.col("obstacle")).alias("shape"))


@query(
    f"""WITH RECURSIVE g AS (SELECT n_nationkey AS map_id, CAST(x AS INTEGER) AS gx, CAST(y AS INTEGER) AS gy FROM nation, range(40) AS a(x), range(40) AS b(y) WHERE (x * 7 + y * 13 + x * y + n_nationkey * 5) % 10 < 7),
    r AS (SELECT map_id, gx, gy FROM g WHERE gx = 0 OR gy = 39 UNION SELECT g.map_id, g.gx, g.gy FROM r, {sql.STEPS4}, g WHERE g.map_id = r.map_id AND g.gx = r.gx + ox AND g.gy = r.gy + oy)
    SELECT g.map_id, g.gx, g.gy, r.gx IS NOT NULL AS reached FROM g LEFT JOIN r ON g.map_id = r.map_id AND g.gx = r.gx AND g.gy = r.gy"""
)
def zone_reachability(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("map_id"), F.explode(F.sequence(F.lit(0), F.lit(1599))).alias("i"))
    g = n.select("map_id", (F.col("i") % 40).cast("int").alias("gx"), F.expr("i div 40").cast("int").alias("gy"))
    x, y = F.col("gx"), F.col("gy")
    g = g.withColumns({"walkable": (x * 7 + y * 13 + x * y + F.col("map_id") * 5) % 10 < 7, "start": (x == 0) | (y == 39)})
    return scene.reachable(g, ["map_id"]).where("walkable").select("map_id", "gx", "gy", "reached")


_CHECKS = [("spawn", 836.0, 782.0, True), ("npc", 836.0, 390.0, True), ("rest", 760.0, 548.0, True), ("grass", 371.0, 457.0, True), ("training", 1311.0, 465.0, True), ("gate", 836.0, 756.0, True), ("pillar", 730.0, 756.0, False), ("pillar edge", 750.0, 800.0, False), ("origin", 0.0, 0.0, False)]


_ASKED = "(VALUES (0, 'spawn', 836.0, 782.0, true), (1, 'npc', 836.0, 390.0, true), (2, 'rest', 760.0, 548.0, true), (3, 'grass', 371.0, 457.0, true), (4, 'training', 1311.0, 465.0, true), (5, 'gate', 836.0, 756.0, true), (6, 'pillar', 730.0, 756.0, false), (7, 'pillar edge', 750.0, 800.0, false), (8, 'origin', 0.0, 0.0, false)) AS v(k, point, x, y, expected)"


@query(
    f"""WITH a AS (SELECT s_suppkey AS check_id, point, CAST(x + s_suppkey % 7 - 3 AS DOUBLE) AS px, CAST(y + s_suppkey % 11 - 5 AS DOUBLE) AS py, expected FROM supplier JOIN {_ASKED} ON k = s_suppkey % 9),
    w AS (SELECT *, (({_ELLIPSE}) OR ({_TRIANGLE})) AND NOT (px BETWEEN 704 AND 756 AND py BETWEEN 668 AND 844) AS walkable FROM a) SELECT check_id, point, px, py, walkable, walkable = expected AS passed FROM w"""
)
def critical_points(spark, sf_dir):
    """For each supplier one of the points that a map must have right, a few steps off."""
    checks = spark.createDataFrame([(i, *c) for i, c in enumerate(_CHECKS)], "k long, point string, x double, y double, expected boolean")
    n = F.col("s_suppkey")
    asked = read(spark, sf_dir, "supplier").select(n.alias("check_id"), (n % 9).alias("k"), (n % 7 - 3).alias("dx"), (n % 11 - 5).alias("dy")).join(F.broadcast(checks), "k")
    asked = asked.select("check_id", "point", (F.col("x") + F.col("dx")).alias("px"), (F.col("y") + F.col("dy")).alias("py"), "expected")
    return scene.walkable(asked, example_shapes(spark), "check_id").select("check_id", "point", "px", "py", "walkable", (F.col("walkable") == F.col("expected")).alias("passed"))


@query(
    """SELECT p_partkey AS map_id, array_to_string(list_filter([CASE WHEN p_size % 4 = 0 THEN 'size' END, CASE WHEN p_size % 3 = 0 THEN 'alpha' END, CASE WHEN p_size % 5 = 0 THEN 'edge_touch' END, CASE WHEN p_size % 7 = 0 THEN 'collision' END], lambda x: x IS NOT NULL), ',') AS problems FROM part"""
)
def map_validation(spark, sf_dir):
    size = F.col("p_size")
    maps = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("map_id"), F.lit(100).alias("width"), F.lit(80).alias("height"), F.when(size % 4 == 0, 99).otherwise(100).alias("expected_width"), F.lit(80).alias("expected_height"),
        (size % 3 != 0).alias("has_alpha"), F.when(size % 5 == 0, "0:1").otherwise("").alias("edge_touch_frames"), F.when(size % 7 == 0, "{oops").otherwise(json.dumps(_EXAMPLE)).alias("collision"),
    )
    return scene.validation(maps).select("map_id", F.array_join("problems", ",").alias("problems"))


@query()
def scene_preview(spark, sf_dir):
    base = fr.centred(made_sheets(spark, sf_dir), 32)
    items = base.select((F.col("sheet_id") % 50).alias("scene_id"), F.lit("props").alias("layer"), (F.col("sheet_id") % 97).alias("sort_y"), F.col("sheet_id").alias("id"), (F.col("sheet_id") * 7 % 90).alias("left"), (F.col("sheet_id") % 97).alias("top"), F.col("width").alias("item_width"), F.col("height").alias("item_height"), "rgba")
    return scene.preview(scene.render_order(items), 128, 128).select("scene_id", "width", "height", F.md5("rgba").alias("rgba_md5"))

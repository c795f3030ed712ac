"""The same results in SQL, for an engine that has recursive queries with keys."""

from __future__ import annotations

from .qc import SMALL


def text(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


def choice(options, index: str) -> str:
    return f"list_extract([{', '.join(map(text, options))}], CAST({index} AS INTEGER) + 1)"


# Sheets of 32 x 32 pixels made from parts, four cells each.
PIX = """
pix0 AS (
  SELECT p_partkey AS sheet_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, p_size % 8 AS grow, p_partkey % 7 AS seven,
    x % 16 - 8 - (p_partkey % 5) * 2 + 4 AS dx, y % 16 - 8 AS dy
  FROM part, range(32) AS tx(x), range(32) AS ty(y)
), pix1 AS (
  SELECT *, CASE WHEN dx * dx + dy * dy <= 9 + grow AND NOT (dx = 0 AND dy = 0) THEN 1
    WHEN dx * dx + dy * dy <= 20 + grow THEN 2
    WHEN dx IN (6, 7) AND dy IN (-6, -5) THEN 3
    WHEN x % 16 = 1 AND y % 16 = 11 AND seven = 0 THEN 4 ELSE 5 END AS kind FROM pix0
), pix AS (
  SELECT sheet_id, x, y, CAST(CASE kind WHEN 1 THEN 40 + 3 * grow WHEN 2 THEN 180 WHEN 3 THEN 250 WHEN 4 THEN 10 ELSE 255 END AS INT) AS r,
    CASE kind WHEN 1 THEN 120 WHEN 2 THEN 80 WHEN 3 THEN 250 WHEN 4 THEN 10 ELSE 0 END AS g,
    CASE kind WHEN 1 THEN 40 WHEN 2 THEN 180 WHEN 3 THEN 40 WHEN 4 THEN 10 ELSE 255 END AS b,
    CASE WHEN kind = 3 AND seven = 1 THEN 90 ELSE 255 END AS a FROM pix1
)"""


def d2(p: str = "") -> str:
    return f"(({p}r - 255) * ({p}r - 255) + {p}g * {p}g + ({p}b - 255) * ({p}b - 255))"


KEYED = f"""
keyed AS (SELECT sheet_id, x, y, r, g, b, CASE WHEN a <> 0 AND {d2()} < 10000 THEN 0 ELSE a END AS a FROM pix),
passable AS (SELECT sheet_id, x, y FROM keyed WHERE a = 0 OR {d2()} < 22500)"""

STEPS8 = "(VALUES (-1,-1),(0,-1),(1,-1),(-1,0),(1,0),(-1,1),(0,1),(1,1)) AS o(ox, oy)"
STEPS4 = "(VALUES (0,-1),(-1,0),(1,0),(0,1)) AS o(ox, oy)"

FLOOD = f"""
flood AS (
  SELECT sheet_id, x, y FROM passable WHERE x IN (0, 31) OR y IN (0, 31)
  UNION
  SELECT p.sheet_id, p.x, p.y FROM flood f, {STEPS8}, passable p WHERE p.sheet_id = f.sheet_id AND p.x = f.x + ox AND p.y = f.y + oy
), clean AS (
  SELECT k.* FROM keyed k LEFT JOIN flood f ON k.sheet_id = f.sheet_id AND k.x = f.x AND k.y = f.y WHERE k.a > 0 AND f.x IS NULL
)"""

T, RING = SMALL.trim_border, SMALL.edge_clean_depth
SIDE = 16 - 2 * T
VISIBLE = f"""
cell AS (SELECT sheet_id, y // 16 AS grid_row, x // 16 AS grid_col, x % 16 - {T} AS x, y % 16 - {T} AS y, r, g, b, a FROM clean),
vis AS (
  SELECT sheet_id, grid_row, grid_col, x, y FROM cell
  WHERE x >= 0 AND y >= 0 AND x < {SIDE} AND y < {SIDE}
    AND NOT (least(x, y, {SIDE - 1} - x, {SIDE - 1} - y) < {RING} AND ((r < 40 AND g < 40 AND b < 40) OR {d2()} < 22500))
)"""

LABELS = f"""
lab(sheet_id, grid_row, grid_col, x, y, label) USING KEY (sheet_id, grid_row, grid_col, x, y) AS (
  SELECT sheet_id, grid_row, grid_col, x, y, y * 64 + x FROM vis
  UNION
  SELECT w.sheet_id, w.grid_row, w.grid_col, w.x, w.y, min(l.label)
  FROM lab l, {STEPS4}, recurring.lab w
  WHERE w.sheet_id = l.sheet_id AND w.grid_row = l.grid_row AND w.grid_col = l.grid_col AND w.x = l.x + ox AND w.y = l.y + oy AND l.label < w.label
  GROUP BY w.sheet_id, w.grid_row, w.grid_col, w.x, w.y
), comp AS (
  SELECT sheet_id, grid_row, grid_col, label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1
  FROM lab GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sheet_id, grid_row, grid_col ORDER BY area DESC, label) AS rank FROM comp
)"""

PAD = SMALL.component_padding
FRAMES = f"""
grid AS (SELECT p_partkey AS sheet_id, gr AS grid_row, gc AS grid_col FROM part, range(2) AS a(gr), range(2) AS b(gc)),
counted AS (SELECT sheet_id, grid_row, grid_col, count(*) AS n FROM comp GROUP BY ALL),
framed AS (
  SELECT g.sheet_id, g.grid_row, g.grid_col, coalesce(n, 0) AS component_count, area AS selected_area,
    greatest(0, x0 - {PAD}) AS x0, greatest(0, y0 - {PAD}) AS y0, least({SIDE}, x1 + {PAD}) AS x1, least({SIDE}, y1 + {PAD}) AS y1, area IS NULL AS none
  FROM grid g LEFT JOIN counted c USING (sheet_id, grid_row, grid_col) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) USING (sheet_id, grid_row, grid_col)
), frame AS (
  SELECT sheet_id, grid_row, grid_col, component_count, selected_area, CASE WHEN none THEN NULL ELSE x0 END AS x0, CASE WHEN none THEN NULL ELSE y0 END AS y0,
    CASE WHEN none THEN NULL ELSE x1 END AS x1, CASE WHEN none THEN NULL ELSE y1 END AS y1 FROM framed
), sized AS (SELECT *, coalesce(x1 - x0, {SIDE}) AS frame_width, coalesce(y1 - y0, {SIDE}) AS frame_height FROM frame)"""

BASE = f"WITH RECURSIVE {PIX}, {KEYED}"
ALL = f"{BASE}, {FLOOD}, {VISIBLE}, {LABELS}, {FRAMES}"
SMALL_INT = "CAST({0} AS INTEGER) AS {0}".format


def ints(*names: str) -> str:
    return ", ".join(map(SMALL_INT, names))


def touch(size: int) -> str:
    return f"coalesce(x0 <= 0 OR y0 <= 0 OR x1 >= {size} OR y1 >= {size}, false)"


# Catalogs written out, so a wrong entry of the Python tables shows. Fixed values, which results must match.
MODES = """(VALUES
('creature', 'single,evolution,idle,combat,walk,actions'), ('player', 'player,player_walk,player_sheet,player_actions'), ('npc', 'npc,npc_walk'),
('asset', 'single,idle,cast,attack,hurt,combat,walk,run,hover,charge,projectile,impact,explode,death,fx,sheet')) AS v(target, modes)"""
SHAPES = """(VALUES
(0, 'evolution', 2, 2), (1, 'idle', 2, 2), (2, 'cast', 2, 3), (3, 'attack', 2, 2), (4, 'hurt', 2, 2), (5, 'combat', 2, 2), (6, 'actions', 2, 2), (7, 'walk', 2, 2), (8, 'run', 2, 2), (9, 'hover', 2, 2),
(10, 'charge', 2, 2), (11, 'projectile', 1, 4), (12, 'impact', 2, 2), (13, 'explode', 2, 2), (14, 'death', 2, 3), (15, 'fx', 2, 2), (16, 'player_walk', 2, 2), (17, 'player_actions', 2, 2), (18, 'npc_walk', 2, 2), (19, 'player_sheet', 4, 4)) AS v(number, mode, r, c)"""
LABELS_OF = """CASE mode WHEN 'evolution' THEN 'stage-1,stage-2,stage-3,stage-4' WHEN 'combat' THEN 'attack-1,attack-2,hurt-1,hurt-2' WHEN 'actions' THEN 'idle-1,idle-2,attack,hurt'
WHEN 'player_walk' THEN 'walk-down-1,walk-down-2,walk-down-3,walk-down-4' WHEN 'npc_walk' THEN 'walk-down-1,walk-down-2,walk-down-3,walk-down-4' WHEN 'player_actions' THEN 'idle,walk,attack,hurt'
WHEN 'player_sheet' THEN 'down-1,down-2,down-3,down-4,left-1,left-2,left-3,left-4,right-1,right-2,right-3,right-4,up-1,up-2,up-3,up-4' ELSE array_to_string(list_transform(range(1, r * c + 1), lambda i: mode || '-' || i), ',') END"""
FRAME_LABELS = f"(SELECT number, mode, r, c, CAST(i AS INTEGER) AS i, list_extract(labels, i + 1) AS label FROM (SELECT *, string_split({LABELS_OF}, ',') AS labels FROM {SHAPES}), unnest(range(len(labels))) AS u(i))"
BUNDLES = """(VALUES (0, 'single_asset', 0, 'single', 1), (1, 'unit_bundle', 0, 'idle', 1), (1, 'unit_bundle', 1, 'combat', 1), (1, 'unit_bundle', 2, 'walk', 0), (2, 'spell_bundle', 0, 'cast', 1), (2, 'spell_bundle', 1, 'projectile', 1),
(2, 'spell_bundle', 2, 'impact', 1), (3, 'combat_bundle', 0, 'idle', 1), (3, 'combat_bundle', 1, 'attack', 1), (3, 'combat_bundle', 2, 'hurt', 1), (4, 'line_bundle', 0, 'form-1', 1), (4, 'line_bundle', 1, 'form-2', 0), (4, 'line_bundle', 2, 'form-3', 0)) AS v(number, bundle, pos, asset, d)"""
HINTS = """(VALUES (0, 'make a 4-direction main hero', 'player', 'player_sheet', '4x4', NULL), (1, 'make a healer npc', 'npc', 'single_asset', NULL, 'healer'), (2, 'make a healer npc walk sheet', 'npc', 'walk', NULL, NULL),
(3, 'make a boss idle', 'creature', 'idle', '3x3', NULL), (4, 'make a wizard throwing a magic orb', 'spell', 'spell_bundle', NULL, NULL), (5, 'make a fireball projectile', 'projectile', 'projectile', '1x4', NULL), (6, 'make a hit explosion', 'impact', 'impact', '2x2', NULL),
(7, 'make a summon entrance', 'summon', 'cast', NULL, NULL), (8, 'make a full fire samurai creature line', 'creature', 'line_bundle', NULL, NULL), (9, 'make something else', NULL, NULL, NULL, NULL)) AS v(number, request, t, a, p, r)"""
PRESETS = """(VALUES ('1x4', 1, 4, 'projectile'), ('1x4', 1, 4, 'fx'), ('2x2', 2, 2, 'idle'), ('2x2', 2, 2, 'attack'), ('2x2', 2, 2, 'hurt'), ('2x2', 2, 2, 'impact'), ('2x2', 2, 2, 'walk'), ('2x3', 2, 3, 'cast'), ('2x3', 2, 3, 'death'), ('2x3', 2, 3, 'combat'),
('3x3', 3, 3, 'boss_idle'), ('3x3', 3, 3, 'boss_aura'), ('3x3', 3, 3, 'showcase_idle'), ('4x4', 4, 4, 'player_sheet')) AS v(preset, r, c, use)"""
OBSTACLES = "(VALUES ('lantern', 'ellipse'), ('rock', 'ellipse'), ('tree', 'ellipse'), ('basin', 'ellipse'), ('fence', 'rect'), ('wall', 'rect'), ('building', 'rect'), ('gate', 'rect'), ('bridge', 'rect'), ('post', 'rect')) AS v(obstacle, shape)"
ROLE_KEYS = "starter,shop,healer,summoner,sage,trainer,gym_leader,villager,guard"


def options() -> str:
    return f"""SELECT 'target_modes' AS catalog, target AS key, CAST(i AS INTEGER) AS pos, list_extract(string_split(modes, ','), i + 1) AS value FROM {MODES}, unnest(range(len(string_split(modes, ',')))) AS u(i)
    UNION ALL SELECT 'grid_shapes', mode, 0, r || 'x' || c FROM {SHAPES} UNION ALL SELECT 'frame_labels', mode, i, label FROM {FRAME_LABELS}
    UNION ALL SELECT 'npc_roles', k, 0, NULL FROM unnest(string_split('{ROLE_KEYS}', ',')) AS u(k)
    UNION ALL SELECT 'processor', 'component_mode', 0, 'all' UNION ALL SELECT 'processor', 'component_mode', 1, 'largest'
    UNION ALL SELECT 'processor', 'align', 0, 'center' UNION ALL SELECT 'processor', 'align', 1, 'bottom' UNION ALL SELECT 'processor', 'align', 2, 'feet'"""


def blended(v: str) -> str:
    """A channel put on a clear canvas through its own alpha."""
    return f"(({v} * a + 128 + (({v} * a + 128) >> 8)) >> 8)"


def sums(x: str, y: str, width: int, channels: tuple[str, str, str, str] = ("r", "g", "b", "a")) -> str:
    """What picture_sums() computes, of rows of pixels of which x and y are the place in a picture so wide."""
    r, g, b, a = channels
    place = f"(({y}) * {width} + ({x}))"
    return f"count(*) FILTER ({a} > 0) AS visible, CAST(coalesce(sum({place} * ({r} + 3 * {g} + 7 * {b} + {a})) FILTER ({a} > 0), 0) AS BIGINT) AS content"


def exact_pictures(cell: int, labels: list[str], strips: list[str]) -> str:
    """Sums of all pictures of a sheet whose frames are whole cells, at scale 1, with nothing cleared. strips: rows with an animation of their own."""
    n = 32 // cell
    channels = tuple(f"CAST({blended(c)} AS INT)" for c in "rgb") + (f"CAST({blended('a')} AS INT)",)
    group = f"y // {cell}" if strips else "0"
    name = choice([f"{s}.gif" for s in strips], f"y // {cell}") if strips else "'animation.gif'"
    frame = f"CAST(x // {cell} AS INTEGER)" if strips else f"CAST(y // {cell} * {n} + x // {cell} AS INTEGER)"
    seen = "(CASE WHEN clear THEN a >= 128 ELSE NOT (r = 255 AND g = 0 AND b = 255) END)"
    parts = [
        f"SELECT sheet_id, name, 0 AS frame, {sums('x', 'y', 32)} FROM pix, (VALUES ('raw-sheet.png'), ('raw-sheet-clean.png')) AS t(name) GROUP BY ALL",
        f"SELECT sheet_id, 'sheet-transparent.png' AS name, 0 AS frame, {sums('x', 'y', 32, channels)} FROM pix GROUP BY ALL",
        f"SELECT sheet_id, {choice([f'{x}.png' for x in labels], f'y // {cell} * {n} + x // {cell}')} AS name, 0 AS frame, {sums(f'x % {cell}', f'y % {cell}', cell)} FROM pix GROUP BY ALL",
        f"SELECT sheet_id, {name} AS name, {frame} AS frame, {sums(f'x % {cell}', f'y % {cell}', cell, ('r', 'g', 'b', f'(CASE WHEN {seen} THEN 255 ELSE 0 END)'))} FROM (SELECT *, bool_or(a < 128) OVER (PARTITION BY sheet_id, {group}) AS clear FROM pix) GROUP BY ALL",
    ]
    if strips:
        parts.append(f"SELECT sheet_id, {choice([f'{s}-strip.png' for s in strips], f'y // {cell}')} AS name, 0 AS frame, {sums('x', f'y % {cell}', 32, channels)} FROM pix GROUP BY ALL")
    return f"WITH {PIX} " + " UNION ALL ".join(parts)

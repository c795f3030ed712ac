"""Prompts from templates: one row of a table per (target, mode), with slots for what a request brings.

The wording is our own; the branches, slots and their order are the contract.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .scalars import stable_seed

_QUADRANTS = ("Top left", "Top right", "Bottom left", "Bottom right")
#: Modes of four phases in 2x2 quadrants; what moves.
_MOVES = {
    ("creature", "idle"): "resting", ("creature", "combat"): "fighting", ("creature", "actions"): "acting", ("creature", "walk"): "walking",
    ("player", "player_walk"): "walking down", ("player", "player_actions"): "acting", ("npc", "npc_walk"): "walking down",
}
_STYLE = {"creature": "monster", "asset": "monster", "player": "overworld", "npc": "overworld"}


def _template(target: str, mode: str) -> str:
    style = catalog.STYLES[_STYLE[target]]
    if target == "asset" and mode != "single":
        return f"{{prompt}}, animated in {{shape}} cells of one scale. {style}"
    role = "Who {role_text}. " if target == "npc" else ""
    if mode == "evolution":
        return f"{{prompt}}, growing. {{stages}} {style} {catalog.STYLES['grid4']}"
    if mode == "player_sheet":
        rows = ", ".join(f"row {i + 1} {d}" for i, d in enumerate(catalog.DIRECTIONS))
        return f"{{prompt}}, walking: {rows}. {style} {catalog.STYLES['grid16']}"
    if (move := _MOVES.get((target, mode))) is not None:
        cells = ", ".join(f"{label} in the {q.lower()}" for q, label in zip(_QUADRANTS, catalog.FRAME_LABELS[mode], strict=True))
        return f"{{prompt}}, {move}: {cells}. {role}{style} {catalog.STYLES['grid4']}"
    return f"{{prompt}}, once. {role}{style}"


def templates(spark: SparkSession) -> DataFrame:
    """(target, mode, template): all 28 branches."""
    rows = [(t, m, _template(t, m)) for t, modes in catalog.TARGET_MODES.items() for m in modes]
    return spark.createDataFrame(rows, "target string, mode string, template string")


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Requests with the reason why they can't be answered: unknown target, unknown mode of a known one, or an npc without a known role."""
    spark = requests.sparkSession
    known = F.broadcast(catalog.target_modes(spark).select("target", "mode", F.lit(True).alias("known_mode")))
    targets = F.broadcast(catalog.target_modes(spark).select("target").distinct().withColumn("known_target", F.lit(True)))
    roles = F.broadcast(catalog.npc_roles(spark).select("role", F.lit(True).alias("known_role")))
    all_ = requests.join(known, ["target", "mode"], "left").join(targets, "target", "left").join(roles, "role", "left")
    reason = F.when(F.col("known_target").isNull(), "target").when(F.col("known_mode").isNull(), "mode").when((F.col("target") == "npc") & F.col("known_role").isNull(), "role")
    return all_.withColumn("reason", reason).where("reason IS NOT NULL").select(*requests.columns, "reason")


def evolution_choices(seeds: DataFrame, column: str = "seed") -> DataFrame:
    """seeds with archetype, silhouette, surface and vibe, drawn in this order by the generator that the seed starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = []
            for seed in batch.column(column).to_pylist():
                rng = random.Random(seed)
                drawn.append([rng.choice(x) for x in (catalog.ARCHETYPE_KEYS, catalog.SILHOUETTES, catalog.SURFACES, catalog.VIBES)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([d[k] for d in drawn], pa.string()) for k in range(4))], names=[*batch.schema.names, "archetype", "silhouette", "surface", "vibe"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeds.schema)
    return seeds.mapInArrow(run, f"{schema}, archetype string, silhouette string, surface string, vibe string")


def _with_stages(rows: DataFrame) -> DataFrame:
    """rows with stages: a sentence for each quadrant, from the archetype's key and what was drawn."""
    look = [", ".join(values[i] for values in catalog.STAGE_LOOK.values()) for i in range(len(_QUADRANTS))]
    drawn = F.concat("silhouette", F.lit(" outline, "), "surface", F.lit(", "), "vibe")
    stages = [F.concat(F.lit(f"{q}: stage {i + 1}, {catalog.GROWTH[i]} "), "archetype", F.lit(f", {look[i]}, "), drawn, F.lit(".")) for i, q in enumerate(_QUADRANTS)]
    return rows.withColumn("stages", F.concat_ws(" ", *stages))


def build_prompts(requests: DataFrame) -> DataFrame:
    """(target, mode, prompt, role, seed) rows with generated_prompt; requests that invalid_requests names are left out.

    A null role is empty; a null seed is the stable one, a given one is echoed. Only evolution draws from it.
    """
    spark = requests.sparkSession
    rows = requests.select("target", "mode", "prompt", F.coalesce("role", F.lit("")).alias("role"), F.col("seed").cast("long").alias("seed"))
    rows = rows.withColumn("seed", F.coalesce("seed", stable_seed(F.col("target"), F.col("mode"), F.col("prompt"), F.col("role"))))
    rows = rows.join(F.broadcast(templates(spark)), ["target", "mode"])
    shapes = F.broadcast(catalog.grid_shapes(spark))
    rows = rows.join(shapes, "mode", "left").withColumn("shape", F.concat_ws("x", F.coalesce("grid_rows", F.lit(catalog.DEFAULT_SHAPE[0])), F.coalesce("grid_cols", F.lit(catalog.DEFAULT_SHAPE[1]))))
    rows = rows.join(F.broadcast(catalog.npc_roles(spark).withColumnRenamed("description", "role_text")), "role", "left").where("target <> 'npc' OR role_text IS NOT NULL")
    plain = rows.where("mode <> 'evolution'").withColumn("stages", F.lit(""))
    drawn = _with_stages(evolution_choices(rows.where("mode = 'evolution'"))).select(*plain.columns)
    text = F.col("template")
    for slot, value in (("shape", F.col("shape")), ("role_text", F.coalesce("role_text", F.lit(""))), ("stages", F.col("stages")), ("prompt", F.coalesce("prompt", F.lit("")))):
        text = F.replace(text, F.lit("{" + slot + "}"), value)
    return plain.unionByName(drawn).select("target", "mode", "prompt", "role", "seed", text.alias("generated_prompt"))

"""Decision tables: requests to assets, bundles to sheets, requirements to map strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog

STRATEGIES = ["single", "single_collision", "hybrid", "layered", "tilemap"]
FX = ["projectile", "impact", "fx", "spell", "explode"]
GROUNDED = ["player", "npc", "creature", "character", "prop", "summon"]


def plan_requests(requests: DataFrame) -> DataFrame:
    """requests, of request, with asset_type, action, preset and role of exact phrases; null for others."""
    return requests.join(F.broadcast(catalog.request_hints(requests.sparkSession)), "request", "left")


def expand_bundles(wanted: DataFrame, optional: bool = False) -> DataFrame:
    """wanted, of bundle, with pos and asset: the assets by default, or all of them."""
    parts = catalog.bundles(wanted.sparkSession)
    return wanted.join(F.broadcast(parts if optional else parts.where("by_default")).drop("by_default"), "bundle")


def sheet_shape(action: Column, large: Column) -> Column:
    """Rows and columns, as text, for an action; large subjects idle in 3x3."""
    return F.when(action == "single", "1x1").when(large & (action == "idle"), "3x3").when(action.isin("projectile"), "1x4").when(action.isin("cast", "death"), "2x3").when(action == "player_sheet", "4x4").otherwise("2x2")


def processor_defaults(asset_type: Column, frames: Column, debris: Column) -> dict[str, Column]:
    """shared_scale for more frames than one, feet for what stands and center for effects, largest where there is debris."""
    return {
        "shared_scale": frames > 1,
        "align": F.when(asset_type.isin(*FX), "center").when(asset_type.isin(*GROUNDED), "feet").otherwise("center"),
        "component_mode": F.when(debris, "largest").otherwise("all"),
    }


def map_strategy(tiles: Column, precise: Column, occlusion: Column, interactive: Column, few: Column, coarse: Column) -> Column:
    """The first sufficient step: tilemap where tiles are asked for, layers for precise needs, a hybrid if few objects have them, else one image."""
    needs = precise | occlusion | interactive
    return F.when(tiles, "tilemap").when(needs & ~few, "layered").when(needs, "hybrid").when(coarse, "single_collision").otherwise("single")


def escalate(strategy: Column) -> Column:
    """The next step of a strategy that isn't enough; the last stays."""
    steps = F.array(*map(F.lit, STRATEGIES))
    return F.get(steps, F.least(F.array_position(steps, strategy), F.lit(len(STRATEGIES) - 1)).cast("int"))

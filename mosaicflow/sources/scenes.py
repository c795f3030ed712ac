"""Scene data: props and collision maps in JSON, with schemas stated rather than inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<struct<x: double, y: double>>"
SHAPES = f"array<struct<id: string, type: string, x: double, y: double, w: double, h: double, rx: double, ry: double, points: {POINTS}>>"
COLLISION = (
    "mapSize struct<width: double, height: double>, spawn struct<x: double, y: double>, npc struct<x: double, y: double, collisionRadius: double, interactRadius: double>, "
    f"rest struct<x: double, y: double, radius: double>, zones map<string, struct<x: double, y: double, w: double, h: double>>, walkBounds {SHAPES}, blockers {SHAPES}"
)
PROPS = "id string, imageKey string, x double, y double, w double, h double, sortY double"


def read_collision(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, with its path; a file that isn't such JSON fails the read."""
    return spark.read.schema(COLLISION).option("multiLine", "true").option("mode", "FAILFAST").json(path).withColumn("path", F.input_file_name())


def read_props(spark: SparkSession, path: str) -> DataFrame:
    """One row a prop of files that hold arrays of them."""
    return spark.read.schema(PROPS).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def parse_collision(text: Column) -> Column:
    """The struct of a collision map, null where the text isn't one."""
    return F.from_json(text, COLLISION)


def shapes(collisions: DataFrame, key: str) -> DataFrame:
    """(key, role, id, type, x, y, w, h, rx, ry, points) of walk bounds, blockers and zones; zones are rectangles named by their key."""
    named = lambda role, column: collisions.select(key, F.lit(role).alias("role"), F.explode(column).alias("s")).select(key, "role", "s.*")
    zones = collisions.select(key, F.lit("zone").alias("role"), F.explode("zones").alias("id", "z"))
    none = F.lit(None).cast("double")
    return named("walk", "walkBounds").unionByName(named("block", "blockers")).unionByName(
        zones.select(key, "role", "id", F.lit("rect").alias("type"), "z.x", "z.y", "z.w", "z.h", none.alias("rx"), none.alias("ry"), F.lit(None).cast(POINTS).alias("points"))
    )

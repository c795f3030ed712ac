"""The frame report: cut, components, selection and edge touch of every frame of every sheet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import frames as fr
from ..operators.frames import Params
from ..sources.rasters import Made, made_of_parts

#: For sheets of part_rasters.
SMALL = Params(trim_border=2, edge_clean_depth=2, component_mode="largest", component_padding=1, cell_size=24)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sheets that a task makes, about, so that there are more tasks where there are more parts, not longer ones.
TASK_SHEETS = 2_000


def parts(spark: SparkSession, sf_dir: str, *keys: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Keys and sizes of all parts, or of those that keep gives back, whose few bytes a row are dealt out before they become thousands: the work is in the sheets, not in reading. With keys, by these, so what is grouped by them needs no other shuffle."""
    found = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-found.count() // TASK_SHEETS))
    return (keep(found) if keep else found).repartition(tasks, *keys)


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets made from all parts."""
    return made_sheets(spark, sf_dir).rasters()


def made_sheets(spark: SparkSession, sf_dir: str) -> Made:
    """The same, made in the pass of the operator that takes them."""
    return made_of_parts(parts(spark, sf_dir))


def report(rasters: DataFrame | Made, p: Params = SMALL) -> DataFrame:
    found = fr.checked(fr.cut(rasters, p, with_pixels=False), p)
    return found.select("sheet_id", "grid_row", "grid_col", "component_count", "selected_area", "x0", "y0", "x1", "y1", "edge_touch")

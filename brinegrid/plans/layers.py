"""The table of layers that routes are searched on, built from bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..operators import raster
from ..settings import Settings

SHAPE = "depth, land, dist, lane, lane_dir, zone, boundary"


def layers(depth: DataFrame, land: DataFrame, grid: Grid, settings: Settings = Settings(), lane: DataFrame | None = None, zone: DataFrame | None = None, boundary: DataFrame | None = None) -> DataFrame:
    """(x, y, depth, land, dist, lane, lane_dir, zone, boundary) of every cell of `depth` (x, y, depth).

    land, zone and boundary are masks (x, y), lane is (x, y, lane_dir). dist is the distance to land in cells, as far as the
    settings' rules look on this grid (12 nm off the coast are 12 cells of 1 nm and 48 of a quarter), and null beyond.
    """
    flag = lambda df, name: df.select("x", "y", F.lit(True).alias(name))
    near = raster.distance(land, settings.reach(grid), (grid.width, grid.height)).select("x", "y", F.sqrt("d2").alias("dist"))
    out = depth.select("x", "y", "depth").join(flag(land, "land"), ["x", "y"], "left").join(near, ["x", "y"], "left")
    masks = {"lane": lane, "zone": zone, "boundary": boundary}
    for name, mask in masks.items():
        if mask is None:
            out = out.withColumns({name: F.lit(False)} | ({"lane_dir": F.lit(None).cast("bigint")} if name == "lane" else {}))
        else:
            out = out.join(mask.select("x", "y", "lane_dir", F.lit(True).alias("lane")) if name == "lane" else flag(mask, name), ["x", "y"], "left")
    return out.fillna(False, ["land", *masks]).select("x", "y", *SHAPE.split(", "))

"""Lines of cells between two cells, in closed form, and what is read off them.

With M = max(|dx|, |dy|) and m = min(|dx|, |dy|) a line has M + 1 cells; step i moves i cells along the longer axis and
(2 i m + M - 1) div 2 M along the other. So a walk is a generator and arithmetic, and every test is an aggregate over a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import blocked
from ..functions.geo import angle_between_deg, bearing_deg, planar_distance_nm, rhumb_point
from ..functions.grid import Grid
from .lineage import bounded, spread_out, unsized


def walk(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cells (keys, i, x, y) of lines (keys, x0, y0, x1, y1)."""
    if clash := {"i", "x", "y"} & set(keys):
        raise ValueError(f"a line's keys may not be named {', '.join(sorted(clash))}")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    most, least = F.greatest(F.abs(dx), F.abs(dy)), F.least(F.abs(dx), F.abs(dy))
    steps = lines.withColumns({"dx": dx, "dy": dy, "most": most, "least": least}).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "most")))
    side = F.when(F.col("most") == 0, F.lit(0).cast("long")).otherwise(F.expr("(2 * i * least + most - 1) div (2 * most)"))
    sx, sy = F.signum("dx").cast("long"), F.signum("dy").cast("long")
    long_x = F.abs(F.col("dx")) >= F.abs(F.col("dy"))
    x = F.col("x0") + sx * F.when(long_x, F.col("i")).otherwise(side)
    y = F.col("y0") + sy * F.when(long_x, side).otherwise(F.col("i"))
    return unsized(steps.select(*keys, "i", x.alias("x"), y.alias("y")))


def _tested(lines: DataFrame, keys: tuple[str, ...], cells: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Aggregates over the cells of each line; cells outside the table are null."""
    met = walk(spread_out(lines, *keys), keys).join(bounded(cells), ["x", "y"], "left")
    return met.groupBy(*keys).agg(*[c.alias(k) for k, c in tests.items()])


def line_of_sight(lines: DataFrame, cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """clear: no cell of the line is blocked, and all are in the table."""
    return _tested(lines, keys, cells.select("x", "y", "blocked"), {"clear": ~F.bool_or(F.coalesce("blocked", F.lit(True)))})


def too_close_to_land(lines: DataFrame, cells: DataFrame, keys: tuple[str, ...], least: float) -> DataFrame:
    """close: some cell outside lanes is nearer to land than `least` cells (dist null: further than was looked for)."""
    near = F.coalesce((F.col("dist") < least) & ~F.coalesce("lane", F.lit(False)), F.lit(False))
    return _tested(lines, keys, cells.select("x", "y", "dist", "lane"), {"close": F.bool_or(near)})


def _facts(grid: Grid | None = None, least: float | None = None) -> dict[str, Column]:
    """Aggregates over the cells of a line that need no order, so they combine before a shuffle.

    The zone flag changes somewhere if it has both values; a boundary begins somewhere if a cell before its last is none.
    """
    zone, boundary = F.col("zone"), F.col("boundary")
    begins = F.min(F.when(~boundary, F.col("i"))) < F.max(F.when(boundary, F.col("i")))
    facts = {"crosses": F.coalesce(F.bool_or(zone) & F.bool_or(~zone), F.lit(False)) | F.coalesce(begins, F.lit(False))}
    if least is not None:
        near = (F.col("dist") < least) & ~F.coalesce("lane", F.lit(False))
        facts["close"] = F.bool_or(F.coalesce(near, F.lit(False)))
    if grid is not None:
        off = F.col("lane") & (angle_between_deg(F.col("bearing"), F.coalesce("lane_dir", F.lit(-1)).cast("double")) > 90)
        facts["wrong"] = F.coalesce(F.bool_or(off), F.lit(False))
    return facts


def _bearing(grid: Grid) -> Column:
    """The bearing from a line's first cell to its last; null for a single cell."""
    bearing = F.round(bearing_deg(*grid.centre(F.col("x0"), F.col("y0")), *grid.centre(F.col("x1"), F.col("y1"))), 6)
    return F.when((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")), F.pmod(bearing, F.lit(360.0)))


def crosses_boundary(lines: DataFrame, cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """crosses: from one cell to the next the zone flag changes or a boundary begins; cells outside the table are skipped."""
    return _tested(lines, keys, cells.select("x", "y", "zone", "boundary"), _facts())


def judged(lines: DataFrame, cells: DataFrame, keys: tuple[str, ...], grid: Grid, least: float) -> DataFrame:
    """crosses, close and wrong of each line, in one walk."""
    put = lines.withColumn("bearing", _bearing(grid))
    met = walk(spread_out(put, *keys), (*keys, "bearing")).join(bounded(cells.select("x", "y", "dist", "lane", "lane_dir", "zone", "boundary")), ["x", "y"], "left")
    return met.groupBy(*keys).agg(*[c.alias(k) for k, c in _facts(grid, least).items()])


def touches_boundary(lines: DataFrame, cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """touches: a cell after the first is a boundary."""
    return _tested(lines, keys, cells.select("x", "y", "boundary"), {"touches": F.bool_or(F.coalesce(F.col("boundary") & (F.col("i") > 0), F.lit(False)))})


def wrong_way(lines: DataFrame, cells: DataFrame, keys: tuple[str, ...], grid: Grid) -> DataFrame:
    """wrong: in some lane cell the line's bearing and the lane's differ by more than 90 degrees; a single cell never is."""
    put = lines.withColumn("bearing", _bearing(grid))
    met = walk(spread_out(put, *keys), (*keys, "bearing")).join(bounded(cells.select("x", "y", "lane", "lane_dir", "zone", "boundary")), ["x", "y"], "left")
    return met.groupBy(*keys).agg(_facts(grid)["wrong"].alias("wrong"))


def clear_straight(lines: DataFrame, cells: DataFrame, keys: tuple[str, ...], grid: Grid, least: float, swapped_bearing: bool = True) -> DataFrame:
    """clear: no zone or boundary crossing, no wrong way, and every cell in the table, not land, off the coast or in a lane.

    Where both ends are in lanes all cells must be, and a lane's direction must lie within 90 degrees of the line's bearing.
    `swapped_bearing` keeps the bearing of the original rule, which takes latitudes for longitudes. One walk and one
    aggregation, whatever the rules.
    """
    (a, b), (c, d) = grid.centre(F.col("x0"), F.col("y0")), grid.centre(F.col("x1"), F.col("y1"))
    course = bearing_deg(b, a, d, c) if swapped_bearing else bearing_deg(a, b, c, d)
    put = lines.withColumns({"bearing": _bearing(grid), "course": F.pmod(F.round(course, 6), F.lit(360.0)), "far": F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))})
    met = walk(spread_out(put, *keys), (*keys, "bearing", "course", "far")).join(bounded(cells.select("x", "y", "land", "dist", "lane", "lane_dir", "zone", "boundary")), ["x", "y"], "left")
    lane = F.coalesce("lane", F.lit(False))
    turned = (F.col("lane_dir") >= 0) & (angle_between_deg(F.col("course"), F.col("lane_dir").cast("double")) > 90)
    fine = F.col("land").isNotNull() & ~F.col("land") & (lane | F.coalesce(F.col("dist") >= least, F.lit(True)))
    facts = _facts(grid) | {
        "fine": F.bool_and(F.coalesce(fine, F.lit(False))),
        "both": F.bool_or(lane & (F.col("i") == 0)) & F.bool_or(lane & (F.col("i") == F.col("far"))),
        "along": F.bool_and(lane & ~F.coalesce(turned, F.lit(False))),
    }
    found = met.groupBy(*keys).agg(*[v.alias(k) for k, v in facts.items()])
    return found.select(*keys, (F.col("fine") & (~F.col("both") | F.col("along")) & ~F.col("crosses") & ~F.col("wrong")).alias("clear"))


def open_water(lines: DataFrame, cells: DataFrame, keys: tuple[str, ...], least: float) -> DataFrame:
    """clear: every cell is in the table, deep enough for the line's `draft`, no land, in no zone, off the coast or in a lane; no boundary is crossed."""
    names = (*keys, "draft") if "draft" not in keys else keys
    met = walk(spread_out(lines, *keys), names).join(bounded(cells.select("x", "y", "depth", "land", "dist", "lane", "zone", "boundary")), ["x", "y"], "left")
    off = F.coalesce("lane", F.lit(False)) | F.coalesce(F.col("dist") >= least, F.lit(True))
    fine = F.coalesce(~F.col("land") & ~blocked(F.col("depth"), F.col("draft"), F.col("zone")) & off, F.lit(False))
    found = met.groupBy(*keys).agg(F.bool_and(fine).alias("fine"), _facts()["crosses"].alias("crosses"))
    return found.select(*keys, (F.col("fine") & ~F.col("crosses")).alias("clear"))


def sampled(routes: DataFrame, keys: tuple[str, ...], step_nm: float, low: int, high: int) -> DataFrame:
    """Points (keys, i, lon, lat) along the rhumb line of routes (lon1, lat1, lon2, lat2), a step apart."""
    apart = planar_distance_nm(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    n = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(apart / step_nm).cast("int"))).cast("long")
    points = routes.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "n")))
    lon, lat = rhumb_point(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"), F.col("i") / F.col("n"))
    return points.select(*keys, "i", lon.alias("lon"), lat.alias("lat"))


def open_ocean(routes: DataFrame, keys: tuple[str, ...], grid: Grid, traffic: DataFrame, coast: DataFrame, offshore_nm: float = 12.0, reach: float | None = None) -> DataFrame:
    """open: the straight line meets no zone, boundary or lane's neighbourhood (traffic) and keeps off the coast.

    traffic: cells (x, y) to keep clear of; coast: cells with dist, their distance to land in cells. Depth is not tested.
    reach: the cells up to which dist is known; a missing dist says nothing about nearer coast than that.
    """
    cell = grid.cell_nm
    if reach is not None and reach * cell < offshore_nm:
        raise ValueError(f"distances to land reach {reach * cell:g} nm, less than the {offshore_nm:g} nm that open water keeps off the coast")
    lanes = sampled(routes, keys, max(0.25, cell / 2), 10, 20_000)
    lands = sampled(routes, keys, max(2.0, 3 * cell), 10, 5_000)
    place = lambda df: df.withColumns(dict(zip(("x", "y"), grid.to_cell(F.col("lon"), F.col("lat")), strict=True))).select(*keys, "x", "y").distinct()
    hit = place(lanes).join(traffic.select("x", "y"), ["x", "y"], "left_semi").select(*keys)
    close = place(lands).join(coast.filter(F.col("dist") * cell < offshore_nm).select("x", "y"), ["x", "y"], "left_semi").select(*keys)
    bad = hit.unionByName(close).distinct().withColumn("bad", F.lit(True))
    return routes.select(*keys).join(bad, list(keys), "left").select(*keys, F.col("bad").isNull().alias("open"))


def lane_status(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (x, y, ...) with in_lane; outside the table false."""
    return points.join(bounded(cells.select("x", "y", "lane")), ["x", "y"], "left").withColumn("in_lane", F.coalesce("lane", F.lit(False))).drop("lane")


def wrong_way_audit(points: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """wrong_points of each path (key, seq, lon, lat, x, y): in a lane, against it by more than 90 degrees.

    The bearing from the point before is planar, without the cosine of latitude.
    """
    over = Window.partitionBy(key).orderBy("seq")
    dlon, dlat = F.col("lon") - F.lag("lon").over(over), F.col("lat") - F.lag("lat").over(over)
    bearing = F.pmod(F.round(F.degrees(F.atan2(dlon, dlat)), 6) + 360, F.lit(360.0))
    met = points.withColumn("bearing", bearing).join(cells.filter("lane").select("x", "y", "lane_dir"), ["x", "y"], "left")
    off = F.coalesce(angle_between_deg(F.col("bearing"), F.col("lane_dir").cast("double")) > 90, F.lit(False))
    return met.groupBy(key).agg(F.sum(off.cast("long")).alias("wrong_points"))


def sample_checks(cells: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A sample of n cells with notes: buffered land, no depth."""
    notes = F.array_compact(F.array(F.when(F.col("land_buffered"), F.lit("buffered land")), F.when(F.col("depth").isNull(), F.lit("no depth"))))
    return cells.orderBy(F.xxhash64("x", "y", F.lit(seed))).limit(n).select("x", "y", notes.alias("notes"))

import math

import pytest
from pyspark.sql import functions as F

from brinegrid.functions import cells, geo, tags
from brinegrid.functions.grid import Grid, suffix
from brinegrid.operators import lines, raster


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_distance_is_planar(spark):
    got = value(spark, geo.planar_distance_nm(F.lit(0.0), F.lit(60.0), F.lit(2.0), F.lit(60.0)))
    assert got == pytest.approx(60.0)


@pytest.mark.parametrize(("a", "b", "want"), [(350.0, 10.0, 20.0), (10.0, 350.0, 20.0), (0.0, 180.0, 180.0), (-10.0, 0.0, 10.0)])
def test_angles_wrap(spark, a, b, want):
    assert value(spark, geo.angle_between_deg(F.lit(a), F.lit(b))) == want


def test_radius_rounds_halves_to_even(spark):
    assert [value(spark, geo.radius_cells(F.lit(float(w)), F.lit(1.0))) for w in (0, 1, 3, 5, 7)] == [1, 1, 2, 2, 4]


def test_rhumb_ends(spark):
    lon, lat = geo.rhumb_point(F.lit(1.0), F.lit(10.0), F.lit(5.0), F.lit(20.0), F.lit(1.0))
    assert value(spark, lon) == pytest.approx(5.0)
    assert value(spark, lat) == pytest.approx(20.0)


def test_grid_round_trip(spark, tmp_path):
    grid = Grid("EPSG:4326", 0.1, 0.1, -20.0, 60.0, 50, 40)
    grid.write(str(tmp_path / "g.json"))
    assert Grid.read(str(tmp_path / "g.json")) == grid
    x, y = grid.to_cell(*grid.centre(F.lit(7), F.lit(9)))
    assert (value(spark, x), value(spark, y)) == (7, 9)
    assert suffix("0.5nm") == "_05nm" and suffix("1nm") == ""


def test_penalties(spark):
    assert value(spark, cells.depth_penalty(F.lit(-12), F.lit(10), 5.0)) == 2.5
    assert math.isinf(value(spark, cells.depth_penalty(F.lit(-5), F.lit(10), 5.0)))
    assert value(spark, cells.land_penalty(F.lit(3.0), 5.0, 6.0)) == 2.5
    assert value(spark, cells.land_penalty(F.lit(None).cast("double"), 5.0, 6.0)) == 0.0
    assert value(spark, cells.deep_enough(F.lit(None).cast("int"), F.lit(10))) is False


def test_tags(spark):
    text = F.lit('"name"=>"a","seamark:type"=>"separation_lane"')
    assert value(spark, tags.seamark_type(None, text)) == "separation_lane"
    assert value(spark, tags.seamark_type(None, F.lit("x"))) is None


def stepwise(x0, y0, x1, y1):
    """The walk by its definition: accumulate the error of the shorter axis."""
    dx, dy = x1 - x0, y1 - y0
    most, least = max(abs(dx), abs(dy)), min(abs(dx), abs(dy))
    out = []
    for i in range(most + 1):
        side = -(-(2 * i * least - most) // (2 * most)) if most else 0
        a, b = (i, side) if abs(dx) >= abs(dy) else (side, i)
        out.append((x0 + (dx > 0) * a - (dx < 0) * a, y0 + (dy > 0) * b - (dy < 0) * b))
    return out


def test_walk(spark):
    ends = [(k, 5, 5, 5 + dx, 5 + dy) for k, (dx, dy) in enumerate([(0, 0), (4, 2), (-4, 3), (2, -5), (-3, -3), (7, 1)])]
    rows = lines.walk(spark.createDataFrame(ends, "k bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint"), ("k",)).collect()
    got = {k: [(r.x, r.y) for r in sorted((r for r in rows if r.k == k), key=lambda r: r.i)] for k, *_ in ends}
    assert got == {k: stepwise(*e) for k, *e in ends}


def test_rasterised_square(spark):
    ring = [(1.0, 1.0), (4.0, 1.0), (4.0, 3.0), (1.0, 3.0)]
    table = spark.createDataFrame([(0, ring)], "f int, ring array<struct<x: double, y: double>>")
    got = {(r.x, r.y) for r in raster.rasterised(raster.polygon_edges(table, ("f",), "ring"), ("f",), (10, 10)).collect()}
    assert got == {(x, y) for x in (1, 2, 3) for y in (1, 2)}


def test_nearest_breaks_ties_by_order(spark):
    points = spark.createDataFrame([(0, 0, 10, 2), (2, 0, 20, 1)], "x bigint, y bigint, v int, o int")
    got = {(r.x, r.y): r.v for r in raster.nearest(points, 1, (5, 5), "v", "o").collect()}
    assert got[1, 0] == 20


def test_rasterised_holds_no_cells(spark):
    """Two polygons that overlap, one with a notch: each cell once for each, and no aggregate over cells."""
    rows = [(1, [(0.0, 0.0), (8.0, 0.0), (8.0, 6.0), (4.0, 2.0), (0.0, 6.0)]), (2, [(1.0, 1.0), (6.0, 1.0), (6.0, 5.0), (1.0, 5.0)])]
    table = spark.createDataFrame(rows, "f int, ring array<struct<x: double, y: double>>")
    made = raster.rasterised(raster.polygon_edges(table, ("f",), "ring"), ("f",), (10, 10))
    got = [(r.f, r.x, r.y) for r in made.collect()]
    assert len(got) == len(set(got)) and {(2, x, y) for x in range(1, 6) for y in range(1, 5)} == {g for g in got if g[0] == 2}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1

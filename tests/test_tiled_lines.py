"""Paths that are shortened against the tiles about them."""

import random

import pytest

from brinegrid.functions.grid import Grid
from brinegrid.operators import lines, polyline, tiled_lines
from brinegrid.plans.route_queries import QUERIES


def test_lines_between_points_lie_in_the_tiles_of_their_path():
    rng = random.Random(3)
    for size in (1, 2, 3, 12):
        for _ in range(40):
            points = [(rng.randrange(-50, 700), rng.randrange(-50, 700)) for _ in range(size)]
            if size == 3:
                points[2] = points[0][0], points[1][1]
            tiles = set(tiled_lines.tiles_of(points))
            for a in points:
                for b in points:
                    x, y = tiled_lines.line_cells(a, b)
                    assert {(int(p) // tiled_lines.TILE, int(q) // tiled_lines.TILE) for p, q in zip(x, y)} <= tiles
    straight = tiled_lines.tiles_of([(k, k) for k in range(6400)])
    assert len(straight) <= 3 * 102  # a band of tiles, not the square about the line


def test_line_cells_are_those_of_the_walk(spark):
    ends = [(0, 0, 5, 2), (5, 2, 0, 0), (3, 3, 3, 3), (0, 9, 4, -7), (2, 2, 2, 8), (-4, 1, 7, 1), (0, 0, -6, 6)]
    walked = lines.walk(spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "k long, x0 long, y0 long, x1 long, y1 long"), ("k",)).collect()
    for k, (a, b, c, d) in enumerate(ends):
        x, y = tiled_lines.line_cells((a, b), (c, d))
        assert [(r.x, r.y) for r in sorted(walked, key=lambda r: r.i) if r.k == k] == list(zip(x.tolist(), y.tolist()))


def test_string_pulling_by_search_joins_no_cells_of_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "open_water", lambda *a: pytest.fail("lines were tested as rows"))
    assert QUERIES["x1_string_pull_by_search"](spark, "/root/testdata/sf0.001").count() > 150


def test_farthest_seen_equals_skips_over_clear_pairs(spark, monkeypatch):
    rng = random.Random(8)
    odd = lambda p, v: rng.choices([v, None], [1 - p, p])[0]
    world = [(x, y, odd(0.01, rng.random() < 0.02), odd(0.5, float(rng.randrange(0, 5))), lane := rng.random() < 0.3, rng.randrange(8) * 45 if lane and rng.random() < 0.8 else None, rng.random() < 0.01, rng.random() < 0.02) for x in range(90) for y in range(90) if (x, y) != (40, 40)]
    layers = spark.createDataFrame(world, "x long, y long, land boolean, dist double, lane boolean, lane_dir long, zone boolean, boundary boolean")
    grid = Grid("EPSG:4326", 0.1, 0.1, 0.0, 60.0, 90, 90)
    ends = [(k, rng.randrange(90), rng.randrange(90), rng.randrange(90), rng.randrange(90)) for k in range(40)] + [(50, 5, 5, 5, 5), (51, 5, 5, 6, 5)]
    points = lines.walk(spark.createDataFrame(ends, "route_id long, x0 long, y0 long, x1 long, y1 long"), ("route_id",)).withColumnRenamed("i", "seq").cache()
    rows = lambda df: sorted((r.route_id, r.seq, r.x, r.y) for r in df.collect())
    want = rows(polyline.farthest_skips(points, polyline.clear_pairs(points, layers, grid, 12, 1.0)))
    monkeypatch.setattr(lines, "clear_straight", lambda *a: pytest.fail("lines were tested as rows"))
    assert rows(polyline.farthest_seen(points, layers, grid, 12, 1.0)) == want
    assert len(ends) * 2 < len(want) < points.count() * 0.9


def test_simplification_joins_no_cells_of_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "clear_straight", lambda *a: pytest.fail("lines were tested as rows"))
    assert QUERIES["x4_lane_aware_simplify"](spark, "/root/testdata/sf0.001").count() > 300

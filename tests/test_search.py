import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinegrid.functions.grid import Grid
from brinegrid.operators import corridor, lineage, lines, moves, passages, polyline, search
from brinegrid.plans import queries as plans
from brinegrid.plans.fixtures import fixtures
from brinegrid.plans.route import Attempt, Settings, route, searched

SF = "/root/testdata/sf0.001"
GRID = Grid("EPSG:4326", 0.1, 0.1, 0.0, 10.0, 12, 12)


@pytest.fixture(scope="module")
def layers(spark):
    """Deep water with a wall of land at x = 6 that is open at y = 10."""
    rows = [(x, y, -100, x == 6 and y != 10, None, False, None, False, False) for x in range(12) for y in range(12)]
    return spark.createDataFrame(rows, "x bigint, y bigint, depth bigint, land boolean, dist double, lane boolean, lane_dir bigint, zone boolean, boundary boolean").cache()


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(1, 2, 2, 10, 3, 10.0)], "route_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, draft double")


def test_kernel_goes_through_the_gap(layers, requests):
    row = searched(requests, layers, GRID, Settings(width_nm=60.0), Attempt()).first()
    path = [(p.x, p.y) for p in row.path]
    assert row.success and path[0] == (2, 2) and path[-1] == (10, 3) and (6, 10) in path
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))


def test_narrow_corridor_fails_and_ladder_answers(layers, requests):
    assert not searched(requests, layers, GRID, Settings(width_nm=6.0), Attempt()).first().success
    row = route(requests, layers, GRID, Settings(width_nm=20.0), (Attempt(), Attempt(4.0))).first()
    assert row.attempt == 1 and not row.warnings and row.distance_nm > 0


def test_no_path_gives_the_straight_line_with_a_warning(layers, requests):
    walled = layers.withColumn("land", F.col("x") == 6).withColumn("dist", F.when(F.col("x") == 6, 0.0))
    row = route(requests, walled, GRID, Settings(width_nm=20.0), (Attempt(),)).first()
    assert row.attempt is None and len(row.path) == 2 and row.warnings


def test_relaxation_equals_kernel_without_extras(spark, layers, requests):
    cells = corridor.straight_corridor(requests, GRID, 60.0, layers.filter("land"))
    priced = moves.moves(cells).withColumn("cost", F.when((F.col("dx") != 0) & (F.col("dy") != 0), 1.414).otherwise(1.0))
    best = search.relaxed(priced, requests.select("route_id", F.col("x0").alias("x"), F.col("y0").alias("y"))).filter("x = 10 and y = 3").first().cost
    found = search.astar(priced, requests, GRID, turn_weight=0.0, heuristic=0.0).first().cost
    assert found == pytest.approx(best, rel=1e-5)


def test_relaxation_refuses_negative_costs(spark, requests):
    bad = spark.createDataFrame([(1, 0, 0, 1, 0, -1.0)], "route_id bigint, x bigint, y bigint, nx bigint, ny bigint, cost double")
    with pytest.raises(ValueError, match="negative"):
        search.relaxed(bad, requests.select("route_id", F.col("x0").alias("x"), F.col("y0").alias("y")))


def test_macro_route(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], "src string, dst string, weight_nm double")
    got = {r.node: (r.weight_nm, r.path) for r in passages.macro_routes(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": (0.0, ["a"]), "b": (1.0, ["a", "b"]), "c": (2.0, ["a", "b", "c"])}


def test_douglas_peucker_keeps_corners(spark):
    rows = [(1, k, float(min(k, 5)), float(max(0, k - 5))) for k in range(11)]
    points = spark.createDataFrame(rows, "route_id bigint, seq bigint, lon double, lat double")
    assert sorted(r.seq for r in polyline.douglas_peucker(points, 6.0).collect()) == [0, 5, 10]


def test_string_pulling_keeps_only_what_is_needed(spark, layers):
    line = spark.createDataFrame([(1, 0, 0, 5, 0)], "route_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    points = lines.walk(line, ("route_id",)).withColumnRenamed("i", "seq")
    pulled = polyline.farthest_skips(points, polyline.clear_pairs(points, layers, GRID, 10, 1.0)).collect()
    assert sorted(r.seq for r in pulled) == [0, 5]


def dense_spline(t, v, s):
    """A cubic for each interval, all coefficients at once: values, two continuous derivatives, a third one next to the ends."""
    n, rows, right = len(t) - 1, [], []

    def put(parts, value):
        row = np.zeros(4 * n)
        for i, at, order, sign in parts:
            x = t[at] - t[i]
            row[4 * i : 4 * i + 4] += sign * np.array([[1, x, x**2, x**3], [0, 1, 2 * x, 3 * x**2], [0, 0, 2, 6 * x], [0, 0, 0, 6]][order])
        rows.append(row)
        right.append(value)

    for i in range(n):
        put([(i, i, 0, 1)], v[i])
        put([(i, i + 1, 0, 1)], v[i + 1])
    for i in range(n - 1):
        for order in (1, 2):
            put([(i, i + 1, order, 1), (i + 1, i + 1, order, -1)], 0)
    for i in (0, n - 2):
        put([(i, i + 1, 3, 1), (i + 1, i + 1, 3, -1)], 0)
    c = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0].reshape(n, 4)
    k = np.clip(np.searchsorted(t, s, "right") - 1, 0, n - 1)
    x = s - t[k]
    return c[k, 0] + c[k, 1] * x + c[k, 2] * x**2 + c[k, 3] * x**3


@pytest.mark.parametrize("size", [4, 5, 12])
def test_spline_equals_the_dense_solution(spark, size):
    rng = np.random.default_rng(4)
    lon, lat = rng.uniform(-9, 9, size), rng.uniform(-9, 9, size)
    path = [*zip(lon.tolist(), lat.tolist(), strict=True)]
    path.insert(2, path[1])  # a point that repeats the one before
    points = spark.createDataFrame([(1, k, *p) for k, p in enumerate(path)] + [(2, 0, 1.0, 2.0), (2, 1, 3.0, 2.0)], "route_id bigint, seq bigint, lon double, lat double")
    got = sorted(map(tuple, polyline.splined(points, 25).collect()))
    t = np.append(0, np.cumsum(np.hypot(np.diff(lon), np.diff(lat))))
    for c, v in ((2, lon), (3, lat)):
        assert [row[c] for row in got if row[0] == 1] == pytest.approx(dense_spline(t / t[-1], v, np.linspace(0, 1, 25)).tolist(), abs=1e-6)
    assert [row for row in got if row[0] == 2] == [(2, 0, 1.0, 2.0), (2, 1, 3.0, 2.0)]


def test_open_water_needs_far_enough_distances(spark):
    routes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "route_id bigint, lon1 double, lat1 double, lon2 double, lat2 double")
    cells = spark.createDataFrame([], "x bigint, y bigint, dist double")
    with pytest.raises(ValueError):
        lines.open_ocean(routes, ("route_id",), GRID, cells, cells, offshore_nm=10 * GRID.cell_nm, reach=6.0)
    assert lines.open_ocean(routes, ("route_id",), GRID, cells, cells, offshore_nm=5 * GRID.cell_nm, reach=6.0).first().open


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_splines_end_where_their_tracks_end(spark):
    track = fixtures(spark, SF).track
    last = {r.route_id: (r.lon, r.lat) for r in track.groupBy("route_id").agg(F.max_by("lon", "seq").alias("lon"), F.max_by("lat", "seq").alias("lat")).collect()}
    got = plans.QUERIES["x7_spline"](spark, SF)
    ends = {r.route_id: (r.lon, r.lat) for r in got.groupBy("route_id").agg(F.max_by("lon", "seq").alias("lon"), F.max_by("lat", "seq").alias("lat")).collect()}
    assert ends.keys() == last.keys() and all(ends[k] == pytest.approx(last[k], abs=1e-5) for k in last)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_macro_waypoints_from_every_node(spark):
    edges = fixtures(spark, SF).passages
    leaving = {r.src for r in edges.select("src").collect()}
    assert {r.start for r in plans.QUERIES["a10_macro_waypoints"](spark, SF).select("start").distinct().collect()} == leaving


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["c3_two_width_corridor", "a2_route_kernel"])
def test_every_customer_is_routed(spark, name):
    asked = {r.k for r in spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k")).collect()}
    assert len(asked) > 64
    assert {r.route_id for r in plans.QUERIES[name](spark, SF).select("route_id").distinct().collect()} == asked


def test_lines_judged_in_one_walk_equal_a_plain_loop(spark):
    """crosses, close, wrong and clear against loops over each line's cells in order; some cells are missing."""
    rng = np.random.default_rng(5)
    cells = {}
    for x in range(12):
        for y in range(12):
            if rng.random() < 0.97:
                lane = bool(rng.random() < 0.35)
                dist = float(rng.integers(0, 5)) if rng.random() < 0.5 else None
                cells[x, y] = (x, y, bool(rng.random() < 0.03), dist, lane, int(rng.integers(0, 8)) * 45 if lane else None, bool(rng.random() < 0.06), bool(rng.random() < 0.06))
    table = spark.createDataFrame(list(cells.values()), "x bigint, y bigint, land boolean, dist double, lane boolean, lane_dir bigint, zone boolean, boundary boolean")
    given = [(k, *map(int, rng.integers(0, 12, 4))) for k in range(300)] + [(300, 4, 4, 4, 4)]
    drawn = spark.createDataFrame(given, "k bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    paths = {}
    for r in lines.walk(drawn, ("k",)).orderBy("k", "i").collect():
        paths.setdefault(r.k, []).append((r.x, r.y))

    def bearing(lon1, lat1, lon2, lat2):
        a, b, d = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
        return round(float(np.degrees(np.arctan2(np.sin(d) * np.cos(b), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d)))), 6) % 360

    def apart(a, b):
        return abs((a - b + 180) % 360 - 180)

    def plain(x0, y0, x1, y1, path):
        at = [cells.get(p) for p in path]
        here = [c for c in at if c]
        crosses = any(a[6] != b[6] or (b[7] and not a[7]) for a, b in zip(here, here[1:], strict=False))
        close = any(c[3] is not None and c[3] < 1.5 and not c[4] for c in here)
        (lon1, lat1), (lon2, lat2) = ((0.1 * (x + 0.5), 10 - 0.1 * (y + 0.5)) for x, y in ((x0, y0), (x1, y1)))
        course = bearing(lat1, lon1, lat2, lon2)
        wrong = (x0, y0) != (x1, y1) and any(c[4] and apart(bearing(lon1, lat1, lon2, lat2), c[5]) > 90 for c in here)
        both = bool(at[0] and at[-1] and at[0][4] and at[-1][4])
        fine = all(c and not c[2] and (c[4] or c[3] is None or c[3] >= 1.5) and (not both or (c[4] and apart(course, c[5]) <= 90)) for c in at)
        return crosses, close, wrong, fine and not crosses and not wrong

    expected = {k: plain(*ends, paths[k]) for k, *ends in given}
    judged = {r.k: r for r in lines.judged(drawn, table, ("k",), GRID, 1.5).collect()}
    clear = {r.k: r.clear for r in lines.clear_straight(drawn, table, ("k",), GRID, 1.5).collect()}
    assert {k: (judged[k].crosses, judged[k].close, judged[k].wrong, clear[k]) for k in expected} == expected
    assert 0 < sum(clear.values()) < len(clear)


def test_nearer_wrong_way_lanes_equal_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    lanes = {(x, y): int(rng.integers(0, 8)) * 45 for x in range(12) for y in range(12) if rng.random() < 0.2}
    table = spark.createDataFrame([(*k, v) for k, v in lanes.items()], "x bigint, y bigint, lane_dir bigint")
    given = {k: (int(rng.integers(0, 14)), int(rng.integers(0, 14)), float(rng.integers(0, 8)) * 45) for k in range(200)}
    points = spark.createDataFrame([(k, *v) for k, v in given.items()], "k bigint, x bigint, y bigint, goal double")
    expected = {}
    for k, (x, y, goal) in given.items():
        near = [((a - x) ** 2 + (b - y) ** 2, abs((d - goal + 180) % 360 - 180) > 90) for (a, b), d in lanes.items() if 0 < (a - x) ** 2 + (b - y) ** 2 <= 4]
        if near:
            expected[k] = min(near, key=lambda n: (n[0], not n[1]))[1]
    assert {r.k: r.near_wrong for r in moves.nearer_wrong_way(points, table, 2, ("k",)).collect()} == expected
    assert len(set(expected.values())) == 2


def test_tables_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    table = spark.range(20)
    plan = lambda: spark.range(5).join(lineage.bounded(table), "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan().lower()
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 19)
    assert "broadcast" not in plan().lower()


def test_douglas_peucker_takes_many_stretches_in_one_call(spark):
    from brinegrid.operators import polyline

    points = spark.range(4000).selectExpr("id div 100 as route_id", "id % 100 as seq", "cast(id % 7 as double) as lon", "cast(id % 100 as double) as lat", "id % 10 < 5 as flag")
    made = polyline.douglas_peucker(points, 30.0, "flag")
    # a route's stretches are rows of a batch: no group of the plan goes to Python by itself
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.route_id, r.seq) for r in made.collect()}
    assert {(r, s) for r in range(40) for s in range(100) if s % 5 in (0, 4)} <= got and len(got) < 4000

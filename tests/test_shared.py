import pytest

from brinegrid.operators import corridor, lines, polyline, shared
from brinegrid.plans import cell_queries, route_queries
from brinegrid.plans.fixtures import fixtures

SF = "/root/testdata/sf0.001"


def test_rows_that_are_alike_are_answered_once(spark):
    asked = spark.createDataFrame([(3, 1, 2), (1, 1, 2), (2, None, 2), (5, None, 2), (4, 7, 7), (4, 7, 7)], "route_id long, a long, b long")
    seen = []

    def answer(one):
        seen.extend(sorted(tuple(r) for r in one.collect()))
        return one.selectExpr("route_id", "coalesce(a, 0) + b as s", "explode(array(0, 1)) as k")

    got = sorted(tuple(r) for r in shared.once(asked, ("a", "b"), answer).collect())
    assert seen == [(1, 1, 2), (2, None, 2), (4, 7, 7)]
    assert got == sorted((i, s, k) for i, s in ((1, 3), (3, 3), (2, 2), (5, 2), (4, 14)) for k in (0, 1))
    again = shared.once(asked, ("a", "b"), lambda one: one.selectExpr("route_id", "b as s"), repeats=True)
    assert sorted(r.route_id for r in again.collect()) == [1, 2, 3, 4, 4, 5]


@pytest.mark.parametrize(
    "query, module, name",
    [
        ("l2_line_of_sight", lines, "line_of_sight"), ("l3_land_clearance", lines, "too_close_to_land"), ("l4_boundary_cross", lines, "crosses_boundary"),
        ("l5_boundary_touch", lines, "touches_boundary"), ("l6_wrong_way", lines, "wrong_way"), ("l7_clear_path", lines, "clear_straight"), ("l8_open_ocean", lines, "open_ocean"),
        ("l1_line_walk", lines, "walk"), ("l9_lane_status", lines, "walk"), ("l10_wrong_way_audit", lines, "walk"), ("c1_corridor", corridor, "straight_corridor"),
        ("c3_two_width_corridor", corridor, "two_width_corridor"), ("a8_reconstruct", lines, "walk"), ("x8_wrong_way_segments", polyline, "segments"), ("x9_bypasses", polyline, "segments"),
        ("c2_c4_penalties", corridor, "straight_corridor"), ("c4_features", corridor, "straight_corridor"), ("p14_move_costs", corridor, "straight_corridor"), ("x1_x3_string_pull", lines, "walk"),
    ],
)
def test_queries_work_on_different_lines_alone(spark, monkeypatch, query, module, name):
    fx = fixtures(spark, SF)
    different = fx.requests.select("x0", "y0", "x1", "y1").distinct().count()
    assert fx.requests.count() > 3 * different
    sizes, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *a, **k: sizes.append(df.select("route_id").distinct().count() if "route_id" in df.columns else 0) or real(df, *a, **k))
    (cell_queries.QUERIES | route_queries.QUERIES)[query](spark, SF)
    assert sizes and max(sizes) <= 2 * different


def test_coarse_distances_equal_relaxation_and_need_no_rounds(spark, monkeypatch):
    from brinegrid.functions.grid import Grid
    from brinegrid.operators import search

    grid = Grid("EPSG:4326", 0.1, 0.1, -20.0, 60.0, 560, 72)
    blocks = spark.range(70 * 9).selectExpr("id % 70 as cx", "id div 70 as cy").filter("(cx * 7 + cy * 5) % 4 <> 0 and not (cx = 30 and cy <> 4)")
    starts = blocks.filter("cy = 4 and cx in (1, 3, 69)").selectExpr("cx * 1000 + cy as route_id", "cx as x", "cy as y")
    moves = search.coarse_moves(blocks.selectExpr("0 as route_id", "cx", "cy"), grid, 8).select("x", "y", "nx", "ny", "cost")
    told = {(r.route_id, r.x, r.y): round(r.cost, 6) for r in search.relaxed(moves, starts).collect()}
    monkeypatch.setattr(search, "cut", lambda df: pytest.fail("a round was written"))
    assert {(r.route_id, r.x, r.y): round(r.cost, 6) for r in search.coarse_distances(starts, blocks, grid, 8).collect()} == told and len(told) > 300

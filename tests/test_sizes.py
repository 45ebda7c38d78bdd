"""Rows that generators, Arrow functions and checkpoints multiply are not broadcast by Spark's estimate, which is of the files they come from."""

import pytest

from brinegrid.operators import lineage, raster, shared
from brinegrid.plans import cell_queries, route_queries
from brinegrid.plans.fixtures import fixtures
from brinegrid.plans.layers import layers
from brinegrid.settings import Settings

SF = "/root/testdata/sf0.001"


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_layers_meet_in_shuffles(spark, capsys):
    fx = fixtures(spark, SF)
    assert "Broadcast" not in plan(layers(fx.cells, fx.land, fx.grid, Settings(), fx.lane, fx.zone, fx.boundary), capsys)
    assert "Broadcast" not in plan(raster.distance(fx.land, 6, fx.size).join(fx.cells, ["x", "y"]), capsys)


@pytest.mark.parametrize("name", ["l1_line_walk", "c1_corridor", "c3_two_width_corridor", "c4_features", "c2_c4_penalties", "p14_move_costs", "a8_reconstruct"])
def test_many_members_are_not_broadcast(spark, capsys, monkeypatch, name):
    query = (cell_queries.QUERIES | route_queries.QUERIES)[name]
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 20)
    made = query(spark, SF)
    shown = plan(made, capsys)
    assert "ShuffledHashJoin [like" in shown and ", Inner, BuildRight" in shown and "Broadcast" not in shown


def test_answers_reach_many_members_by_key(spark, capsys, monkeypatch):
    asked = spark.range(60).selectExpr("id as route_id", "id % 7 as a")
    answer = lambda one: one.selectExpr("route_id", "explode(sequence(0, a)) as k")
    want = sorted(tuple(r) for r in shared.once(asked, ("a",), answer).collect())
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 3)
    assert sorted(tuple(r) for r in shared.once(asked, ("a",), answer).collect()) == want == sorted((i, k) for i in range(60) for k in range(i % 7 + 1))

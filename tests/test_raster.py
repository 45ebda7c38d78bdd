"""Distance transforms against loops over all sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinegrid.operators import raster


def drawn(rng, n, width, height, keys):
    return [(int(rng.integers(keys)), int(rng.integers(width)), int(rng.integers(height)), int(rng.integers(4)) * 100 + k) for k in range(n)]


def brute(sources, cells, reach=None):
    """{(k, x, y): (d2, order)}: the least, ties to the smallest order."""
    out = {}
    for k, x, y in cells:
        found = [((x - a) ** 2 + (y - b) ** 2, o) for j, a, b, o in sources if j == k]
        if found and (reach is None or min(found)[0] <= reach * reach):
            out[k, x, y] = min(found)
    return out


@pytest.mark.parametrize(("reach", "tile"), [(1, 128), (3, 4), (5, 128), (9, 8)])
def test_bounded_transform_equals_loops(spark, monkeypatch, reach, tile):
    monkeypatch.setattr(raster, "TILE", tile)
    rng = np.random.default_rng(reach)
    sources = drawn(rng, 30, 21, 17, 2)
    table = spark.createDataFrame(sources, "k bigint, x bigint, y bigint, o bigint")
    want = brute(sources, [(k, x, y) for k in range(2) for x in range(21) for y in range(17)], reach)
    assert {(r.k, r.x, r.y): (r.d2, r.v) for r in raster.nearest(table.withColumn("v", F.col("o")), reach, (21, 17), "v", "o", ("k",)).collect()} == want
    assert {(r.k, r.x, r.y): r.d2 for r in raster.distance(table, reach, (21, 17), ("k",)).collect()} == {c: d for c, (d, _) in want.items()}


def test_bounded_transform_sends_few_rows(spark):
    """A large mass of sources is dealt about once, not once for each cell of a disc."""
    land = spark.range(300 * 300).selectExpr("id % 300 as x", "id div 300 as y")
    plan = raster.distance(land, 12, (300, 300))
    assert plan.count() == 90_000
    tiles = land.selectExpr("(least(x + 12, 299) div 128 - greatest(x - 12, 0) div 128 + 1) * (least(y + 12, 299) div 128 - greatest(y - 12, 0) div 128 + 1) as n")
    assert tiles.groupBy().sum("n").first()[0] < 1.5 * 90_000


@pytest.mark.parametrize("seed", range(3))
def test_unbounded_transform_equals_loops(spark, seed):
    rng = np.random.default_rng(seed)
    sources = [(0, *s[1:]) for s in drawn(rng, 12, 40, 25, 1)] + [(0, 5, 5, 7), (0, 5, 5, 3)]
    made = raster.transform(spark.createDataFrame(sources, "k bigint, x bigint, y bigint, o bigint"), "o", (40, 25)).collect()
    assert {(0, r.x, r.y): (r.d2, r.order) for r in made} == brute(sources, [(0, x, y) for x in range(40) for y in range(25)])
    assert len(made) == 1000 and all((r.x - r.sx) ** 2 + (r.y - r.sy) ** 2 == r.d2 for r in made)
    assert raster.transform(spark.createDataFrame([], "x bigint, y bigint, o bigint"), "o", (4, 5)).count() == 0


def test_monotone_minima_equal_a_scan():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (7, 1), (1, 9), (50, 13), (64, 64), (300, 41)):
        at, sites = np.sort(rng.choice(1000, n, False)), np.sort(rng.choice(1000, m, False))
        height = rng.integers(0, 400, m) ** 2 * 8 + rng.permutation(m) % 8
        cost = (at[:, None] - sites[None]) ** 2 * 8 + height[None]
        got = raster.monotone_minima(at, sites, height, 8)
        assert (cost[np.arange(n), got] == cost.min(axis=1)).all()

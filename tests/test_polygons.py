import json
import math
import random

from brinegrid.operators import polygons
from brinegrid.sources import geojson


def holds(rings, x, y):
    """Even-odd over all rings; points on an edge are out."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) and (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, cx, cy, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + rng.uniform(1, 12) * math.cos(a), cy + rng.uniform(1, 12) * math.sin(a)) for a in turns]
    return ring + ring[:1]


def test_first_polygon_equals_ray_casting(spark, tmp_path):
    rng = random.Random(5)
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    shapes = [[box(-10.0, -10.0, 10.0, 10.0), box(-4.0, -4.0, 4.0, 4.0)], [box(5.0, 5.0, 20.0, 20.0)]]
    shapes += [[star(rng, rng.uniform(-30, 30), rng.uniform(-30, 30), rng.randrange(3, 30))] for _ in range(12)]
    several = [[box(-40.0, 0.0, -35.5, 3.25)], [box(-38.0, 10.0, -30.0, 17.0)]]
    features = [{"type": "Feature", "properties": {"id": f"b{k}"}, "geometry": {"type": "Polygon", "coordinates": r}} for k, r in enumerate(shapes)]
    features.append({"type": "Feature", "properties": {"id": "several"}, "geometry": {"type": "MultiPolygon", "coordinates": several}})
    (tmp_path / "basins.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    shapes.append([r for part in several for r in part])
    points = [(rng.uniform(-45, 45), rng.uniform(-45, 45)) for _ in range(600)]
    # corners, edges and tile lines
    points += [(float(x), float(y)) for x in range(-12, 22) for y in (-10, -4, 0, 4, 5, 10, 20)] + [p for r in shapes[2] for p in r]
    want = {i: next((k for k, rings in enumerate(shapes) if holds(rings, x, y)), None) for i, (x, y) in enumerate(points)}
    table = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)] + [(-1, None, 3.0)], "i long, x double, y double")
    edges = geojson.basin_edges(spark, str(tmp_path / "basins.geojson")).cache()
    assert edges.filter("id = 'several'").count() == 8
    for side in (1.0, 7.5):
        assert {r.i: r.seq for r in polygons.first_polygon(table, edges, ("i",), side).collect()} == want | {-1: None}
    assert len({k for k in want.values() if k is not None}) > 8
    both = polygons.inside(table, edges, ("i",)).filter("seq < 2").groupBy("i").count().filter("count = 2").count()
    assert both == sum(holds(shapes[0], *p) and holds(shapes[1], *p) for p in points) > 0
    assert polygons.first_polygon(table.limit(0), edges, ("i",)).count() == 0
    assert polygons.first_polygon(table, edges.limit(0), ("i",)).filter("seq is not null").count() == 0


def test_tiles_are_whole_or_met(spark):
    rows = spark.createDataFrame([(0, *a, *b) for a, b in zip([(0.5, 0.5), (9.5, 0.5), (9.5, 9.5), (0.5, 9.5)], [(9.5, 0.5), (9.5, 9.5), (0.5, 9.5), (0.5, 0.5)])], "seq int, x1 double, y1 double, x2 double, y2 double")
    tiles = {(r.tx, r.ty): r.full for r in polygons.tile_index(rows, 1.0).collect()}
    assert {t for t, full in tiles.items() if full} == {(x, y) for x in range(1, 9) for y in range(1, 9)}
    assert {t for t, full in tiles.items() if not full} == {(x, y) for x in range(10) for y in range(10) if x in (0, 9) or y in (0, 9)}

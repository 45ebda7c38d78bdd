"""Simplification between and outside lanes against the rules as loops over one path."""

import math

import numpy as np
import pytest

from brinegrid.functions.grid import Grid
from brinegrid.operators import lines, polyline

SIDE = 30
GRID = Grid("EPSG:4326", 0.1, 0.1, 0.0, 30.0, SIDE, SIDE)


def plain(path, lane, held, sees, most):
    """The original's two phases; sees(a, b): whether cells a and b see each other."""
    def fits(path, s, e):
        return not any(held[k] for k in path[s + 1 : e]) and math.hypot(cell(path[s])[0] - cell(path[e])[0], cell(path[s])[1] - cell(path[e])[1]) <= most and sees(cell(path[s]), cell(path[e]))

    cell = lambda k: points[k]
    points, now = path, list(range(len(path)))
    flags = [lane[k] for k in now]
    gone, at = set(), [i for i, f in enumerate(flags) if f]
    runs, i = [], 0
    while i < len(now):
        if flags[i]:
            j = i
            while j + 1 < len(now) and flags[j + 1]:
                j += 1
            runs.append((i, j))
            i = j
        i += 1
    spans = [(s, e) for s, e in zip(at, at[1:]) if e - s > 1] + [(a[1], c[0]) for a, c in zip(runs, runs[2:])]
    for s, e in spans:
        if fits(now, s, e):
            gone |= set(range(s + 1, e))
    now = [k for k in now if k not in gone]
    keep, i = set(now), 0
    while i < len(now):
        if lane[now[i]]:
            i += 1
            continue
        start = max(0, i - 1)
        while i < len(now) and not lane[now[i]]:
            i += 1
        at = end = min(len(now) - 1, i)
        while end - start >= 2 and at > start:
            best = next((j for j in range(start, at) if fits(now, j, at)), None)
            if best is None:
                at -= 1
            else:
                keep -= set(now[best + 1 : at])
                at = best
    return [k for k in now if k in keep]


@pytest.mark.parametrize(("seed", "rounds"), [(1, 4), (2, 1), (3, 7)])
def test_lane_simplified_equals_loops(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(polyline, "ROUND", rounds)
    rng = np.random.default_rng(seed)
    lane, zone, land = (rng.random((SIDE, SIDE)) < p for p in (0.0, 0.01, 0.03))
    for x in (6, 7, 14, 15, 22):
        lane[:, x] = True
    rows = [(x, y, bool(land[y, x]), None, bool(lane[y, x]), 90 if lane[y, x] else None, bool(zone[y, x] and not lane[y, x]), False) for x in range(SIDE) for y in range(SIDE)]
    layers = spark.createDataFrame(rows, "x bigint, y bigint, land boolean, dist double, lane boolean, lane_dir bigint, zone boolean, boundary boolean").cache()
    paths = {}
    for r in range(6):
        x, y, path = 0, int(rng.integers(3, SIDE - 3)), []
        while x < SIDE and len(path) < 45:
            path.append((x, y))
            x, y = x + int(rng.random() < 0.7), min(SIDE - 1, max(0, y + int(rng.integers(-1, 2))))
        paths[r] = [p for k, p in enumerate(path) if k == 0 or p != path[k - 1]]
    held = {r: [bool(rng.random() < 0.05) for _ in p] for r, p in paths.items()}
    most = 14.0
    every = sorted({(*a, *b) for p in paths.values() for i, a in enumerate(p) for b in p[i:]})
    asked = spark.createDataFrame([(k, *c) for k, c in enumerate(every)], "k bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    seen = {every[r.k] for r in lines.clear_straight(asked, layers, ("k",), GRID, 1.0).filter("clear").collect()}
    want = {r: plain(p, [bool(lane[y, x]) for x, y in p], held[r], lambda a, b: (*a, *b) in seen, most) for r, p in paths.items()}
    points = spark.createDataFrame([(r, 10 * k, *c, held[r][k]) for r, p in paths.items() for k, c in enumerate(p)], "route_id bigint, seq bigint, x bigint, y bigint, preserve boolean")
    given = lines.lane_status(points, layers)
    made = polyline.lane_simplified(given, layers, GRID, most, 1.0)
    assert made.columns == given.columns
    got = {}
    for row in made.orderBy("route_id", "seq").collect():
        assert row.seq == len(got.setdefault(row.route_id, []))
        got[row.route_id].append((row.x, row.y))
    assert got == {r: [paths[r][k] for k in keep] for r, keep in want.items()}
    assert any(len(keep) < len(paths[r]) for r, keep in want.items())

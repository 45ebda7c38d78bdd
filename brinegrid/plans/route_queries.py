"""Queries of corridors, moves, searches, passages and polylines over the fixtures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as cl
from ..functions import geo, tags
from ..operators import corridor, lines, moves, passages, polyline, raster, search
from ..operators.lineage import cut, spread_out
from ..operators.shared import ENDS as LINE, given_out, members, once, unlike
from . import cell_queries as cq
from .fixtures import Fixtures, fixtures, sql
from ..settings import Settings
from .route import Attempt, by_legs, coarse, route, searched

#: What a route depends on.
ASKED = (*LINE, "draft")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixtures(spark, sf_dir))
        if text:
            SQL[f.__name__] = text
        return f

    return add


_APART = """SELECT r.route_id, c.x, c.y FROM requests r, cells0 c WHERE sqrt(pow(c.x - (x0 + t(c.x, c.y, x0, y0, x1, y1) * (x1 - x0)), 2) + pow(c.y - (y0 + t(c.x, c.y, x0, y0, x1, y1) * (y1 - y0)), 2)) <= 3.3"""
_T = "(CASE WHEN x0 = x1 AND y0 = y1 THEN 0.0 ELSE greatest(0.0, least(1.0, ((c.x - x0) * (x1 - x0) + (c.y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) END)"
_APART = _APART.replace("t(c.x, c.y, x0, y0, x1, y1)", _T)


@query(sql("SELECT route_id, x, y FROM corr ANTI JOIN land USING (x, y)", corr=_APART))
def c1_corridor(fx: Fixtures) -> DataFrame:
    return once(fx.requests, LINE, lambda one: corridor.straight_corridor(one, fx.grid, 3.3 * 60 * fx.grid.dx, fx.land))


@query(sql("SELECT DISTINCT route_id, x + dx AS x, y + dy AS y FROM (SELECT route_id, x0 AS x, y0 AS y FROM requests UNION ALL SELECT route_id, x1, y1 FROM requests), (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy), dim WHERE x + dx BETWEEN 0 AND w - 1 AND y + dy BETWEEN 0 AND w - 1 AND (x + dx, y + dy) NOT IN (SELECT (x, y) FROM land)"))
def c5_waypoint_corridor(fx: Fixtures) -> DataFrame:
    ends = lambda r: r.select("route_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("route_id", "p.*")
    return once(fx.requests, LINE, lambda one: corridor.waypoint_corridor(ends(one), 3, fx.size, fx.land))


@query(sql("SELECT route_id, x, y FROM corr", corr=_APART.replace("<= 3.3", "<= CAST(18.0 AS DOUBLE) / 60 / 0.1::DOUBLE")))
def c3_two_width_corridor(fx: Fixtures) -> DataFrame:
    return once(fx.requests, LINE, lambda one: corridor.two_width_corridor(one, fx.grid, 12.0, 6.0, 6.0))


def _ends(r: DataFrame) -> DataFrame:
    points = F.array(F.struct(F.lit(0).alias("seq"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    return r.select("route_id", F.explode(points).alias("p")).select("route_id", F.col("p.seq").cast("long").alias("seq"), "p.x", "p.y")


def _features(fx: Fixtures, r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the cells of each different line's corridor hold, whatever the draft, the requests that are on the line, and the lines."""
    found = members(r, LINE)
    one = unlike(found, LINE)
    made = corridor.marked(corridor.straight_corridor(one, fx.grid, 3.3 * 6, fx.land), fx.layers, _ends(one), fx.grid)
    return cut(made), found.select("route_id", "like").join(r.select("route_id", "draft"), "route_id"), one


def _at_drafts(fx: Fixtures) -> DataFrame:
    made, found, _ = _features(fx, fx.requests)
    return corridor.at_draft(given_out(made, found, keep=("draft",)), F.col("draft"))


_BEARING = "SELECT route_id, draft, x0, y0, x1, y1, " + cq.BEARING + " AS bearing FROM (SELECT *, -20.0 + (x0 + 0.5) * 0.1 AS lon1, 60.0 - (y0 + 0.5) * 0.1 AS lat1, -20.0 + (x1 + 0.5) * 0.1 AS lon2, 60.0 - (y1 + 0.5) * 0.1 AS lat2 FROM requests)"
_CELLS = f"""SELECT c.route_id, c.x, c.y, bearing, x0, y0, x1, y1, (NOT coalesce(depth <= -draft, false)) OR zone AS blocked, CASE WHEN coalesce(depth <= -draft, false) THEN round(5.0 / greatest(-depth - draft, 0.001), 6) ELSE 0.0 END AS depth_cost,
coalesce(round(greatest(0.0, 5.0 * (1 - dist / 6.0)), 6), 0.0) AS land_cost, near.x IS NOT NULL AS near, lane AND {cq._angle('lane_dir', 'bearing')} <= 90 AS r, lane AND {cq._angle('lane_dir', 'bearing')} > 90 AS w
FROM (SELECT * FROM corr ANTI JOIN land USING (x, y)) c JOIN layers l ON l.x = c.x AND l.y = c.y JOIN brg b ON b.route_id = c.route_id LEFT JOIN near ON near.x = c.x AND near.y = c.y"""
_NEAR = "SELECT DISTINCT x + dx AS x, y + dy AS y FROM lane, (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy)"
_AROUND = "SELECT route_id, x + dx AS x, y + dy AS y, min(CASE WHEN coalesce(r, false) THEN dx * dx + dy * dy END) AS rd, min(CASE WHEN coalesce(w, false) THEN dx * dx + dy * dy END) AS wd FROM fea, (SELECT unnest([0, 1, -1, 0, 0]) AS dx, unnest([0, 0, 0, 1, -1]) AS dy) WHERE r OR w GROUP BY 1, 2, 3"
_SNAP = "SELECT fea.*, a.rd IS NOT NULL AS band, a.rd IS NULL OR (NOT coalesce(w, false) AND (wd IS NULL OR rd <= wd)) AS snap0 FROM fea LEFT JOIN aro a ON a.route_id = fea.route_id AND a.x = fea.x AND a.y = fea.y"
_ENDS = "SELECT e.route_id, e.seq, e.x, e.y, snap0, w FROM (SELECT route_id, 0 AS seq, x0 AS x, y0 AS y FROM requests UNION ALL SELECT route_id, 1, x1, y1 FROM requests) e LEFT JOIN snp s ON s.route_id = e.route_id AND s.x = e.x AND s.y = e.y"
_BACK = "SELECT *, coalesce(NOT coalesce(w, false) AND snap0 IS NOT NULL AND (seq <= min(CASE WHEN snap0 THEN seq END) OVER r OR seq >= max(CASE WHEN snap0 THEN seq END) OVER r), false) AS back FROM ven WINDOW r AS (PARTITION BY route_id)"
_C4 = {"corr": _APART, "brg": _BEARING, "near": _NEAR, "fea": _CELLS, "aro": _AROUND, "snp": _SNAP, "ven": _ENDS, "bck": _BACK}


@query(sql("""SELECT s.route_id, s.x, s.y, blocked, depth_cost, land_cost, near, coalesce(r, false) AS right, coalesce(w, false) AS wrong, band, snap0 OR b.x IS NOT NULL AS snap, snap0 OR b.x IS NOT NULL OR NOT h.held AS open, round(bearing, 6) AS bearing
FROM snp s LEFT JOIN (SELECT DISTINCT route_id, x, y FROM bck WHERE back) b ON b.route_id = s.route_id AND b.x = s.x AND b.y = s.y JOIN (SELECT route_id, bool_and(coalesce(snap0, false) OR back) AS held FROM bck GROUP BY 1) h ON h.route_id = s.route_id""", **_C4))
def c4_features(fx: Fixtures) -> DataFrame:
    made = _at_drafts(fx)
    return made.select("route_id", "x", "y", "blocked", F.round("depth_cost", 6).alias("depth_cost"), F.round("land_cost", 6).alias("land_cost"), "near", "right", "wrong", "band", "snap", "open", F.round("bearing", 6).alias("bearing"))


@query(sql("SELECT route_id, x, y, blocked, depth_cost, land_cost FROM fea", **_C4))
def c2_c4_penalties(fx: Fixtures) -> DataFrame:
    return _at_drafts(fx).select("route_id", "x", "y", "blocked", F.round("depth_cost", 6).alias("depth_cost"), F.round("land_cost", 6).alias("land_cost"))


_WRONG_NEAR = f"SELECT c.x, c.y, min(CASE WHEN {cq._angle('l.lane_dir', '90')} > 90 THEN pow(l.x - c.x, 2) + pow(l.y - c.y, 2) END) AS wrong, min(CASE WHEN {cq._angle('l.lane_dir', '90')} <= 90 THEN pow(l.x - c.x, 2) + pow(l.y - c.y, 2) END) AS ok FROM cells0 c JOIN lane l ON abs(l.x - c.x) <= 2 AND abs(l.y - c.y) <= 2 AND pow(l.x - c.x, 2) + pow(l.y - c.y, 2) BETWEEN 1 AND 4 GROUP BY 1, 2"


@query(sql("SELECT x, y, wrong IS NOT NULL AND (ok IS NULL OR ok >= wrong) AS near_wrong FROM nw", nw=_WRONG_NEAR))
def p6_nearby_wrong_way(fx: Fixtures) -> DataFrame:
    points = fx.cells.select("x", "y", F.col("x").alias("kx"), F.col("y").alias("ky"), F.lit(90.0).alias("goal"))
    found = moves.nearer_wrong_way(points, fx.lane, 2, ("kx", "ky"))
    return found.select(F.col("kx").alias("x"), F.col("ky").alias("y"), "near_wrong")


def _terms(side: str) -> str:
    off = cq._angle("move", f"{side}.lane_dir")
    goal = cq._angle(f"{side}.lane_dir", "90")
    return f"CASE WHEN {side}.lane AND {goal} > 45 THEN 500.0 WHEN {side}.lane AND {off} > 90 THEN 1000.0 END", f"CASE WHEN {side}.lane THEN -50.0 * (1 - {off} / 90) ELSE 0.0 END"


_FAULTS, _BONUS = zip(_terms("p"), _terms("n"), strict=True)
_MOVE = "SELECT dx, dy, (degrees(atan2(CAST(dx AS DOUBLE), CAST(-dy AS DOUBLE))) + 360) % 360 AS move FROM (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy) WHERE dx <> 0 OR dy <> 0"
_CROSSING = "CASE WHEN p.lane AND NOT n.lane THEN 2.0 ELSE 0 END + CASE WHEN NOT p.zone AND n.zone THEN 1000.0 ELSE 0 END + CASE WHEN p.zone AND NOT n.zone THEN 250.0 ELSE 0 END + CASE WHEN p.zone <> n.zone OR (NOT p.boundary AND n.boundary) THEN 1000.0 ELSE 0 END + CASE WHEN n.boundary THEN 100.0 ELSE 0 END"


@query(sql(f"SELECT p.x, p.y, n.x AS nx, n.y AS ny, round(coalesce({_FAULTS[0]}, {_FAULTS[1]}, least(0.0, {_BONUS[0]}, {_BONUS[1]})), 6) AS alignment, {_CROSSING} AS crossing, round(0.5 * {cq._angle('move', '45')} / 180, 6) AS turn FROM layers p, mv, layers n WHERE n.x = p.x + dx AND n.y = p.y + dy", mv=_MOVE))
def p7_p8_p10_p15_move_terms(fx: Fixtures) -> DataFrame:
    table = moves.moves(fx.layers, ("lane", "lane_dir", "zone", "boundary"), ())
    move = geo.move_bearing_deg(F.col("dx"), F.col("dy"))
    sides = {name: (F.col(f"{s}_lane"), F.col(f"{s}_lane_dir"), F.lit(False)) for name, s in (("before", "p"), ("now", "n"))}
    flags = {s: {k: F.col(f"{s}_{k}") for k in ("lane", "zone", "boundary")} for s in ("p", "n")}
    aligned = cl.step_alignment(sides, move, F.lit(90.0), 1000.0, 50.0)
    crossing = cl.boundary_penalty(flags["p"], flags["n"], 2.0, 1000.0, 100.0)
    return table.select("x", "y", "nx", "ny", F.round(aligned, 6).alias("alignment"), crossing.alias("crossing"), F.round(cl.turn_penalty(F.lit(45.0), move, 0.5), 6).alias("turn"))


_SINGLE = f"CASE WHEN NOT n.lane THEN 0.0 WHEN {cq._angle('n.lane_dir', '90')} > 60 THEN 1000.0 WHEN {cq._angle('move', 'n.lane_dir')} > 80 THEN 1000.0 ELSE -50.0 * (1 - {cq._angle('move', 'n.lane_dir')} / 90) END"


@query(sql(f"SELECT n.x, n.y, dx, dy, round(CASE WHEN p.x IS NULL THEN {_SINGLE} ELSE coalesce({_FAULTS[0]}, {_FAULTS[1]}, least(0.0, {_BONUS[0]}, {_BONUS[1]})) END, 6) AS alignment FROM layers n CROSS JOIN mv LEFT JOIN layers p ON p.x = n.x - dx AND p.y = n.y - dy", mv=_MOVE))
def p7_p9_alignment(fx: Fixtures) -> DataFrame:
    """The lane term of arriving in every cell by every move; at the grid's edge, where no cell lies behind, of the cell alone."""
    steps = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in geo.MOVES])
    now = fx.layers.select("x", "y", F.col("lane").alias("n_lane"), F.col("lane_dir").alias("n_dir"), F.explode(steps).alias("m")).select("*", "m.dx", "m.dy")
    past = fx.layers.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("lane").alias("p_lane"), F.col("lane_dir").alias("p_dir"))
    met = now.withColumns({"px": F.col("x") - F.col("dx"), "py": F.col("y") - F.col("dy")}).join(past, ["px", "py"], "left")
    sides = {name: (F.coalesce(f"{s}_lane", F.lit(False)), F.col(f"{s}_dir"), F.lit(False)) for name, s in (("before", "p"), ("now", "n"))}
    term = cl.alignment(F.col("p_lane").isNotNull(), sides, geo.move_bearing_deg(F.col("dx"), F.col("dy")), F.lit(90.0), 1000.0, 50.0, 60.0)
    return met.select("x", "y", "dx", "dy", F.round(term, 6).alias("alignment"))


@query()
def p14_move_costs(fx: Fixtures) -> DataFrame:
    made, found, one = _features(fx, fx.requests)
    goals = one.select("route_id", F.col("x1").alias("gx"), F.col("y1").alias("gy"))
    terms = moves.terms(made, fx.lane, goals, fx.grid)
    priced = moves.at_draft(given_out(terms, found, keep=("draft",)), F.col("draft"))
    return priced.select("route_id", "x", "y", "nx", "ny", "dir", F.round("cost", 6).alias("cost"))


@query()
def a2_route_kernel(fx: Fixtures) -> DataFrame:
    found = once(fx.requests, ASKED, lambda one: searched(one, fx.layers, fx.grid, Settings(width_nm=24.0), Attempt()))
    return found.select("route_id", F.size("path").alias("n"), "explored", F.round("cost", 3).alias("cost"), "success")


_COARSE = "SELECT x // 8 AS cx, y // 8 AS cy FROM layers GROUP BY 1, 2 HAVING bool_or(coalesce(depth <= -1, false)) AND bool_or(NOT land)"
_NEXT = "SELECT p.cx, p.cy, n.cx AS nx, n.cy AS ny, CASE WHEN dx <> 0 AND dy <> 0 THEN 1.414 ELSE 1.0 END * 8 * sqrt(pow(6.0 * cos(radians(60.0 - (p.cy * 8 + 4) * 0.1)), 2) + 36.0) / 1.414 AS cost FROM blk p, mv, blk n WHERE n.cx = p.cx + dx AND n.cy = p.cy + dy"
_STARTS = "SELECT DISTINCT x0 // 8 AS sx, y0 // 8 AS sy FROM requests"
_RELAX = "SELECT sx, sy, sx AS cx, sy AS cy, 0.0::DOUBLE AS cost, 0 AS depth FROM sta WHERE (sx, sy) IN (SELECT (cx, cy) FROM blk) UNION SELECT * FROM (SELECT r.sx, r.sy, s.nx, s.ny, min(r.cost + s.cost), max(r.depth) + 1 FROM rel r JOIN stp s ON s.cx = r.cx AND s.cy = r.cy WHERE r.depth < 60 GROUP BY 1, 2, 3, 4)"


@query(sql("SELECT sx * 1000 + sy AS start, cx, cy, round(min(cost), 6) AS cost FROM rel GROUP BY 1, 2, 3", True, mv=_MOVE, blk=_COARSE, stp=_NEXT, sta=_STARTS, rel=_RELAX))
def a6_coarse_distance(fx: Fixtures) -> DataFrame:
    """Distances from every block in which a request starts to every block; requests that share a block share its rows."""
    blocks = cut(raster.coarse_open(fx.layers, 8, 1.0).filter("open").select("cx", "cy"))
    starts = fx.requests.select(F.expr("x0 div 8").alias("x"), F.expr("y0 div 8").alias("y")).distinct().join(blocks.select(F.col("cx").alias("x"), F.col("cy").alias("y")), ["x", "y"], "left_semi")
    found = search.coarse_distances(starts.select((F.col("x") * 1000 + F.col("y")).alias("route_id"), "x", "y"), blocks, fx.grid, 8)
    return found.select(F.col("route_id").alias("start"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.round("cost", 6).alias("cost"))


@query()
def a4_coarse_to_fine_legs(fx: Fixtures) -> DataFrame:
    return once(fx.requests, ASKED, lambda one: search.coarse_to_fine(coarse(one, fx.layers, fx.grid, 8), one, 8))


@query()
def a4b_coarse_to_fine(fx: Fixtures) -> DataFrame:
    """Every request searched leg by leg along its coarse path."""
    found = once(fx.requests, ASKED, lambda one: by_legs(one, fx.layers, fx.grid, Settings(coarse_scale=8, width_nm=24.0)))
    return found.select("route_id", F.size("path").alias("n"), "explored", F.round("cost", 3).alias("cost"), "success", F.sha2(F.to_json("path"), 256).alias("path_sha256"))


_MACRO = "SELECT node AS start, node, 0.0::DOUBLE AS weight_nm, [node] AS path FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT m.start, e.dst, m.weight_nm + e.weight_nm, list_append(path, e.dst) FROM mac m JOIN edges e ON e.src = m.node WHERE len(path) < 12 AND NOT list_contains(path, e.dst) AND m.weight_nm + e.weight_nm < 4000"


@query(sql("SELECT start, node, min(weight_nm) AS weight_nm FROM mac GROUP BY 1, 2", True, mac=_MACRO))
def a9_macro_distance(fx: Fixtures) -> DataFrame:
    starts = fx.passages.select(F.col("src").alias("node")).union(fx.passages.select("dst")).distinct()
    return passages.macro_routes(fx.passages, starts).select("start", "node", "weight_nm")


_BEST = "SELECT start, node, path FROM mac QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY weight_nm, path) = 1"


@query(sql("SELECT start, node, (len(path) - 1)::INTEGER AS n, CAST(to_json([{'lon': path[i]::DOUBLE, 'lat': path[i + 1]::DOUBLE} FOR i IN range(1, len(path))]) AS VARCHAR) AS waypoints FROM best WHERE len(path) > 1", True, mac=_MACRO, best=_BEST))
def a10_macro_waypoints(fx: Fixtures) -> DataFrame:
    edges = fx.passages.withColumn("waypoints", F.array(F.struct(F.col("src").cast("double").alias("lon"), F.col("dst").cast("double").alias("lat"))))
    nodes = fx.passages.select(F.col("src").alias("node")).union(fx.passages.select("dst")).distinct()
    found = passages.macro_routes(fx.passages, nodes)
    return passages.corridor_waypoints(found, edges).select("start", "node", F.size("waypoints").alias("n"), F.to_json("waypoints").alias("waypoints"))


@query(sql("SELECT c.x, c.y, arg_min(b.id, b.seq) AS basin FROM cells0 c LEFT JOIN basins b ON c.x > bx0 AND c.x < bx1 AND c.y > by0 AND c.y < by1 GROUP BY 1, 2"))
def a11_basin(fx: Fixtures) -> DataFrame:
    return passages.basin_of(fx.cells.select("x", "y"), fx.basins, ("x", "y"))


def _before(requests: DataFrame) -> DataFrame:
    walked = lines.walk(spread_out(requests, "route_id"), ("route_id",))
    over = Window.partitionBy("route_id").orderBy("i")
    return walked.select("route_id", "x", "y", F.lag("x").over(over).alias("px"), F.lag("y").over(over).alias("py")).filter("px is not null")


@query(sql("SELECT route_id, i AS seq, x, y FROM lw", ln="SELECT route_id, x0, y0, x1, y1 FROM requests", lw=cq.WALKED))
def a8_reconstruct(fx: Fixtures) -> DataFrame:
    ends = lambda one: one.select("route_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return once(fx.requests, LINE, lambda one: search.reconstructed(_before(one), ends(one)))


_THREE = "SELECT route_id, 0 AS seq, x0 AS x, y0 AS y FROM requests UNION ALL SELECT route_id, 1, (x0 + y1) % w, (y0 + x1) % w FROM requests, dim UNION ALL SELECT route_id, 2, x1, y1 FROM requests"
_LEGS = "SELECT route_id * 10 + seq AS route_id, x0, y0, x1, y1 FROM (SELECT route_id, seq, x AS x0, y AS y0, lead(x) OVER p AS x1, lead(y) OVER p AS y1 FROM th WINDOW p AS (PARTITION BY route_id ORDER BY seq)) WHERE x1 IS NOT NULL"


def _three(fx: Fixtures, r: DataFrame) -> DataFrame:
    w = F.lit(fx.w).cast("long")
    at = lambda n, x, y: r.select("route_id", F.lit(n).cast("long").alias("seq"), x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return at(0, x0, y0).unionByName(at(1, (x0 + y1) % w, (y0 + x1) % w)).unionByName(at(2, x1, y1))


@query(sql("SELECT route_id // 10 AS route_id, route_id % 10 AS seq FROM wr WHERE wrong", th=_THREE, ln=_LEGS, lw=cq.WALKED, ends=cq.ENDS, wr=cq.WRONG))
def x8_wrong_way_segments(fx: Fixtures) -> DataFrame:
    return once(fx.requests, LINE, lambda one: polyline.wrong_segments(_three(fx, one), fx.layers, fx.grid).select("route_id", "seq"))


@query()
def x9_bypasses(fx: Fixtures) -> DataFrame:
    return once(fx.requests, LINE, lambda one: polyline.bypasses(polyline.wrong_segments(_three(fx, one), fx.layers, fx.grid), fx.layers, fx.grid))


@query(sql(f"SELECT route_id, round(sum(coalesce({cq.PLANAR}, 0.0)), 3) AS distance_nm FROM pairs GROUP BY 1", pairs=cq.PAIRS))
def x10_path_length(fx: Fixtures) -> DataFrame:
    return polyline.lengths(fx.track).select("route_id", F.round("distance_nm", 3).alias("distance_nm"))


@query(sql("SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS seq, lon, lat FROM track"))
def x11_stitch(fx: Fixtures) -> DataFrame:
    own = fx.track.withColumn("seg", F.expr("(seq - 1) div 5"))
    joint = own.filter("(seq - 1) % 5 = 0 and seq > 1").withColumn("seg", F.col("seg") - 1)
    return polyline.stitched(own.unionByName(joint))


@query(sql("SELECT route_id, seq, lat, lon FROM track"))
def x12_flip(fx: Fixtures) -> DataFrame:
    path = fx.track.select("route_id", "seq", F.array(F.struct("lon", "lat")).alias("p"))
    return path.withColumn("p", tags.flipped(F.col("p"))[0]).select("route_id", "seq", "p.lat", "p.lon")


@query(sql(f"SELECT route_id, sum(CASE WHEN lane AND {cq._angle('(round(degrees(atan2(lon2 - lon1, lat2 - lat1)), 6) + 360) % 360', 'lane_dir')} > 90 THEN 1 ELSE 0 END)::BIGINT AS wrong_points FROM (SELECT route_id, x, y, -20.0 + (x + 0.5) * 0.1 AS lon2, 60.0 - (y + 0.5) * 0.1 AS lat2, lag(-20.0 + (x + 0.5) * 0.1) OVER p AS lon1, lag(60.0 - (y + 0.5) * 0.1) OVER p AS lat1 FROM lw WINDOW p AS (PARTITION BY route_id ORDER BY i)) q LEFT JOIN layers l ON l.x = q.x AND l.y = q.y GROUP BY 1", ln="SELECT route_id, x0, y0, x1, y1 FROM requests", lw=cq.WALKED))
def l10_wrong_way_audit(fx: Fixtures) -> DataFrame:
    lon, lat = fx.grid.centre(F.col("x"), F.col("y"))
    walked = lambda one: lines.walk(spread_out(one, "route_id"), ("route_id",)).withColumnRenamed("i", "seq").withColumns({"lon": lon, "lat": lat})
    return once(fx.requests, LINE, lambda one: lines.wrong_way_audit(walked(one), fx.layers, "route_id"))


@query()
def x4_lane_aware_simplify(fx: Fixtures) -> DataFrame:
    points = lambda one: lines.lane_status(lines.walk(spread_out(one, "route_id"), ("route_id",)).withColumnRenamed("i", "seq"), fx.layers)
    made = once(fx.requests, LINE, lambda one: polyline.lane_simplified(points(one), fx.layers, fx.grid, Settings().max_simplify_nm / fx.grid.cell_nm, 1.0))
    return made.select("route_id", "seq", "x", "y", "in_lane")


@query()
def x1_x3_string_pull(fx: Fixtures) -> DataFrame:
    points = lambda one: lines.walk(spread_out(one, "route_id"), ("route_id",)).withColumnRenamed("i", "seq")
    return once(fx.requests, LINE, lambda one: polyline.farthest_seen(points(one), fx.layers, fx.grid, Settings().max_skip, 1.0))


@query()
def x1_string_pull_by_search(fx: Fixtures) -> DataFrame:
    points = lambda one: lines.walk(spread_out(one, "route_id"), ("route_id", "draft")).withColumnRenamed("i", "seq")
    return once(fx.requests, ASKED, lambda one: polyline.string_pulled(points(one), fx.layers, 500, 5.0))


@query()
def x5_x6_douglas_peucker(fx: Fixtures) -> DataFrame:
    return polyline.douglas_peucker(fx.track.withColumn("flag", F.col("lon") > 0), 600.0, "flag").select("route_id", "seq", "lon", "lat")


@query()
def x7_spline(fx: Fixtures) -> DataFrame:
    made = polyline.splined(fx.track, 25)
    return made.select("route_id", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query()
def route_batch(fx: Fixtures) -> DataFrame:
    """The flagship: fixture rasters, open water, corridors, search, simplification and repair for a batch of requests."""
    made = once(fx.requests, ASKED, lambda one: route(one, fx.layers, fx.grid, Settings(width_nm=24.0)))
    return made.select("route_id", F.to_json("path").alias("path"), F.round("distance_nm", 6).alias("distance_nm"), "explored", "attempt", F.to_json("warnings").alias("warnings"))

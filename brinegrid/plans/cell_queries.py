"""Queries of functions, cells, rasters and lines over the fixtures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as cl
from ..functions import geo, tags
from ..operators import lines, raster
from ..operators.lineage import spread_out
from ..operators.shared import ENDS as LINE, once
from .fixtures import Fixtures, fixtures, sql, walk_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixtures(spark, sf_dir))
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _pair(df: DataFrame) -> DataFrame:
    over = Window.partitionBy("route_id").orderBy("seq")
    return df.select("route_id", "seq", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lead("lon").over(over).alias("lon2"), F.lead("lat").over(over).alias("lat2")).filter("lon2 is not null")


PAIRS = "SELECT route_id, seq, lon AS lon1, lat AS lat1, lead(lon) OVER p AS lon2, lead(lat) OVER p AS lat2 FROM track WINDOW p AS (PARTITION BY route_id ORDER BY seq)"
PLANAR = "60 * sqrt(pow(lat2 - lat1, 2) + pow((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), 2))"
ATAN = "atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))"
BEARING = f"(round(degrees({ATAN}), 6) + 360) % 360"


def _points():
    return tuple(F.col(c) for c in ("lon1", "lat1", "lon2", "lat2"))


def _angle(a: str, b: str) -> str:
    return f"abs(((({a}) - ({b}) + 180) % 360 + 360) % 360 - 180)"


@query(sql(f"SELECT route_id, seq, round({PLANAR}, 6) AS distance_nm FROM pairs WHERE lon2 IS NOT NULL", pairs=PAIRS))
def f1_planar_distance(fx: Fixtures) -> DataFrame:
    return _pair(fx.track).select("route_id", "seq", F.round(geo.planar_distance_nm(*_points()), 6).alias("distance_nm"))


@query(sql(f"SELECT route_id, seq, round((degrees({ATAN}) + 360) % 360, 5) % 360 AS bearing FROM pairs WHERE lon2 IS NOT NULL", pairs=PAIRS))
def f3_bearing(fx: Fixtures) -> DataFrame:
    return _pair(fx.track).select("route_id", "seq", F.pmod(F.round(geo.bearing_deg(*_points()), 5), F.lit(360.0)).alias("bearing"))


@query(sql(f"SELECT route_id, seq, CAST({_angle('37 * seq % 720 - 360', '53 * seq % 360')} AS DOUBLE) AS angle FROM track"))
def f4_angle_between(fx: Fixtures) -> DataFrame:
    return fx.track.select("route_id", "seq", geo.angle_between_deg((F.col("seq") * 37 % 720 - 360).cast("double"), (F.col("seq") * 53 % 360).cast("double")).alias("angle"))


@query(sql("SELECT route_id, seq, CASE WHEN lon + 90 > 180 THEN lon - 270 WHEN lon + 90 < -180 THEN lon + 450 ELSE lon + 90 END AS lon, greatest(least(lat * 2, 90.0), -90.0) AS lat FROM track"))
def f5_f6_wrap_clamp(fx: Fixtures) -> DataFrame:
    return fx.track.select("route_id", "seq", geo.wrap_lon(F.col("lon") + 90).alias("lon"), geo.clamp_lat(F.col("lat") * 2).alias("lat"))


@query(sql("SELECT route_id, seq, round(radians(lon) * 6371008.8, 3) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6371008.8, 3) + 0.0 AS my FROM track"))
def f7_mercator(fx: Fixtures) -> DataFrame:
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    return fx.track.select("route_id", "seq", F.round(x, 3).alias("mx"), (F.round(y, 3) + 0.0).alias("my"))


_RHUMB = "2 * degrees(atan(exp(ln(tan(pi() / 4 + radians(lat1) / 2)) + (ln(tan(pi() / 4 + radians(lat2) / 2)) - ln(tan(pi() / 4 + radians(lat1) / 2))) * k / 4))) - 90"


@query(sql(f"SELECT route_id, seq, k, round(lon1 + (lon2 - lon1) * k / 4, 6) AS lon, round({_RHUMB}, 6) AS lat FROM (SELECT *, unnest(range(5)) AS k FROM pairs WHERE lon2 IS NOT NULL)", pairs=PAIRS))
def f8_rhumb_samples(fx: Fixtures) -> DataFrame:
    at = _pair(fx.track).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    lon, lat = geo.rhumb_point(*_points(), F.col("k") / 4)
    return at.select("route_id", "seq", "k", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(sql("SELECT route_id, seq, round(CASE WHEN lon2 <> lon1 AND lat2 <> lat1 THEN sqrt(pow(abs(lon2 - lon1) * 60 * cos(radians(lat1)), 2) + pow(abs(lat2 - lat1) * 60, 2)) ELSE abs(lon2 - lon1) * 60 * cos(radians(lat1)) + abs(lat2 - lat1) * 60 END, 6) AS cost, round(lon1 + (lon2 - lon1) * 0.25, 6) AS lon, round(lat1 + (lat2 - lat1) * 0.25, 6) AS lat FROM pairs WHERE lon2 IS NOT NULL", pairs=PAIRS))
def f9_f10_move_cost(fx: Fixtures) -> DataFrame:
    a, b, c, d = _points()
    lon, lat = geo.straight_point(a, b, c, d, F.lit(0.25))
    return _pair(fx.track).select("route_id", "seq", F.round(geo.degree_move_nm(c - a, d - b, b), 6).alias("cost"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(sql("SELECT route_id, seq, CAST(floor((lon + 0.03 - -20.0) / 0.1) AS BIGINT) AS x, CAST(floor((60.0 - (lat + 0.03)) / 0.1) AS BIGINT) AS y, least(greatest(CAST(floor((lon + 0.03 - -20.0) / 0.1) AS BIGINT), 0), w - 1) AS cx, CAST(floor((lon + 0.03 - -20.0) / 0.1) AS BIGINT) BETWEEN 0 AND w - 1 AND CAST(floor((60.0 - (lat + 0.03)) / 0.1) AS BIGINT) BETWEEN 0 AND w - 1 AS valid FROM track, dim"))
def f11_f13_f14_to_cell(fx: Fixtures) -> DataFrame:
    x, y = fx.grid.to_cell(F.col("lon") + 0.03, F.col("lat") + 0.03)
    return fx.track.select("route_id", "seq", x.alias("x"), y.alias("y"), fx.grid.clip(x, y)[0].alias("cx"), fx.grid.holds(x, y).alias("valid"))


@query(sql("SELECT x, y, round(-20.0 + (x + 0.5) * 0.1, 6) AS lon, round(60.0 - (y + 0.5) * 0.1, 6) AS lat FROM cells0"))
def f12_cell_centre(fx: Fixtures) -> DataFrame:
    lon, lat = fx.grid.centre(F.col("x"), F.col("y"))
    return fx.cells.select("x", "y", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))




@query(sql("SELECT feat, greatest(least(ax, ex), 0) AS x_off, greatest(least(ay, ey), 0) AS y_off, least(greatest(ax, ex) + 1, n) - greatest(least(ax, ex), 0) AS w, least(greatest(ay, ey) + 1, n) - greatest(least(ay, ey), 0) AS h FROM (SELECT feat, x0 - 3 AS ax, x1 + 3 AS ex, y0 - 3 AS ay, y1 + 3 AS ey, w AS n FROM lane_feat, dim)"))
def f15_window(fx: Fixtures) -> DataFrame:
    g = fx.grid
    (a, b), (c, d) = g.centre(F.col("x0") - 3, F.col("y0") - 3), g.centre(F.col("x1") + 3, F.col("y1") + 3)
    made = g.window(a, d, c, b)
    return fx.lane_features.select("feat", *[v.alias(k) for k, v in made.items()])


@query(sql("SELECT x, y, diagonal, round(CASE WHEN diagonal THEN 1.414 ELSE 1.0 END * sqrt(pow(6.0 * cos(radians(60.0 - (y + 0.5) * 0.1)), 2) + 36.0) / sqrt(2.0), 6) AS fine, round(CASE WHEN diagonal THEN 1.414 ELSE 1.0 END * 8 * sqrt(pow(6.0 * cos(radians(60.0 - (y + 0.5) * 0.1)), 2) + 36.0) / 1.414, 6) AS coarse FROM cells0, (SELECT unnest([true, false]) AS diagonal)"))
def f16_f17_step_cost(fx: Fixtures) -> DataFrame:
    lat = fx.grid.centre(F.col("x"), F.col("y"))[1]
    cells = fx.cells.withColumn("diagonal", F.explode(F.array(F.lit(True), F.lit(False))))
    fine, coarse = geo.step_nm(lat, 6.0, 6.0, F.col("diagonal")), geo.coarse_step_nm(lat, 0.1, 0.1, 8, F.col("diagonal"))
    return cells.select("x", "y", "diagonal", F.round(fine, 6).alias("fine"), F.round(coarse, 6).alias("coarse"))


@query(sql("SELECT feat, i, dx, dy, round((round(degrees(atan2(CAST(dx AS DOUBLE), CAST(-dy AS DOUBLE))), 6) + 360) % 360, 6) AS bearing FROM (SELECT feat, i, lead(x) OVER p - x AS dx, lead(y) OVER p - y AS dy FROM walk WINDOW p AS (PARTITION BY feat ORDER BY i)) WHERE dx IS NOT NULL"))
def f20_move_bearing(fx: Fixtures) -> DataFrame:
    """The bearing of every step of the lanes' walks."""
    over = Window.partitionBy("feat").orderBy("i")
    steps = fx.walked.withColumns({"dx": F.lead("x").over(over) - F.col("x"), "dy": F.lead("y").over(over) - F.col("y")}).filter("dx is not null")
    return steps.select("feat", "i", "dx", "dy", F.pmod(F.round(geo.move_bearing_deg(F.col("dx"), F.col("dy")), 6), F.lit(360.0)).alias("bearing"))


@query(sql("SELECT route_id, seq, round((degrees(atan2((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), lat2 - lat1)) + 360) % 360, 5) % 360 AS bearing FROM pairs WHERE lon2 IS NOT NULL", pairs=PAIRS))
def f21_goal_bearing(fx: Fixtures) -> DataFrame:
    return _pair(fx.track).select("route_id", "seq", F.pmod(F.round(geo.goal_bearing_deg(*_points()), 5), F.lit(360.0)).alias("bearing"))


_CROSS = """SELECT route_id, seq, CASE WHEN len2 > 0 THEN greatest(0.0, least(1.0, ((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / len2)) ELSE 0.0 END AS t, px, py, ax, ay, ex, ey
FROM (SELECT *, pow(ex - ax, 2) + pow(ey - ay, 2) AS len2 FROM (SELECT route_id, seq, (lon1 + 1) * 60 * cos(radians(lat1 - 1)) AS px, (lat1 - 1) * 60 AS py, lon1 * 60 * cos(radians(lat1)) AS ax, lat1 * 60 AS ay, lon2 * 60 * cos(radians(lat2)) AS ex, lat2 * 60 AS ey FROM pairs WHERE lon2 IS NOT NULL))"""


@query(sql("SELECT route_id, seq, round(sqrt(pow(px - (ax + t * (ex - ax)), 2) + pow(py - (ay + t * (ey - ay)), 2)), 6) AS apart FROM crossed", pairs=PAIRS, crossed=_CROSS))
def f22_cross_track(fx: Fixtures) -> DataFrame:
    a, b, c, d = _points()
    return _pair(fx.track).select("route_id", "seq", F.round(geo.cross_track_nm(a + 1, b - 1, a, b, c, d), 6).alias("apart"))


@query(sql("SELECT feat, k AS width_nm, CAST(greatest(1, round_even(k / 1.0 / 2, 0)) AS BIGINT) AS r, round(k / 60.0, 6) AS deg FROM (SELECT CAST(p_partkey AS BIGINT) AS feat, CAST(p_size AS BIGINT) AS k FROM part)"))
def f23_f24_radius(fx: Fixtures) -> DataFrame:
    """Half the width of every feature, its part's size in nautical miles, in cells of 1 nm and in degrees."""
    widths = fx.table("part").select(F.col("p_partkey").cast("long").alias("feat"), F.col("p_size").cast("long").alias("width_nm"))
    return widths.select("feat", "width_nm", geo.radius_cells(F.col("width_nm").cast("double"), F.lit(1.0)).cast("long").alias("r"), F.round(geo.nm_to_deg(F.col("width_nm")), 6).alias("deg"))


@query(sql("SELECT x, y, coalesce(depth <= -10, false) AS safe, CASE WHEN coalesce(depth <= -10, false) THEN round(5.0 / greatest(-depth - 10, 0.001), 6) ELSE CAST('inf' AS DOUBLE) END AS penalty FROM cells0"))
def p1_p2_depth(fx: Fixtures) -> DataFrame:
    d, draft = F.col("depth"), F.lit(10)
    return fx.cells.select("x", "y", cl.deep_enough(d, draft).alias("safe"), F.when(cl.deep_enough(d, draft), F.round(cl.depth_penalty(d, draft, 5.0), 6)).otherwise(cl.depth_penalty(d, draft, 5.0)).alias("penalty"))


@query(sql("SELECT x, y, round(greatest(0.0, 5.0 * (1 - sqrt(d2) / 6.0)), 6) AS penalty FROM edt"))
def p3_land_proximity(fx: Fixtures) -> DataFrame:
    near = raster.distance(fx.land, 6, fx.size)
    return near.select("x", "y", F.round(cl.land_penalty(F.sqrt("d2"), 5.0, 6.0), 6).alias("penalty"))


_NEAR = "SELECT DISTINCT l.x + dx AS x, l.y + dy AS y FROM lane l, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy), dim WHERE l.x + dx BETWEEN 0 AND w - 1 AND l.y + dy BETWEEN 0 AND w - 1"


@query(sql("SELECT x, y, lane, zone, boundary, (x, y) IN (SELECT (x, y) FROM near) AS near_lane FROM layers", near=_NEAR))
def p4_p5_lane_flags(fx: Fixtures) -> DataFrame:
    near = raster.dilated(fx.lane, raster.square(2), fx.size).withColumn("near_lane", F.lit(True))
    return fx.layers.join(near, ["x", "y"], "left").select("x", "y", "lane", "zone", "boundary", F.coalesce("near_lane", F.lit(False)).alias("near_lane"))


@query(sql("SELECT x, y, NOT coalesce(depth <= -10, false) OR zone AS blocked, CASE WHEN land THEN 1 WHEN boundary THEN 4 WHEN zone THEN 3 WHEN lane THEN 2 ELSE 0 END AS class FROM layers"))
def p11_p12_blocked_class(fx: Fixtures) -> DataFrame:
    c = {k: F.col(k) for k in ("land", "lane", "zone", "boundary")}
    return fx.layers.select("x", "y", cl.blocked(F.col("depth"), F.lit(10), c["zone"]).alias("blocked"), cl.composite_class(*c.values()).alias("class"))


@query(sql("SELECT x, y, round(2.0 * density, 6) AS bias FROM density"))
def p13_density_bias(fx: Fixtures) -> DataFrame:
    return fx.density.select("x", "y", F.round(cl.density_bias(F.col("density"), -2.0), 6).alias("bias"))


@query(sql("SELECT feat, CASE WHEN kind = '' THEN NULL ELSE kind END AS kind, contains(other_tags, 'precautionary_area') AS precautionary, CASE WHEN kind = 'separation_lane' THEN 'lane' WHEN kind = 'separation_zone' THEN 'zone' WHEN kind IN ('separation_boundary', 'separation_line', 'inshore_traffic_zone') AND NOT contains(other_tags, 'precautionary_area') THEN 'boundary' END AS class FROM (SELECT *, regexp_extract(other_tags, '\"seamark:type\"=>\"([^\"]+)\"', 1) AS kind FROM tags)"))
def j1_j3_p17_features(fx: Fixtures) -> DataFrame:
    kind, careful = tags.seamark_type(None, F.col("other_tags")), tags.is_precautionary(tags.tag(F.col("other_tags"), "seamark:information"), F.col("other_tags"))
    return fx.features.select("feat", kind.alias("kind"), careful.alias("precautionary"), tags.feature_class(kind, careful).alias("class"))


@query(sql("SELECT route_id, seq, TRY_CAST(CASE WHEN seq % 5 = 0 THEN 'n/a' ELSE CAST(seq * 7 % 360 AS VARCHAR) || '.7' END AS DOUBLE) AS bearing, CAST(split_part(CAST(seq AS VARCHAR) || ',' || CAST(route_id AS VARCHAR), ',', 1) AS DOUBLE) AS lon, CAST(split_part(CAST(seq AS VARCHAR) || ',' || CAST(route_id AS VARCHAR), ',', 2) AS DOUBLE) AS lat FROM track"))
def j2_j4_parse(fx: Fixtures) -> DataFrame:
    raw = F.when(F.col("seq") % 5 == 0, "n/a").otherwise(F.concat((F.col("seq") * 7 % 360).cast("string"), F.lit(".7")))
    lon, lat = tags.lon_lat(F.concat_ws(",", F.col("seq").cast("string"), F.col("route_id").cast("string")))
    return fx.track.select("route_id", "seq", tags.flow_bearing(raw).alias("bearing"), lon.alias("lon"), lat.alias("lat"))


def _dilate_sql(source: str, r: int, test: str) -> str:
    return f"SELECT DISTINCT s.x + dx AS x, s.y + dy AS y FROM {source} s, (SELECT unnest(range(-{r}, {r} + 1)) AS dx), (SELECT unnest(range(-{r}, {r} + 1)) AS dy), dim WHERE {test} AND s.x + dx BETWEEN 0 AND w - 1 AND s.y + dy BETWEEN 0 AND w - 1"


@query(sql(_dilate_sql("land", 2, "abs(dx) + abs(dy) <= 2")))
def m1_cross_dilation(fx: Fixtures) -> DataFrame:
    return raster.dilated(fx.land, raster.cross(2), fx.size)


@query(sql(_dilate_sql("lane", 2, "true")))
def m2_square_dilation(fx: Fixtures) -> DataFrame:
    return raster.dilated(fx.lane, raster.square(2), fx.size)


@query(sql("SELECT x, y, CAST(d2 AS BIGINT) AS d2 FROM edt"))
def m3_bounded_distance(fx: Fixtures) -> DataFrame:
    return raster.distance(fx.land, 6, fx.size)


_BAND = "SELECT l.x + dx AS x, l.y + dy AS y, {} AS d2 FROM lane l, (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy), dim WHERE dx * dx + dy * dy <= 9 AND l.x + dx BETWEEN 0 AND w - 1 AND l.y + dy BETWEEN 0 AND w - 1 AND {} GROUP BY 1, 2"


@query(sql("SELECT c.x, c.y, CAST(c.d2 AS BIGINT) AS right_d2, CAST(r.d2 AS BIGINT) AS wrong_d2, r.d2 IS NULL OR c.d2 <= r.d2 AS snapped FROM ok c LEFT JOIN bad r ON c.x = r.x AND c.y = r.y", ok=_BAND.format("min(dx * dx + dy * dy)", _angle("lane_dir", "90") + " <= 90"), bad=_BAND.format("min(dx * dx + dy * dy)", _angle("lane_dir", "90") + " > 90")))
def m4_lane_band(fx: Fixtures) -> DataFrame:
    off = geo.angle_between_deg(F.col("lane_dir").cast("double"), F.lit(90.0))
    right = raster.distance(fx.lane.filter(off <= 90), 3, fx.size).withColumnRenamed("d2", "right_d2")
    wrong = raster.distance(fx.lane.filter(off > 90), 3, fx.size).withColumnRenamed("d2", "wrong_d2")
    return right.join(wrong, ["x", "y"], "left").select("x", "y", "right_d2", "wrong_d2", F.coalesce(F.col("right_d2") <= F.col("wrong_d2"), F.lit(True)).alias("snapped"))


@query(sql("SELECT x, y, CAST(d2 AS BIGINT) AS d2, CAST(s.dir AS BIGINT) AS dir FROM (SELECT p.x + dx AS x, p.y + dy AS y, min(dx * dx + dy * dy) AS d2, arg_min({'dir': p.dir}, (dx * dx + dy * dy) * 1000000 + p.feat * 1000 + p.i) AS s FROM walk p, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy), dim WHERE dx * dx + dy * dy <= 4 AND p.x + dx BETWEEN 0 AND w - 1 AND p.y + dy BETWEEN 0 AND w - 1 GROUP BY 1, 2)"))
def m5_nearest_bearing(fx: Fixtures) -> DataFrame:
    walked = fx.walked.withColumn("order", F.col("feat") * 1000 + F.col("i"))
    return raster.nearest(walked, 2, fx.size, "dir", "order")


@query(sql("SELECT x, y, CAST(d2 AS BIGINT) AS d2, CAST(s // 1000000 AS BIGINT) AS feat FROM (SELECT c.x, c.y, min(pow(c.x - p.x, 2) + pow(c.y - p.y, 2)) AS d2, arg_min(p.feat * 1000000 + p.i, (pow(c.x - p.x, 2) + pow(c.y - p.y, 2)) * 1000000000 + p.feat * 1000000 + p.i) AS s FROM cells0 c, walk p GROUP BY 1, 2)"))
def m3_m5_nearest_lane(fx: Fixtures) -> DataFrame:
    """Every cell's nearest lane cell, however far, by the exact transform."""
    made = raster.transform(fx.walked.withColumn("order", F.col("feat") * 1_000_000 + F.col("i")), "order", fx.size)
    return made.select("x", "y", "d2", F.expr("order div 1000000").alias("feat"))


@query(sql("SELECT x // 4 AS cx, y // 4 AS cy, bool_or(coalesce(depth <= -30, false)) AND bool_or(NOT land) AS open, bool_or(coalesce(depth <= -30, false)) AS traversable FROM layers GROUP BY 1, 2"))
def m6_m7_block_reduce(fx: Fixtures) -> DataFrame:
    return raster.coarse_open(fx.layers, 4, 30.0).join(raster.coarse_traversable(fx.cells, 4, 30.0).withColumnRenamed("open", "traversable"), ["cx", "cy"])


TRIANGLES = """SELECT seq, x, y FROM (SELECT t.seq, c.x, c.y, sum(CASE WHEN least(y1, y2) <= c.y + 0.5 AND greatest(y1, y2) > c.y + 0.5 AND c.x + 0.5 >= x1 + (c.y + 0.5 - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) AS n
FROM tri t, cells0 c WHERE y1 <> y2 AND c.y BETWEEN by0 - 1 AND by1 + 1 GROUP BY 1, 2, 3) WHERE n % 2 = 1"""
TRIANGLE_EDGES = "SELECT seq, by0, by1, unnest([bx0, bx1, bx0 + 3]) + 0.25 AS x1, unnest([by0, by0 + 5, by1]) + 0.125 AS y1, unnest([bx1, bx0 + 3, bx0]) + 0.25 AS x2, unnest([by0 + 5, by1, by0]) + 0.125 AS y2 FROM basins"


def rings(fx: Fixtures) -> DataFrame:
    p = lambda x, y: F.struct((x + 0.25).cast("double").alias("x"), (y + 0.125).cast("double").alias("y"))
    b = {k: F.col(k) for k in ("bx0", "bx1", "by0", "by1")}
    return fx.basins.select("seq", F.array(p(b["bx0"], b["by0"]), p(b["bx1"], b["by0"] + 5), p(b["bx0"] + 3, b["by1"])).alias("ring"))


@query(sql(TRIANGLES, tri=TRIANGLE_EDGES))
def m8_rasterise_polygon(fx: Fixtures) -> DataFrame:
    return raster.rasterised(raster.polygon_edges(rings(fx), ("seq",), "ring"), ("seq",), fx.size)


_SEG = """SELECT feat, dir, x, y FROM (SELECT f.feat, f.dir, c.x, c.y, x0 + 0.5 AS ax, y0 + 0.5 AS ay, x1 + 0.5 AS ex, y1 + 0.5 AS ey, c.x + 0.5 AS px, c.y + 0.5 AS py,
CASE WHEN pow(x1 - x0, 2) + pow(y1 - y0, 2) > 0 THEN greatest(0.0, least(1.0, ((c.x - x0) * (x1 - x0) + (c.y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) ELSE 0.0 END AS t FROM lane_feat f, cells0 c)
WHERE sqrt(pow(px - (ax + t * (ex - ax)), 2) + pow(py - (ay + t * (ey - ay)), 2)) <= 1.73"""


@query(sql("SELECT x, y, arg_max(dir, feat) AS lane_dir FROM seg GROUP BY x, y", seg=_SEG))
def m9_m10_direction_field(fx: Fixtures) -> DataFrame:
    s = fx.lane_features.select("feat", "dir", *[(F.col(a) + 0.5).alias(b) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x2"), ("y1", "y2"))])
    return raster.direction_field(s, 1.73, fx.size, "feat", "dir")


@query(sql("SELECT 'zone' AS layer, x, y FROM zone UNION ALL SELECT 'boundary', x, y FROM bnd"))
def m11_layer_precedence(fx: Fixtures) -> DataFrame:
    return fx.zone.select(F.lit("zone").alias("layer"), "x", "y").unionByName(fx.boundary.select(F.lit("boundary").alias("layer"), "x", "y"))


_BILINEAR = """SELECT t.x, t.y, sum(c.depth * sh) / sum(sh) AS depth FROM (SELECT x, y, fx + i AS px, fy + j AS py, (CASE WHEN i = 1 THEN sx - 0.5 - fx ELSE 1.5 - sx + fx END) * (CASE WHEN j = 1 THEN sy - 0.5 - fy ELSE 1.5 - sy + fy END) AS sh
FROM (SELECT x, y, 1.5 * x + 1.0 AS sx, 1.5 * y + 1.0 AS sy, floor(1.5 * x + 0.5) AS fx, floor(1.5 * y + 0.5) AS fy FROM cells0, dim WHERE 3 * x < 2 * w - 6 AND 3 * y < 2 * w - 6), (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) t JOIN cells0 c ON c.x = px AND c.y = py WHERE sh > 0 AND c.depth IS NOT NULL GROUP BY 1, 2"""


@query(f"{sql('SELECT x, y, round(depth, 6) AS depth FROM bil', bil=_BILINEAR)}")
def m12_bilinear(fx: Fixtures) -> DataFrame:
    target = fx.cells.filter((3 * F.col("x") < 2 * fx.w - 6) & (3 * F.col("y") < 2 * fx.w - 6)).select("x", "y", (F.col("x") * 1.5 + 1.0).alias("sx"), (F.col("y") * 1.5 + 1.0).alias("sy"))
    return raster.resampled(fx.cells, target, "depth").select("x", "y", F.round("depth", 6).alias("depth"))


@query(sql("SELECT x, y, density FROM density"))
def m13_normalise(fx: Fixtures) -> DataFrame:
    return fx.density


@query(sql(_dilate_sql("walk", 1, "true")))
def m14_thick_line(fx: Fixtures) -> DataFrame:
    return raster.dilated(fx.walked, raster.square(1), fx.size)


@query(sql(_dilate_sql("land", 2, "dx * dx + dy * dy <= 4")))
def m15_disc(fx: Fixtures) -> DataFrame:
    return raster.dilated(fx.land, raster.disc(2), fx.size)




@query(sql("SELECT 'fine' AS level, x, y FROM (" + _dilate_sql("walk", 2, "true") + ") UNION ALL SELECT 'coarse', x, y FROM (" + _dilate_sql("coarse_walk", 1, "true").replace("w - 1", "(w + 3) // 4 - 1") + ")", coarse_walk=walk_sql("(SELECT feat, x0 // 4 AS x0, y0 // 4 AS y0, x1 // 4 AS x1, y1 // 4 AS y1 FROM lane_feat)", "feat")))
def m16_m17_canal_masks(fx: Fixtures) -> DataFrame:
    from ..operators.corridor import canal_cells

    legs = fx.lane_features
    fine, coarse = canal_cells(legs, 2, fx.size, 1), canal_cells(legs, 1, fx.size, 4)
    return fine.select(F.lit("fine").alias("level"), "x", "y").unionByName(coarse.select(F.lit("coarse").alias("level"), "x", "y"))


LINES = "SELECT route_id, x0, y0, x1, y1 FROM requests UNION ALL SELECT route_id + 10000000, x0, y0, least(x0 + 6, w - 1), least(y0 + 3, w - 1) FROM requests, dim"


def _lines(fx: Fixtures) -> DataFrame:
    r = fx.requests
    top = F.lit(fx.w - 1)
    short = r.select((F.col("route_id") + 10_000_000).alias("route_id"), "x0", "y0", F.least(F.col("x0") + 6, top).alias("x1"), F.least(F.col("y0") + 3, top).alias("y1"))
    return r.select("route_id", "x0", "y0", "x1", "y1").unionByName(short)


WALKED = walk_sql("(SELECT route_id, x0, y0, x1, y1 FROM ln)", "route_id")


@query(sql("SELECT route_id, i, x, y FROM lw", ln=LINES, lw=WALKED))
def l1_line_walk(fx: Fixtures) -> DataFrame:
    return once(_lines(fx), LINE, lambda one: lines.walk(spread_out(one, "route_id"), ("route_id",)), repeats=True)


@query(sql("SELECT route_id, NOT bool_or(NOT coalesce(depth <= -10, false) OR coalesce(zone, true)) AS clear FROM lw LEFT JOIN layers c ON c.x = lw.x AND c.y = lw.y GROUP BY route_id", ln=LINES, lw=WALKED))
def l2_line_of_sight(fx: Fixtures) -> DataFrame:
    cells = fx.layers.withColumn("blocked", cl.blocked(F.col("depth"), F.lit(10), F.col("zone")))
    return once(_lines(fx), LINE, lambda one: lines.line_of_sight(one, cells, ("route_id",)))


@query(sql("SELECT route_id, bool_or(coalesce(dist < 2 AND NOT lane, false)) AS close FROM lw LEFT JOIN layers c ON c.x = lw.x AND c.y = lw.y GROUP BY route_id", ln=LINES, lw=WALKED))
def l3_land_clearance(fx: Fixtures) -> DataFrame:
    return once(_lines(fx), LINE, lambda one: lines.too_close_to_land(one, fx.layers, ("route_id",), 2))


CROSSED = "SELECT route_id, bool_or(coalesce(zone <> pz OR (boundary AND NOT pb), false)) AS crosses FROM (SELECT route_id, zone, boundary, lag(zone) OVER p AS pz, lag(boundary) OVER p AS pb FROM lw JOIN layers c ON c.x = lw.x AND c.y = lw.y WINDOW p AS (PARTITION BY route_id ORDER BY i)) GROUP BY route_id"


@query(sql("SELECT route_id, crosses FROM cr", ln=LINES, lw=WALKED, cr=CROSSED))
def l4_boundary_cross(fx: Fixtures) -> DataFrame:
    return once(_lines(fx), LINE, lambda one: lines.crosses_boundary(one, fx.layers, ("route_id",)))


@query(sql("SELECT route_id, bool_or(coalesce(boundary AND i > 0, false)) AS touches FROM lw LEFT JOIN layers c ON c.x = lw.x AND c.y = lw.y GROUP BY route_id", ln=LINES, lw=WALKED))
def l5_boundary_touch(fx: Fixtures) -> DataFrame:
    return once(_lines(fx), LINE, lambda one: lines.touches_boundary(one, fx.layers, ("route_id",)))


ENDS = "SELECT route_id, x0, y0, x1, y1, -20.0 + (x0 + 0.5) * 0.1 AS lon1, 60.0 - (y0 + 0.5) * 0.1 AS lat1, -20.0 + (x1 + 0.5) * 0.1 AS lon2, 60.0 - (y1 + 0.5) * 0.1 AS lat2 FROM ln"
WRONG = f"SELECT e.route_id, coalesce(bool_or(c.lane AND (x0 <> x1 OR y0 <> y1) AND {_angle('bearing', 'c.lane_dir')} > 90), false) AS wrong FROM (SELECT *, {BEARING} AS bearing FROM ends) e JOIN lw ON lw.route_id = e.route_id LEFT JOIN layers c ON c.x = lw.x AND c.y = lw.y GROUP BY e.route_id"


@query(sql("SELECT route_id, wrong FROM wr", ln=LINES, lw=WALKED, ends=ENDS, wr=WRONG))
def l6_wrong_way(fx: Fixtures) -> DataFrame:
    return once(_lines(fx), LINE, lambda one: lines.wrong_way(one, fx.layers, ("route_id",), fx.grid))


_SWAPPED = BEARING.replace("lon1", "LA1").replace("lon2", "LA2").replace("lat1", "lon1").replace("lat2", "lon2").replace("LA1", "lat1").replace("LA2", "lat2")
_BOTH = f"SELECT ends.route_id, {_SWAPPED} AS bearing, a.lane AND b.lane AS both_in FROM ends JOIN layers a ON a.x = x0 AND a.y = y0 JOIN layers b ON b.x = x1 AND b.y = y1"
_CLEAR = f"SELECT lw.route_id, bool_and(coalesce(NOT land AND (lane OR coalesce(dist >= 1.5, true)) AND (NOT both_in OR lane) AND NOT coalesce(both_in AND lane AND lane_dir >= 0 AND {_angle('bearing', 'lane_dir')} > 90, false), false)) AS fine FROM lw JOIN bo ON bo.route_id = lw.route_id LEFT JOIN layers c ON c.x = lw.x AND c.y = lw.y GROUP BY lw.route_id"


@query(sql("SELECT f.route_id, fine AND NOT crosses AND NOT wrong AS clear FROM cle f JOIN cr ON cr.route_id = f.route_id JOIN wr ON wr.route_id = f.route_id", ln=LINES, lw=WALKED, ends=ENDS, cr=CROSSED, wr=WRONG, bo=_BOTH, cle=_CLEAR))
def l7_clear_path(fx: Fixtures) -> DataFrame:
    return once(_lines(fx), LINE, lambda one: lines.clear_straight(one, fx.layers, ("route_id",), fx.grid, 1.5))


@query()
def l8_open_ocean(fx: Fixtures) -> DataFrame:
    g = fx.grid
    (a, b), (c, d) = g.centre(F.col("x0"), F.col("y0")), g.centre(F.col("x1"), F.col("y1"))
    traffic = raster.dilated(fx.lane, raster.square(2), fx.size).unionByName(fx.zone).unionByName(fx.boundary).distinct()
    coast = raster.distance(fx.land, 3, fx.size).select("x", "y", F.sqrt("d2").alias("dist"))
    routes = lambda one: one.select("route_id", a.alias("lon1"), b.alias("lat1"), c.alias("lon2"), d.alias("lat2"))
    return once(_lines(fx), LINE, lambda one: lines.open_ocean(routes(one), ("route_id",), g, traffic, coast))


@query(sql("SELECT lw.route_id, i, coalesce(c.lane, false) AS in_lane FROM lw LEFT JOIN layers c ON c.x = lw.x AND c.y = lw.y", ln=LINES, lw=WALKED))
def l9_lane_status(fx: Fixtures) -> DataFrame:
    told = lambda one: lines.lane_status(lines.walk(spread_out(one, "route_id"), ("route_id",)), fx.layers)
    return once(_lines(fx), LINE, lambda one: told(one).select("route_id", "i", "in_lane"), repeats=True)


@query()
def l11_sample_checks(fx: Fixtures) -> DataFrame:
    buffered = raster.dilated(fx.land, raster.cross(2), fx.size).withColumn("land_buffered", F.lit(True))
    return lines.sample_checks(fx.cells.join(buffered, ["x", "y"], "left"), 10)

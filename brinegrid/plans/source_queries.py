"""Queries of sources and sinks: what they write is read again and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from ..operators import polygons, raster
from ..operators.lineage import shared_dir
from ..sources import bands, files, geojson
from . import cell_queries
from .fixtures import Fixtures, fixtures, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixtures(spark, sf_dir))
        SQL[f.__name__] = text
        return f

    return add


def _folder(fx: Fixtures) -> str:
    """A new name in the shared folder of the session."""
    return f"{shared_dir(fx.spark)}/brinegrid-{uuid.uuid4().hex}"


@query(sql("SELECT x, y, depth FROM cells0 WHERE x BETWEEN 5 AND 24 AND y BETWEEN 3 AND 22"))
def s1_s2_band_window(fx: Fixtures) -> DataFrame:
    path = f"{_folder(fx)}/depth"
    bands.write_band(fx.cells, path)
    return bands.read_band(fx.spark, path, (5, 3, 20, 20)).select("x", "y", "depth")


@query(sql("SELECT 'buffered' AS band, x, y FROM (SELECT DISTINCT l.x + dx AS x, l.y + dy AS y FROM land l, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy), dim WHERE abs(dx) + abs(dy) <= 2 AND l.x + dx BETWEEN 0 AND w - 1 AND l.y + dy BETWEEN 0 AND w - 1)"))
def s5_s18_s19_catalog(fx: Fixtures) -> DataFrame:
    catalog = bands.Catalog(fx.spark, _folder(fx), "0.5nm")
    catalog.once("land", lambda: fx.land)
    catalog.once("land_buffered", lambda: raster.dilated(catalog.land(False), raster.cross(2), fx.size))
    return catalog.land().select(F.lit("buffered").alias("band"), "x", "y")


@query(sql("SELECT feat, 0 AS ring, unnest([0, 1]) AS seq, CAST(unnest([x0, x1]) AS DOUBLE) AS x1, CAST(unnest([y0, y1]) AS DOUBLE) AS y1, CAST(unnest([x1, x0]) AS DOUBLE) AS x2, CAST(unnest([y1, y0 + 1]) AS DOUBLE) AS y2 FROM lane_feat"))
def s11_s20_geojson(fx: Fixtures) -> DataFrame:
    c = {k: F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1")}
    point = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))
    path = F.array(point(c["x0"], c["y0"]), point(c["x1"], c["y1"]), point(c["x0"], c["y0"] + 1))
    lines = fx.lane_features.select(F.col("feat").alias("route_id"), tags.line_feature(path, F.struct("feat")).alias("value"))
    folder = f"{_folder(fx)}/features"
    # one collection for each lane, as files of a feature collection are small
    lines.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "value", F.lit("]}")).alias("value")).repartition(8, "value").write.text(folder)
    table = fx.spark.read.schema(geojson.COLLECTION).json(folder).select(F.explode("features").alias("f"))
    table = table.select(F.col("f.properties")["feat"].cast("long").alias("feature"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))
    return geojson.edges(table).withColumnRenamed("feature", "feat")


@query(sql("SELECT x, y, CASE WHEN x < 9 THEN depth ELSE -1 - x END AS depth FROM cells0 WHERE x < 12"))
def s13_mosaic(fx: Fixtures) -> DataFrame:
    left = fx.cells.filter("x < 9")
    right = fx.cells.filter("x >= 4 and x < 12").withColumn("depth", -1 - F.col("x"))
    return raster.mosaic([left, right])


@query(sql("SELECT x, y, depth FROM cells0"))
def s13_geotiff(fx: Fixtures) -> DataFrame:
    """The depth band as a folder of GeoTIFF tiles, written by the tasks and read back as one raster on the grid."""
    g, folder = fx.grid, f"{_folder(fx)}/tiles"
    files.write_tiffs(fx.cells, "depth", folder, g, side=64).collect()
    files.register(fx.spark)
    return fx.spark.read.format("geotiff").option("value", "depth").option("grid", f"{g.xmin},{g.ymax},{g.dx},{g.dy}").load(folder)


@query(sql(cell_queries.TRIANGLES, tri=cell_queries.TRIANGLE_EDGES))
def s12_shapefile_mask(fx: Fixtures) -> DataFrame:
    """Polygons as shapefiles, read by record ranges and burnt onto the grid."""
    g, folder = fx.grid, f"{_folder(fx)}/shapes"
    lon, lat = (lambda p: g.xmin + p["x"] * g.dx), (lambda p: g.ymax - p["y"] * g.dy)
    closed = F.concat("ring", F.slice("ring", 1, 1))
    files.write_shapes(cell_queries.rings(fx).select(F.col("seq").alias("part"), F.array(F.transform(closed, lambda p: F.struct(lon(p).alias("lon"), lat(p).alias("lat")))).alias("rings")), folder).collect()
    files.register(fx.spark)
    shapes = fx.spark.read.format("shapefile").load(folder).withColumn("seq", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    edges = files.edges_in_cells(shapes, g).join(shapes.select("file", "record", "seq"), ["file", "record"])
    # coordinates in degrees are a rounding away from cells
    edges = edges.select("seq", *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return raster.rasterised(edges, ("seq",), fx.size)


_BASIN_EDGES = """SELECT seq, id, unnest([cx - s, cx + s, cx + s, cx, cx + s - 3, cx + s - 1, cx + s - 1]) + 0.25::DOUBLE AS x1, unnest([cy - s, cy - s, cy + s, cy - s // 2, cy - s + 1, cy - s + 1, cy - s + 4]) + 0.125::DOUBLE AS y1,
unnest([cx + s, cx + s, cx, cx - s, cx + s - 1, cx + s - 1, cx + s - 3]) + 0.25::DOUBLE AS x2, unnest([cy - s, cy + s, cy - s // 2, cy - s, cy - s + 1, cy - s + 4, cy - s + 1]) + 0.125::DOUBLE AS y2
FROM (SELECT n AS seq, n_name AS id, 31 * n % w AS cx, 17 * n % w AS cy, w // 6 + n % 5 AS s FROM (SELECT CAST(n_nationkey AS BIGINT) AS n, n_name FROM nation), dim)"""
_IN_BASIN = """SELECT c.x, c.y, arg_min(id, seq) AS basin FROM (SELECT c.x, c.y, seq, any_value(id) AS id FROM cells0 c JOIN poly ON c.y BETWEEN least(y1, y2) AND greatest(y1, y2) GROUP BY 1, 2, 3
HAVING count(*) FILTER (WHERE (y1 > c.y) <> (y2 > c.y) AND c.x < (x2 - x1) * (c.y - y1) / (y2 - y1) + x1) % 2 = 1
AND NOT bool_or(c.x BETWEEN least(x1, x2) AND greatest(x1, x2) AND (c.x - x1) * (y2 - y1) = (c.y - y1) * (x2 - x1))) c GROUP BY 1, 2"""


@query(sql("SELECT x, y, basin FROM cells0 LEFT JOIN held USING (x, y)", poly=_BASIN_EDGES, held=_IN_BASIN))
def a11_s16_polygon_basins(fx: Fixtures) -> DataFrame:
    """Darts with a hole, a basin for each nation, written as one GeoJSON file and read back; the first in the file holds a cell."""
    n, w = F.col("n_nationkey").cast("long"), fx.w
    cx, cy, s = F.pmod(n * 31, F.lit(w)), F.pmod(n * 17, F.lit(w)), F.lit(w // 6) + n % 5
    half = F.floor(s / 2).cast("long")
    ring = lambda *points: F.array(*[F.array(x + F.lit(0.25), y + F.lit(0.125)) for x, y in points])
    dart = ((cx - s, cy - s), (cx + s, cy - s), (cx + s, cy + s), (cx, cy - half), (cx - s, cy - s))
    hole = ((cx + s - 3, cy - s + 1), (cx + s - 1, cy - s + 1), (cx + s - 1, cy - s + 4), (cx + s - 3, cy - s + 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring(*dart), ring(*hole)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("id")).alias("properties"), geometry.alias("geometry"))
    # a file of basins is one small document: the nations in their order
    listed = fx.table("nation").agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), feature.alias("f")))).alias("l"))
    folder = f"{_folder(fx)}/basins"
    listed.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("l.f").alias("features"))).alias("value")).write.text(folder)
    edges = geojson.basin_edges(fx.spark, folder)
    first = polygons.first_polygon(fx.cells.select("x", "y"), edges, ("x", "y"), 8.0)
    return first.join(F.broadcast(edges.select("seq", F.col("id").alias("basin")).distinct()), "seq", "left").select("x", "y", "basin")

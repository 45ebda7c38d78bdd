"""GeoJSON features as tables, read by Spark, and paths as GeoJSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import line_feature

COLLECTION = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
RING = "array<array<double>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(feature, properties, kind, coordinates): coordinates are JSON text, as their depth differs by kind."""
    rows = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
    out = rows.select(F.posexplode("features").alias("feature", "f"))
    return out.select("feature", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def _rings(kind: Column, coordinates: Column) -> Column:
    """All rings or lines of a geometry, one list."""
    parse = lambda shape: F.from_json(coordinates, shape)
    return (
        F.when(kind == "LineString", F.array(parse(RING)))
        .when(kind.isin("Polygon", "MultiLineString"), parse(f"array<{RING}>"))
        .when(kind == "MultiPolygon", F.flatten(parse(f"array<array<{RING}>>")))
    )


def edges(table: DataFrame) -> DataFrame:
    """(feature, ring, seq, x1, y1, x2, y2): the edges of every ring or line, in degrees."""
    rings = table.select("feature", F.posexplode(_rings(F.col("kind"), F.col("coordinates"))).alias("ring", "r"))
    pairs = F.expr("transform(sequence(0, size(r) - 2), i -> struct(r[i][0] as x1, r[i][1] as y1, r[i + 1][0] as x2, r[i + 1][1] as y2))")
    return rings.filter(F.size("r") > 1).select("feature", "ring", F.posexplode(pairs).alias("seq", "e")).select("feature", "ring", "seq", "e.*")


def basins(spark: SparkSession, path: str) -> DataFrame:
    """(seq, id, kind, coordinates): basin polygons in file order; each needs an id."""
    table = features(spark, path).select(F.col("feature").alias("seq"), F.col("properties")["id"].alias("id"), "kind", "coordinates")
    missing = table.filter("id is null").limit(1).count()
    if missing:
        raise ValueError("every basin needs the property id")
    return table


def basin_edges(spark: SparkSession, path: str) -> DataFrame:
    """(seq, id, x1, y1, x2, y2): the edges of the basins of a file, in file order, for `polygons.first_polygon`."""
    table = basins(spark, path)
    found = edges(table.withColumnRenamed("seq", "feature")).select(F.col("feature").alias("seq"), "x1", "y1", "x2", "y2")
    return found.join(table.select("seq", "id"), "seq").select("seq", "id", "x1", "y1", "x2", "y2")


def write_paths(paths: DataFrame, path: str) -> None:
    """Paths (route_id, path array of (lon, lat)) as one GeoJSON feature a line."""
    paths.select(line_feature(F.col("path"), F.struct("route_id")).alias("value")).write.text(path)


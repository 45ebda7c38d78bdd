"""Tags of sea-mark features, requests' coordinates and GeoJSON output, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sea-mark types of each class of feature.
LANE_TYPES = ("separation_lane",)
ZONE_TYPES = ("separation_zone",)
BOUNDARY_TYPES = ("separation_boundary", "separation_line", "inshore_traffic_zone")


def tag(other_tags: Column, key: str) -> Column:
    """A value of hstore text `"key"=>"value"`, null if absent."""
    return F.nullif(F.regexp_extract(other_tags, f'"{key}"=>"([^"]+)"', 1), F.lit(""))


def seamark_type(parsed: Column | None, other_tags: Column) -> Column:
    """From the parsed tags if they are there, else from the text."""
    own = F.get_json_object(parsed, "$['seamark:type']") if parsed is not None else F.lit(None)
    return F.coalesce(own, tag(other_tags, "seamark:type"))


def flow_bearing(raw: Column) -> Column:
    return raw.try_cast("double")


def is_precautionary(information: Column, other_tags: Column) -> Column:
    return F.coalesce(information == "precautionary_area", F.lit(False)) | F.coalesce(F.contains(other_tags, F.lit("precautionary_area")), F.lit(False))


def feature_class(kind: Column, precautionary: Column) -> Column:
    """lane, zone or boundary, null for others; precautionary areas are no boundaries."""
    return F.when(kind.isin(*LANE_TYPES), "lane").when(kind.isin(*ZONE_TYPES), "zone").when(kind.isin(*BOUNDARY_TYPES) & ~precautionary, "boundary")


def lon_lat(text: Column) -> tuple[Column, Column]:
    """A "lon,lat" argument as two numbers."""
    parts = F.split(text, ",")
    return F.get(parts, F.lit(0)).cast("double"), F.get(parts, F.lit(1)).cast("double")


def line_feature(path: Column, properties: Column) -> Column:
    """GeoJSON text of a path, an array of (lon, lat) structs."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform(path, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), line.alias("geometry")))


def flipped(path: Column) -> Column:
    """(lon, lat) points as (lat, lon)."""
    return F.transform(path, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))

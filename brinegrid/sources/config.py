"""Configuration: router settings, vessel profiles, canals and passages from YAML files."""

from __future__ import annotations

from functools import lru_cache

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import Settings

POINT = "struct<lon: double, lat: double>"
#: Where the settings stand in the file: section, key, setting ("" where the router has no use for a key that the file ships).
KEYS = (
    ("algorithm", "default", "algorithm"),
    ("algorithm", "coarse_to_fine_threshold_nm", "coarse_threshold_nm"),
    ("algorithm", "coarse_scale", "coarse_scale"),
    ("algorithm", "heuristic_weight", "heuristic"),
    ("corridor", "width_short_nm", "width_nm"),
    ("corridor", "width_long_nm", "width_long_nm"),
    ("corridor", "long_route_threshold_nm", "long_route_nm"),
    ("corridor", "offshore_buffer_nm", ""),
    ("corridor", "chokepoint_buffer_nm", ""),
    ("corridor", "min_width_nm", ""),
    ("tss", "wrong_way_penalty", "wrong_way"),
    ("tss", "alignment_weight", "alignment"),
    ("tss", "off_lane_penalty", "off_lane"),
    ("tss", "lane_crossing_penalty", "lane_crossing"),
    ("tss", "sepzone_crossing_penalty", "zone_crossing"),
    ("tss", "sepboundary_crossing_penalty", "boundary_crossing"),
    ("tss", "proximity_check_radius", "near_radius"),
    ("tss", "max_lane_deviation_deg", "max_deviation"),
    ("tss", "snap_corridor_enabled", "snap"),
    ("tss", "snap_corridor_radius_nm", "snap_nm"),
    ("land", "min_distance_nm", "least_land_nm"),
    ("land", "proximity_penalty", "land_weight"),
    ("land", "max_distance_cells", "land_reach"),
    ("depth", "near_shore_penalty", "depth_weight"),
    ("simplify", "tolerance_nm", ""),
    ("simplify", "max_simplify_nm", "max_simplify_nm"),
    ("simplify", "max_skip", "max_skip"),
    ("simplify", "min_land_distance_cells_default", ""),
    ("simplify", "min_land_distance_cells_tss", ""),
    ("bypass", "offset_distances_nm", "bypass_offsets_nm"),
    ("routing", "allow_diagonals", ""),
    ("routing", "max_turn_deg", ""),
    ("routing", "density_bias", ""),
)


def _load(path: str) -> dict:
    try:
        with open(path) as f:
            return yaml.safe_load(f) or {}
    except FileNotFoundError:
        return {}


@lru_cache(maxsize=16)
def settings(path: str) -> Settings:
    """The file's settings over the defaults; a missing file gives the defaults, an unknown section or key is refused.

    Kept for the process: `settings.cache_clear()` reloads.
    """
    tree = {section: part or {} for section, part in _load(path).items()}
    known = {(section, key) for section, key, _ in KEYS}
    if unknown := sorted(f"{section}.{key}" for section, part in tree.items() for key in part if (section, key) not in known) + sorted(set(tree) - {s for s, _ in known}):
        raise ValueError(f"{path} has settings that are not known: {', '.join(unknown)}")
    given = {name: tree[section][key] for section, key, name in KEYS if name and key in tree.get(section, {})}
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Vessel profiles (profile, draft_m, safety_margin_m, tss_bias, density_bias)."""
    rows = [(k, *(float(v[c]) if c in v else None for c in ("draft_m", "safety_margin_m", "tss_bias", "density_bias"))) for k, v in _load(path).get("profiles", {}).items()]
    return spark.createDataFrame(rows, "profile string, draft_m double, safety_margin_m double, tss_bias double, density_bias double")


def canals(spark: SparkSession, path: str) -> DataFrame:
    """Canals (id, name, width_nm, waypoints); those of under two waypoints are dropped, a missing width is 2 nm."""
    rows = [(c["id"], c.get("name"), float(c.get("width_nm", 2.0)), [(float(x), float(y)) for x, y in c.get("waypoints", [])]) for c in _load(path).get("canals", [])]
    return spark.createDataFrame(rows, f"id string, name string, width_nm double, waypoints array<{POINT}>").filter(F.size("waypoints") >= 2)


def passages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the directed passage graph."""
    tree = _load(path)
    nodes = [(n["id"], n.get("name"), n.get("type")) for n in tree.get("nodes", [])]
    edges = [(e["from"], e["to"], float(e["weight_nm"]), [(float(x), float(y)) for x, y in e.get("waypoints", [])]) for e in tree.get("edges", [])]
    return spark.createDataFrame(nodes, "id string, name string, type string"), spark.createDataFrame(edges, f"src string, dst string, weight_nm double, waypoints array<{POINT}>")


def legs(canals: DataFrame) -> DataFrame:
    """(id, width_nm, seq, lon1, lat1, lon2, lat2): the straight legs of canals."""
    pairs = F.expr("transform(sequence(0, size(waypoints) - 2), i -> struct(waypoints[i] as a, waypoints[i + 1] as b))")
    out = canals.select("id", "width_nm", F.posexplode(pairs).alias("seq", "p"))
    return out.select("id", "width_nm", "seq", F.col("p.a.lon").alias("lon1"), F.col("p.a.lat").alias("lat1"), F.col("p.b.lon").alias("lon2"), F.col("p.b.lat").alias("lat2"))

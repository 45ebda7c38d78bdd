"""Geodesy as column expressions: points are (lon, lat) in degrees, distances nautical miles, bearings degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
NM_PER_DEGREE = 60.0
#: Neighbour moves in search order: north, then clockwise (y counts from the north).
MOVES = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))
#: Length factor of a diagonal move.
DIAGONAL = 1.414


def planar_distance_nm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance with the cosine of the middle latitude; longitudes do not wrap."""
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return NM_PER_DEGREE * F.sqrt((lat2 - lat1) * (lat2 - lat1) + east * east)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing, 0 up to 360."""
    turn = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    x = F.sin(turn) * F.cos(b)
    y = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def angle_between_deg(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def wrap_lon(lon: Column) -> Column:
    """One turn at most."""
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def clamp_lat(lat: Column) -> Column:
    return F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH_RADIUS_M, F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * EARTH_RADIUS_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_RADIUS_M), 2 * F.degrees(F.atan(F.exp(y / EARTH_RADIUS_M))) - 90


def rhumb_point(lon1: Column, lat1: Column, lon2: Column, lat2: Column, share: Column) -> tuple[Column, Column]:
    """The point at `share` of the way, on a straight line in Mercator space."""
    (x1, y1), (x2, y2) = mercator(lon1, lat1), mercator(lon2, lat2)
    return from_mercator(x1 + (x2 - x1) * share, y1 + (y2 - y1) * share)


def straight_point(lon1: Column, lat1: Column, lon2: Column, lat2: Column, share: Column) -> tuple[Column, Column]:
    return lon1 + (lon2 - lon1) * share, lat1 + (lat2 - lat1) * share


def degree_move_nm(dx_deg: Column, dy_deg: Column, lat: Column) -> Column:
    """Cost of a move given in degrees: the hypotenuse if it goes both ways, else the sum."""
    east, north = F.abs(dx_deg) * NM_PER_DEGREE * F.cos(F.radians(lat)), F.abs(dy_deg) * NM_PER_DEGREE
    return F.when((dx_deg != 0) & (dy_deg != 0), F.sqrt(east * east + north * north)).otherwise(east + north)


def step_nm(lat: Column, dx_nm: float, dy_nm: float, diagonal: Column) -> Column:
    """Cost of a move to a neighbour cell: one value for straight moves at a latitude, 1.414 times that for diagonals."""
    east = dx_nm * F.cos(F.radians(lat))
    return F.when(diagonal, F.lit(DIAGONAL)).otherwise(1.0) * F.sqrt(east * east + dy_nm * dy_nm) / F.sqrt(F.lit(2.0))


def coarse_step_nm(lat: Column, dx_deg: float, dy_deg: float, scale: int, diagonal: Column) -> Column:
    east = dx_deg * NM_PER_DEGREE * F.cos(F.radians(lat))
    return F.when(diagonal, F.lit(DIAGONAL)).otherwise(1.0) * scale * F.sqrt(east * east + (dy_deg * NM_PER_DEGREE) ** 2) / 1.414


def move_bearing_deg(dx: Column, dy: Column) -> Column:
    """Bearing of a move between cells, y counted from the north; latitude plays no part."""
    return F.pmod(F.degrees(F.atan2(dx.cast("double"), -dy.cast("double"))) + 360, F.lit(360.0))


def goal_bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(east, lat2 - lat1)) + 360, F.lit(360.0))


def cross_track_nm(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance to a segment; every point is scaled by the cosine of its own latitude."""
    flat = lambda a, b: (a * NM_PER_DEGREE * F.cos(F.radians(b)), b * NM_PER_DEGREE)
    (px, py), (ax, ay), (bx, by) = flat(lon, lat), flat(lon1, lat1), flat(lon2, lat2)
    return segment_distance(px, py, ax, ay, bx, by)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance of a point to a segment."""
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    share = F.when(length > 0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.when(length > 0, length)).otherwise(F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    x, y = px - (ax + share * (bx - ax)), py - (ay + share * (by - ay))
    return F.sqrt(x * x + y * y)


def radius_cells(width_nm: Column, cell_nm: Column) -> Column:
    """Half a width in cells, at least one; halves round to even."""
    return F.when(cell_nm <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.bround(width_nm / cell_nm / 2).cast("int")))


def nm_to_deg(nm: Column) -> Column:
    return nm / NM_PER_DEGREE

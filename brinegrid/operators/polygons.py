"""Points in polygons by an index of tiles.

A polygon is a table of the edges of all its rings (seq, x1, y1, x2, y2), and a point is inside where a ray crosses an odd
number of them. A tile that no edge of a polygon meets lies inside or outside as its middle does, so points there need no edge;
in the other tiles a point is held against the edges of its row of tiles. Points on an edge are not inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import bounded, cut, spread_out

#: Share of a tile by which edges are widened, so that rounding cannot take a tile from an edge.
WIDER = 1e-9


def _tile(value: Column, side: float) -> Column:
    return F.floor(value / F.lit(side)).cast("long")


def _crossing(y: Column) -> Column:
    """Where an edge meets the horizontal line at y."""
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")


def _straddles(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def edges_by_row(edges: DataFrame, side: float) -> DataFrame:
    """Edges (seq, x1, y1, x2, y2) once for each row `ty` of tiles that they meet."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    return spread_out(edges.select("seq", "x1", "y1", "x2", "y2"), "seq", "x1", "y1").withColumn("ty", F.explode(F.sequence(_tile(low, side), _tile(high, side))))


def tile_index(edges: DataFrame, side: float) -> DataFrame:
    """(seq, tx, ty, full): the tiles of `side` by `side` that a polygon's edges meet (full false) and those that it covers (full true)."""
    rows = edges_by_row(edges, side)
    foot, head = F.col("ty") * F.lit(side), (F.col("ty") + 1) * F.lit(side)
    at = lambda y: F.when(F.col("y1") == F.col("y2"), None).otherwise(_crossing(F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2"))))
    a, b = F.coalesce(at(foot), F.col("x1")), F.coalesce(at(head), F.col("x2"))
    first, last = _tile(F.least(a, b) - side * WIDER, side), _tile(F.greatest(a, b) + side * WIDER, side)
    met = rows.select("seq", "ty", F.explode(F.sequence(first, last)).alias("tx")).distinct()
    middle = (F.col("ty") + 0.5) * F.lit(side)
    xs = rows.filter(_straddles(middle)).groupBy("seq", "ty").agg(F.sort_array(F.collect_list(_crossing(middle))).alias("xs"))
    # between an odd crossing and the next one lie the middles of the tiles that are inside
    spans = xs.select("seq", "ty", F.explode(F.expr("transform(sequence(0, size(xs) div 2 - 1), k -> struct(xs[2 * k] as a, xs[2 * k + 1] as b))")).alias("s"))
    low, high = F.ceil(F.col("s.a") / F.lit(side) - 0.5).cast("long"), F.floor(F.col("s.b") / F.lit(side) - 0.5).cast("long")
    covered = spans.filter(low <= high).select("seq", "ty", F.explode(F.sequence(low, high)).alias("tx"))
    covered = covered.join(met, ["seq", "tx", "ty"], "left_anti")
    return met.select("seq", "tx", "ty", F.lit(False).alias("full")).unionByName(covered.select("seq", "tx", "ty", F.lit(True).alias("full")))


def inside(points: DataFrame, edges: DataFrame, keys: tuple[str, ...], side: float = 1.0) -> DataFrame:
    """(keys, seq): the polygons that hold each point (keys, x, y); keys are distinct.

    Index and edges are broadcast while they are small (`lineage.bounded`). Tiles of a size such that most points lie in full
    ones or in none are best: one degree for basins.
    """
    index, rows = cut(tile_index(edges, side)), cut(edges_by_row(edges, side))
    placed = points.select(*keys, "x", "y", _tile(F.col("x"), side).alias("tx"), _tile(F.col("y"), side).alias("ty"))
    met = placed.join(bounded(index), ["tx", "ty"])
    tested = met.filter("not full").join(bounded(rows), ["seq", "ty"])
    x, y = F.col("x"), F.col("y")
    within = x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    on = within & ((x - F.col("x1")) * (F.col("y2") - F.col("y1")) == (y - F.col("y1")) * (F.col("x2") - F.col("x1")))
    crosses = F.when(_straddles(y), x < _crossing(y)).otherwise(False)
    told = tested.groupBy(*keys, "seq").agg((F.count_if(crosses) % 2).alias("odd"), F.bool_or(on).alias("on"))
    return met.filter("full").select(*keys, "seq").unionByName(told.filter("odd = 1 and not on").select(*keys, "seq"))


def first_polygon(points: DataFrame, edges: DataFrame, keys: tuple[str, ...], side: float = 1.0) -> DataFrame:
    """(keys, seq): the first polygon, by seq, that holds each point (keys, x, y), else null; points without a place are in none."""
    found = inside(points, edges, keys, side).groupBy(*keys).agg(F.min("seq").alias("seq"))
    return points.select(*keys).join(found, list(keys), "left")

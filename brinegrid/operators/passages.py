"""The passage graph and the basins: macro routes, their waypoints, the basin of a point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def macro_routes(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, weight_nm, path) of the lightest directed route from each start to each node that it reaches.

    Ties go to the path that is smaller as a list. The graph is a curated one; a round costs a join on its edges.
    """
    best = starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("double").alias("weight_nm"), F.array("node").alias("path"))
    fresh = best
    while True:
        went = fresh.join(edges.select(F.col("src").alias("node"), "dst", F.col("weight_nm").alias("w")), "node").filter(~F.array_contains("path", F.col("dst")))
        went = went.select("start", F.col("dst").alias("node"), (F.col("weight_nm") + F.col("w")).alias("weight_nm"), F.array_append("path", F.col("dst")).alias("path"))
        least = went.groupBy("start", "node").agg(F.min(F.struct("weight_nm", "path")).alias("b")).select("start", "node", "b.*")
        old = best.select("start", "node", F.struct("weight_nm", "path").alias("old"))
        fresh = cut(least.join(old, ["start", "node"], "left").filter(F.col("old").isNull() | (F.struct("weight_nm", "path") < F.col("old"))).drop("old"))
        if fresh.isEmpty():
            return best
        best = cut(best.join(fresh, ["start", "node"], "left_anti").unionByName(fresh))


def corridor_waypoints(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node, waypoints): the waypoints of a route's edges, end to end."""
    pairs = F.expr("transform(sequence(0, size(path) - 2), i -> struct(path[i] as src, path[i + 1] as dst))")
    legs = routes.filter(F.size("path") > 1).select("start", "node", F.posexplode(pairs).alias("i", "e")).select("start", "node", "i", "e.src", "e.dst")
    met = legs.join(edges.select("src", "dst", "waypoints"), ["src", "dst"])
    listed = met.groupBy("start", "node").agg(F.sort_array(F.collect_list(F.struct("i", "waypoints"))).alias("l"))
    return listed.select("start", "node", F.flatten("l.waypoints").alias("waypoints"))


def basin_of(points: DataFrame, boxes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, basin): the first rectangle in order (seq, id, bx0, bx1, by0, by1) that strictly holds the point (x, y), else null.

    Rectangles are a curated list of a few; the join is a range join against them.
    """
    inside = (F.col("x") > F.col("bx0")) & (F.col("x") < F.col("bx1")) & (F.col("y") > F.col("by0")) & (F.col("y") < F.col("by1"))
    met = points.join(boxes, inside, "left")
    return met.groupBy(*keys).agg(F.min_by("id", "seq").alias("basin"))

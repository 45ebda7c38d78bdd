"""Rasters, lines, routes and graphs derived from the driver's tables (FIXTURES.md), as DataFrames and as SQL.

The grid's side w is the root of the number of orders, one row that the driver reads; it becomes a literal in every plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..operators import lines, raster
from ..operators.lineage import cut, unsized
from ..settings import Settings
from .layers import layers


@dataclass(frozen=True)
class Fixtures:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def w(self) -> int:
        return int(self.table("orders").count() ** 0.5)

    @property
    def size(self) -> tuple[int, int]:
        return self.w, self.w

    @property
    def grid(self) -> Grid:
        """A grid of tenths of degrees from (-20, 60)."""
        return Grid("EPSG:4326", 0.1, 0.1, -20.0, 60.0, self.w, self.w)

    @property
    def cells(self) -> DataFrame:
        k, w = F.col("o_orderkey").cast("long"), F.lit(self.w).cast("long")
        depth = F.when(k % 97 != 0, -F.floor(F.col("o_totalprice") / 2500).cast("long"))
        return self.table("orders").filter(k < self.w * self.w).select((k % w).alias("x"), F.expr(f"cast(o_orderkey as bigint) div {self.w}").alias("y"), depth.alias("depth"))

    @property
    def land(self) -> DataFrame:
        s = self.table("supplier").select(F.col("s_suppkey").cast("long").alias("k"), (1 + F.col("s_nationkey") % 3).cast("long").alias("r"))
        blobs = s.select((F.col("k") * 7919 % self.w).alias("x"), (F.col("k") * 104729 % self.w).alias("y"), "r")
        near = raster.spread(blobs, raster.disc(3), self.size).filter("d2 <= r * r").select("x", "y").distinct()
        return unsized(near.join(self.cells, ["x", "y"], "left_semi"))

    @property
    def lane_features(self) -> DataFrame:
        n = F.col("n_nationkey").cast("long")
        at = lambda a, b: F.pmod(n * a + b, F.lit(self.w).cast("long"))
        return self.table("nation").select(n.alias("feat"), at(31, 0).alias("x0"), at(17, 0).alias("y0"), at(53, 11).alias("x1"), at(29, 7).alias("y1"), (n % 8 * 45).alias("dir"))

    @property
    def walked(self) -> DataFrame:
        return lines.walk(self.lane_features, ("feat", "dir"))

    @property
    def lane(self) -> DataFrame:
        return self.walked.groupBy("x", "y").agg(F.max_by("dir", "feat").alias("lane_dir"))

    def _shifted(self, by: int) -> DataFrame:
        return self.walked.select("x", (F.col("y") + by).alias("y")).filter(F.col("y") < self.w).distinct()

    @property
    def zone(self) -> DataFrame:
        return raster.layered(self.lane, self._shifted(2), self._shifted(4))[0]

    @property
    def boundary(self) -> DataFrame:
        return raster.layered(self.lane, self._shifted(2), self._shifted(4))[1]

    @property
    def density(self) -> DataFrame:
        e, w = F.col("event_id").cast("long"), F.lit(self.w).cast("long")
        sums = self.table("events").groupBy((e * 37 % w).alias("x"), ((F.col("user_id").cast("long") * 53 + e * 7) % w).alias("y")).agg(F.sum("value").alias("density"))
        return raster.normalised(sums, "density").withColumn("density", F.round("density", 6))

    @property
    def requests(self) -> DataFrame:
        """A route request of every customer."""
        c, w = F.col("c_custkey").cast("long"), F.lit(self.w).cast("long")
        draft = (5 + F.col("c_nationkey") % 10).cast("long")
        at = lambda a, b: (c * a + b) % w
        return self.table("customer").select(c.alias("route_id"), at(13, 0).alias("x0"), at(29, 0).alias("y0"), at(41, 5).alias("x1"), at(59, 9).alias("y1"), draft.alias("draft"))

    @property
    def track(self) -> DataFrame:
        e = F.col("event_id").cast("long")
        seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
        return self.table("events").select(F.col("user_id").cast("long").alias("route_id"), seq.alias("seq"), (e * 37 % 3600 / 10 - 180).alias("lon"), (e * 53 % 1400 / 10 - 70).alias("lat"))

    @property
    def basins(self) -> DataFrame:
        r = F.col("r_regionkey").cast("long")
        x0, y0 = F.expr(f"cast(r_regionkey as bigint) * {self.w} div 8"), F.expr(f"cast(r_regionkey as bigint) * {self.w} div 10")
        return self.table("region").select(r.alias("seq"), F.col("r_name").alias("id"), x0.alias("bx0"), (x0 + self.w // 3).alias("bx1"), y0.alias("by0"), (y0 + self.w // 2).alias("by1"))

    @property
    def passages(self) -> DataFrame:
        n = F.col("n_nationkey").cast("long")
        pair = lambda a, b, c: F.struct(n.alias("src"), a.alias("dst"), b.alias("weight_nm"), c.alias("kind"))
        both = F.array(pair((n * 7 + 3) % 25, 100 + n * 37 % 900, F.lit(0)), pair((n + 1) % 25, 200 + n * 91 % 700, F.lit(1)))
        return self.table("nation").select(F.explode(both).alias("e")).select("e.src", "e.dst", "e.weight_nm").groupBy("src", "dst").agg(F.min("weight_nm").alias("weight_nm"))

    @property
    def features(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, ("separation_lane", "separation_zone", "separation_boundary", "inshore_traffic_zone"))), (F.col("p_size") % 4 + 1).cast("int"))
        extra = F.when(F.col("p_partkey") % 7 == 0, ',"seamark:information"=>"precautionary_area"').otherwise("")
        text = F.concat(F.lit('"name"=>"'), "p_name", F.lit('","seamark:type"=>"'), kind, F.lit('"'), extra)
        return self.table("part").select(F.col("p_partkey").cast("long").alias("feat"), text.alias("other_tags"))

    @cached_property
    def layers(self) -> DataFrame:
        """All bands of every cell: depth, land, dist (to land, up to 6), lane, lane_dir, zone, boundary; computed once."""
        return cut(layers(self.cells, self.land, self.grid, Settings(), self.lane, self.zone, self.boundary))


_made: dict[tuple[str, str], Fixtures] = {}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    """The fixtures of some tables, one for each Spark application, so that all queries share the checkpointed layers."""
    return _made.setdefault((spark.sparkContext.applicationId, sf_dir), Fixtures(spark, sf_dir))


def walk_sql(source: str, keys: str) -> str:
    """The line walk over a table expression with x0, y0, x1, y1."""
    return f"""SELECT {keys}, i, CAST(CASE WHEN abs(dx) >= abs(dy) THEN x0 + sign(dx) * i ELSE x0 + sign(dx) * off END AS BIGINT) AS x,
CAST(CASE WHEN abs(dx) >= abs(dy) THEN y0 + sign(dy) * off ELSE y0 + sign(dy) * i END AS BIGINT) AS y
FROM (SELECT *, CASE WHEN most = 0 THEN 0 ELSE (2 * i * least_d + most - 1) // (2 * most) END AS off
FROM (SELECT *, unnest(range(most + 1)) AS i FROM (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, greatest(abs(x1 - x0), abs(y1 - y0)) AS most, least(abs(x1 - x0), abs(y1 - y0)) AS least_d FROM {source})))"""


_SQL = {
    "dim": "SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM orders",
    "cells0": "SELECT k % w AS x, k // w AS y, CASE WHEN k % 97 <> 0 THEN -CAST(floor(o_totalprice / 2500) AS BIGINT) END AS depth FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, o_totalprice FROM orders), dim WHERE k < w * w",
    "land": "SELECT DISTINCT c.x, c.y FROM cells0 c, dim, (SELECT CAST(s_suppkey AS BIGINT) AS k, 1 + s_nationkey % 3 AS r FROM supplier) s WHERE (c.x - k * 7919 % w) * (c.x - k * 7919 % w) + (c.y - k * 104729 % w) * (c.y - k * 104729 % w) <= r * r",
    "lane_feat": "SELECT n AS feat, 31 * n % w AS x0, 17 * n % w AS y0, (53 * n + 11) % w AS x1, (29 * n + 7) % w AS y1, 45 * (n % 8) AS dir FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation), dim",
    "walk": walk_sql("lane_feat", "feat, dir"),
    "lane": "SELECT x, y, arg_max(dir, feat) AS lane_dir FROM walk GROUP BY x, y",
    "zone": "SELECT DISTINCT x, y + 2 AS y FROM walk, dim WHERE y + 2 < w EXCEPT SELECT x, y FROM lane",
    "bnd": "SELECT DISTINCT x, y + 4 AS y FROM walk, dim WHERE y + 4 < w EXCEPT SELECT x, y FROM lane EXCEPT SELECT DISTINCT x, y + 2 FROM walk",
    "density": "SELECT x, y, round(s / max(s) OVER (), 6) AS density FROM (SELECT CAST(37 * event_id % w AS BIGINT) AS x, CAST((53 * user_id + 7 * event_id) % w AS BIGINT) AS y, sum(value) AS s FROM events, dim GROUP BY 1, 2)",
    "requests": "SELECT c AS route_id, 13 * c % w AS x0, 29 * c % w AS y0, (41 * c + 5) % w AS x1, (59 * c + 9) % w AS y1, draft FROM (SELECT CAST(c_custkey AS BIGINT) AS c, CAST(5 + c_nationkey % 10 AS BIGINT) AS draft FROM customer), dim",
    "track": "SELECT CAST(user_id AS BIGINT) AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (37 * e % 3600) / 10 - 180 AS lon, (53 * e % 1400) / 10 - 70 AS lat FROM (SELECT *, CAST(event_id AS BIGINT) AS e FROM events)",
    "basins": "SELECT r AS seq, r_name AS id, r * w // 8 AS bx0, r * w // 8 + w // 3 AS bx1, r * w // 10 AS by0, r * w // 10 + w // 2 AS by1 FROM (SELECT CAST(r_regionkey AS BIGINT) AS r, r_name FROM region), dim",
    "edges": "SELECT src, dst, min(weight_nm) AS weight_nm FROM (SELECT n AS src, (7 * n + 3) % 25 AS dst, 100 + 37 * n % 900 AS weight_nm FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) UNION ALL SELECT n, (n + 1) % 25, 200 + 91 * n % 700 FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation)) GROUP BY 1, 2",
    "tags": """SELECT CAST(p_partkey AS BIGINT) AS feat, '"name"=>"' || p_name || '","seamark:type"=>"' || CASE p_size % 4 WHEN 0 THEN 'separation_lane' WHEN 1 THEN 'separation_zone' WHEN 2 THEN 'separation_boundary' ELSE 'inshore_traffic_zone' END || '"' || CASE WHEN p_partkey % 7 = 0 THEN ',"seamark:information"=>"precautionary_area"' ELSE '' END AS other_tags FROM part""",
    "edt": "SELECT l.x + dx AS x, l.y + dy AS y, min(dx * dx + dy * dy) AS d2 FROM land l, (SELECT unnest(range(-6, 7)) AS dx) a, (SELECT unnest(range(-6, 7)) AS dy) b, dim WHERE dx * dx + dy * dy <= 36 AND l.x + dx BETWEEN 0 AND w - 1 AND l.y + dy BETWEEN 0 AND w - 1 GROUP BY 1, 2",
    "layers": "SELECT c.x, c.y, depth, l.x IS NOT NULL AS land, sqrt(e.d2) AS dist, n.x IS NOT NULL AS lane, n.lane_dir, z.x IS NOT NULL AS zone, b.x IS NOT NULL AS boundary FROM cells0 c LEFT JOIN land l ON l.x = c.x AND l.y = c.y LEFT JOIN edt e ON e.x = c.x AND e.y = c.y LEFT JOIN lane n ON n.x = c.x AND n.y = c.y LEFT JOIN zone z ON z.x = c.x AND z.y = c.y LEFT JOIN bnd b ON b.x = c.x AND b.y = c.y",
}


def sql(select: str, recursive: bool = False, **own: str) -> str:
    """`select` after the fixtures' definitions and the query's own."""
    defined = ", ".join(f"{k} AS ({v})" for k, v in (_SQL | own).items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{defined} {select}"

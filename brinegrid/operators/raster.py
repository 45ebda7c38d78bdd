"""Raster operators: a raster is a table of cells (x, y, ...), a neighbourhood an offset join from its sparse side.

`size` is (width, height) of the grid; offsets beyond it are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import segment_distance
from .lineage import unsized


def spread(cells: DataFrame, offsets: Iterable[tuple[int, int]], size: tuple[int, int]) -> DataFrame:
    """Every cell moved by every offset: the cell's columns, x and y where it lands, and d2, the squared distance.

    Offsets are a literal array, so this is a generator on the side of the given cells, not a join.
    """
    moves = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in offsets])
    moved = cells.withColumn("move", F.explode(moves))
    moved = moved.withColumns({"x": F.col("x") + F.col("move.dx"), "y": F.col("y") + F.col("move.dy"), "d2": F.col("move.dx") * F.col("move.dx") + F.col("move.dy") * F.col("move.dy")})
    return unsized(moved.drop("move").filter(F.col("x").between(0, size[0] - 1) & F.col("y").between(0, size[1] - 1)))


def cross(n: int) -> list[tuple[int, int]]:
    """n rounds of the four neighbours."""
    return [(dx, dy) for dx in range(-n, n + 1) for dy in range(-n, n + 1) if abs(dx) + abs(dy) <= n]


def square(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]


def disc(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx, dy in square(r) if dx * dx + dy * dy <= r * r]


def dilated(cells: DataFrame, offsets: Iterable[tuple[int, int]], size: tuple[int, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """The cells within `offsets` of a cell (of the same `keys`)."""
    return spread(cells.select(*keys, "x", "y"), offsets, size).select(*keys, "x", "y").distinct()


#: Side of a tile of the bounded transform, in cells; a task holds one tile with its halo.
TILE = 128
#: Up to this reach a disc is a few offsets, and spreading sources as rows is the cheaper way.
FEW = 2


def distance(sources: DataFrame, reach: int, size: tuple[int, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Bounded Euclidean distance transform: squared distance d2 of every cell within `reach` of a source."""
    if reach <= FEW:
        return spread(sources.select(*keys, "x", "y"), disc(reach), size).groupBy(*keys, "x", "y").agg(F.min("d2").alias("d2"))
    return _tiled(sources.select(*keys, "x", "y", F.lit(0).alias("order")), reach, size, keys, ()).select(*keys, "x", "y", "d2")


def nearest(sources: DataFrame, reach: int, size: tuple[int, int], value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """As `distance`, with `value` of the nearest source; ties go to the smallest `order`."""
    if reach > FEW:
        return _tiled(sources.select(*keys, "x", "y", F.col(order).alias("order"), value), reach, size, keys, (value,))
    moved = spread(sources.select(*keys, "x", "y", value, order), disc(reach), size)
    first = F.struct("d2", order, value)
    return moved.groupBy(*keys, "x", "y").agg(F.min(first).alias("s")).select(*keys, "x", "y", F.col("s.d2").alias("d2"), F.col(f"s.{value}").alias(value))


def _tiled(sources: DataFrame, reach: int, size: tuple[int, int], keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """(keys, x, y, d2, values): the bounded transform, tile by tile.

    A source goes to the tiles that it can reach, one row each (a halo of `reach` cells about a tile, so little more than a row a
    source). In a tile the columns' nearest sources come from running maxima of rows, and 2 reach + 1 shifts of these give the
    rows' minima; the key that is minimised holds distance and rank by order, so ties need no second look.
    """
    tiles = [F.sequence(F.expr(f"greatest({c} - {reach}, 0L) div {TILE}"), F.expr(f"least({c} + {reach}, {n - 1}L) div {TILE}")) for c, n in (("x", size[0]), ("y", size[1]))]
    dealt = sources.withColumn("tile_x", F.explode(tiles[0])).withColumn("tile_y", F.explode(tiles[1]))
    kind = {c: sources.schema[c].dataType.simpleString() for c in (*keys, *values)}
    shape = ", ".join([*(f"{k} {kind[k]}" for k in keys), "x bigint, y bigint, d2 bigint", *(f"{v} {kind[v]}" for v in values)])
    none = np.int64(1 << 62)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending")])
        x0, y0 = table.column("tile_x")[0].as_py() * TILE, table.column("tile_y")[0].as_py() * TILE
        x, y, n = table.column("x").to_numpy() - x0 + reach, table.column("y").to_numpy() - y0 + reach, table.num_rows
        side = TILE + 2 * reach
        rank = np.full((side, side), n, np.int64)
        np.minimum.at(rank, (y, x), np.arange(n))
        row = np.arange(side)[:, None]
        here = np.where(rank < n, row, -side * 4)
        key = np.full((TILE, side), none)
        for way in (1, -1):
            at = np.maximum.accumulate(here, axis=0) if way == 1 else -np.maximum.accumulate(np.where(rank < n, -row, -side * 4)[::-1], axis=0)[::-1]
            at, apart = at[reach : reach + TILE], np.abs(row[reach : reach + TILE] - at[reach : reach + TILE])
            fit = apart <= reach
            key = np.minimum(key, np.where(fit, apart * apart * (n + 1) + rank[np.where(fit, at, 0), np.arange(side)], none))
        best = np.full((TILE, TILE), none)
        for dx in range(-reach, reach + 1):
            best = np.minimum(best, key[:, reach + dx : reach + dx + TILE] + dx * dx * (n + 1))
        cy, cx = np.nonzero(best < (reach * reach + 1) * (n + 1))
        inside = (cx + x0 < size[0]) & (cy + y0 < size[1])
        cy, cx = cy[inside], cx[inside]
        d2, source = np.divmod(best[cy, cx], n + 1)
        of = table.take(pa.array(source))
        return pa.table([*(of.column(k) for k in keys), pa.array(cx + x0), pa.array(cy + y0), pa.array(d2), *(of.column(v) for v in values)], names=[*keys, "x", "y", "d2", *values])

    return unsized(dealt.groupBy(*keys, "tile_x", "tile_y").applyInArrow(run, shape))


def monotone_minima(at: np.ndarray, sites: np.ndarray, height: np.ndarray, scale: int) -> np.ndarray:
    """For each of the ascending places `at` the index of the site that minimises (at - site)**2 * scale + height.

    Parabolas of one curvature cross once, so the best sites ascend with the places: the middle place bounds the search of
    both halves, and each of the log n rounds looks at every site about once.
    """
    n, out = len(at), np.zeros(len(at), np.int64)
    step = 1 << max(n.bit_length() - 1, 0)
    while step:
        p = np.arange(step - 1, n, 2 * step)
        low = np.where(p >= step, out[np.maximum(p - step, 0)], 0)
        high = np.where(p + step < n, out[np.minimum(p + step, n - 1)], len(sites) - 1)
        many = high - low + 1
        first = np.cumsum(many) - many
        group = np.repeat(np.arange(len(p)), many)
        site = np.arange(many.sum()) - first[group] + low[group]
        cost = (at[p[group]] - sites[site]) ** 2 * scale + height[site]
        hit = np.flatnonzero(cost == np.minimum.reduceat(cost, first)[group])
        out[p] = site[hit[np.unique(group[hit], return_index=True)[1]]]
        step //= 2
    return out


def transform(sources: DataFrame, order: str, size: tuple[int, int]) -> DataFrame:
    """(x, y, d2, sx, sy, order): the nearest source of every cell of the grid, however far; ties go to the smallest `order`.

    The exact transform by separable passes: a running window down and up each column finds the column's nearest sources, and
    along a row the lower envelope of their parabolas is searched. A cell is one row throughout; a task holds a column or a
    row of the grid. Without sources there are no rows.
    """
    src = sources.groupBy("x", "y").agg(F.min(F.col(order).cast("long")).alias("order"))
    whole = sources.sparkSession.range(size[0] * size[1]).select((F.col("id") % size[0]).alias("x"), F.expr(f"id div {size[0]}").alias("y"), F.lit(True).alias("asked"))
    both = whole.withColumn("s", F.lit(None).cast("struct<order: bigint, y: bigint>")).unionByName(src.select("x", "y", F.lit(False).alias("asked"), F.struct("order", "y").alias("s")))
    column = Window.partitionBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumns({"up": F.last("s", True).over(column.orderBy("y")), "down": F.last("s", True).over(column.orderBy(F.desc("y")))}).filter("asked")
    apart = lambda c: F.when(F.col(c).isNotNull(), F.struct(((F.col("y") - F.col(f"{c}.y")) * (F.col("y") - F.col(f"{c}.y"))).alias("d2"), F.col(f"{c}.order").alias("order"), F.col(f"{c}.y").alias("sy")))
    near = seen.select("x", "y", F.least(apart("up"), apart("down")).alias("g")).select("x", "y", "g.*")
    names = ["x", "y", "d2", "sx", "sy", "order"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("x", "ascending")])
        x, full = table.column("x").to_numpy(), table.filter(table.column("d2").is_valid())
        if not full.num_rows:
            return pa.table([pa.array([], pa.int64())] * len(names), names=names)
        sites, g, by, sy = (full.column(c).to_numpy() for c in ("x", "d2", "order", "sy"))
        own, rank = np.unique(by, return_inverse=True)
        best = monotone_minima(x, sites, g * len(own) + rank, len(own))
        d2 = (x - sites[best]) ** 2 + g[best]
        return pa.table([table.column("x"), table.column("y"), pa.array(d2), pa.array(sites[best]), pa.array(sy[best]), pa.array(by[best])], names=names)

    return near.groupBy("y").applyInArrow(run, ", ".join(f"{n} bigint" for n in names))


def block_reduced(cells: DataFrame, scale: int, aggregates: dict[str, Column]) -> DataFrame:
    """Blocks of scale x scale cells (cx, cy) with aggregates over their cells; partial sums precede the shuffle."""
    return cells.groupBy((F.col("x") / scale).cast("long").alias("cx"), (F.col("y") / scale).cast("long").alias("cy")).agg(*[c.alias(k) for k, c in aggregates.items()])


def coarse_open(cells: DataFrame, scale: int, draft: float, override: DataFrame | None = None) -> DataFrame:
    """Coarse blocks and whether they are open: some cell is deep enough and some cell is not land, not need be the same one."""
    deep, dry = F.coalesce(F.col("depth") <= -draft, F.lit(False)), F.coalesce(F.col("land"), F.lit(False))
    out = block_reduced(cells, scale, {"deep": F.bool_or(deep), "water": F.bool_or(~dry)}).select("cx", "cy", (F.col("deep") & F.col("water")).alias("open"))
    if override is None:
        return out
    forced = override.select("cx", "cy", F.lit(True).alias("open"))
    return out.unionByName(forced).groupBy("cx", "cy").agg(F.bool_or("open").alias("open"))


def coarse_traversable(cells: DataFrame, scale: int, draft: float) -> DataFrame:
    """Coarse blocks of a corridor that hold some cell and some deep enough cell."""
    deep = F.coalesce(F.col("depth") <= -draft, F.lit(False))
    return block_reduced(cells, scale, {"open": F.bool_or(deep)})


def layered(lane: DataFrame, zone: DataFrame, boundary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Zones without lanes, and boundaries without lanes and zones."""
    zones = zone.join(lane, ["x", "y"], "left_anti")
    return unsized(zones), unsized(boundary.join(lane, ["x", "y"], "left_anti").join(zone, ["x", "y"], "left_anti"))


def normalised(cells: DataFrame, value: str) -> DataFrame:
    """`value` divided by its maximum if that is positive; missing values are 0. The maximum is a row."""
    top = cells.agg(F.max(F.when(~F.isnan(F.col(value).cast("double")), F.col(value))).alias("top"))
    share = F.when(F.col("top") > 0, F.col(value) / F.col("top")).otherwise(F.col(value)).cast("double")
    return cells.crossJoin(F.broadcast(top)).withColumn(value, F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0))).drop("top")


def polygon_edges(polygons: DataFrame, keys: tuple[str, ...], ring: str) -> DataFrame:
    """Edges (x1, y1, x2, y2) of polygons whose column `ring` is an array of (x, y) structs, closed or not."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(ring) - 1),
        lambda i: F.struct(
            F.get(ring, i)["x"].alias("x1"), F.get(ring, i)["y"].alias("y1"), F.get(ring, (i + 1) % F.size(ring))["x"].alias("x2"), F.get(ring, (i + 1) % F.size(ring))["y"].alias("y2")
        ),
    )
    return polygons.filter(F.size(ring) > 2).select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.*")


def rasterised(edges: DataFrame, keys: tuple[str, ...], size: tuple[int, int]) -> DataFrame:
    """Cells whose centre (x + 0.5, y + 0.5) lies in a polygon, by the even-odd rule.

    Each edge meets the rows of cells that it spans (a generator), which gives crossings; sorted along a row, the cells between
    the first and second, third and fourth and so on are inside. No cell meets an edge that does not span its row. The spans of a
    row are disjoint and its polygon's rows are met once, so cells come out once without a distinct and no task holds them.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5) - 1, F.lit(size[1] - 1))
    rows = edges.withColumns({"a": first, "b": last}).filter("a <= b").withColumn("y", F.explode(F.sequence("a", "b")))
    at = F.col("x1") + (F.col("y") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = rows.select(*keys, "y", at.alias("at")).groupBy(*keys, "y").agg(F.sort_array(F.collect_list("at")).alias("at"))
    spans = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda i: F.struct(F.get("at", i).alias("from"), F.get("at", i + 1).alias("to")))
    spans = crossings.filter(F.size("at") > 1).select(*keys, "y", F.explode(spans).alias("s"))
    left, right = F.greatest(F.ceil(F.col("s.from") - 0.5), F.lit(0)), F.least(F.ceil(F.col("s.to") - 0.5) - 1, F.lit(size[0] - 1))
    return spans.withColumns({"a": left, "b": right}).filter("a <= b").select(*keys, F.explode(F.sequence("a", "b")).alias("x"), "y")


def near_segments(segments: DataFrame, reach: float | Column, size: tuple[int, int], keys: tuple[str, ...]) -> DataFrame:
    """Cells whose centre is within `reach` cells (a number, or a column of the segments) of a segment (x1, y1, x2, y2, in cells): the buffer without its outline.

    Candidates are generated row by row from the segment's own extent, clipped to where the row comes near it.
    """
    y0 = F.greatest(F.ceil(F.least("y1", "y2") - reach - 0.5), F.lit(0)).cast("long")
    y9 = F.least(F.floor(F.greatest("y1", "y2") + reach - 0.5), F.lit(size[1] - 1)).cast("long")
    rows = segments.withColumns({"a": y0, "b": y9}).filter("a <= b").withColumn("y", F.explode(F.sequence("a", "b")))
    slope = F.when(F.col("y2") != F.col("y1"), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    along = lambda y: F.greatest(F.least(F.col("x1") + (y - F.col("y1")) * slope, F.greatest("x1", "x2")), F.least("x1", "x2"))
    low, high = along(F.col("y") + 0.5 - reach), along(F.col("y") + 0.5 + reach)
    left = F.coalesce(F.least(low, high), F.least("x1", "x2")) - reach
    right = F.coalesce(F.greatest(low, high), F.greatest("x1", "x2")) + reach
    x0, x9 = F.greatest(F.ceil(left - 0.5), F.lit(0)).cast("long"), F.least(F.floor(right - 0.5), F.lit(size[0] - 1)).cast("long")
    cells = rows.withColumns({"a": x0, "b": x9}).filter("a <= b").withColumn("x", F.explode(F.sequence("a", "b")))
    apart = segment_distance(F.col("x") + 0.5, F.col("y") + 0.5, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return unsized(cells.filter(apart <= reach).select(*keys, "x", "y").distinct())


def direction_field(segments: DataFrame, reach: float, size: tuple[int, int], order: str, bearing: str) -> DataFrame:
    """(x, y, lane_dir): the bearing, cut to whole degrees, of the latest lane within `reach` of a cell."""
    near = near_segments(segments.filter(F.col(bearing).isNotNull()), reach, size, (order, bearing))
    return near.groupBy("x", "y").agg(F.max_by(F.col(bearing).cast("long"), order).alias("lane_dir"))


def resampled(source: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """Bilinear samples of a source grid at target points (x, y, sx, sy: place in source cells, centres at halves)."""
    fx, fy = F.floor(F.col("sx") - 0.5), F.floor(F.col("sy") - 0.5)
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    put = target.withColumns({"fx": fx, "fy": fy}).withColumn("c", F.explode(corners))
    tx, ty = F.col("sx") - 0.5 - F.col("fx"), F.col("sy") - 0.5 - F.col("fy")
    share = F.when(F.col("c.i") == 1, tx).otherwise(1 - tx) * F.when(F.col("c.j") == 1, ty).otherwise(1 - ty)
    put = put.select("x", "y", (F.col("fx") + F.col("c.i")).alias("px"), (F.col("fy") + F.col("c.j")).alias("py"), share.alias("share"))
    met = put.join(source.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col(value).alias("v")), ["px", "py"]).filter("share > 0 and v is not null")
    return met.groupBy("x", "y").agg((F.sum(F.col("v") * F.col("share")) / F.sum("share")).alias(value))


def mosaic(tiles: list[DataFrame]) -> DataFrame:
    """Several tiles as one raster; where they overlap the first in order wins."""
    rows = [t.withColumn("__tile", F.lit(k)) for k, t in enumerate(tiles)]
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more)
    values = [c for c in union.columns if c not in ("x", "y", "__tile")]
    return union.groupBy("x", "y").agg(F.min_by(F.struct(*values), "__tile").alias("v")).select("x", "y", "v.*")

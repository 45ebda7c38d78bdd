"""Raster bands: tables of tiles, and import of dense row-major band files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import suffix
from . import files

TILE = 256


def write_band(cells: DataFrame, path: str) -> None:
    """Cells (x, y, values) as Parquet, a folder for each row of tiles, sorted inside; the schema stands for a sidecar."""
    tiled = cells.withColumns({"tile_y": F.floor(F.col("y") / TILE), "tile_x": F.floor(F.col("x") / TILE)})
    tiled.repartition("tile_y", "tile_x").sortWithinPartitions("tile_y", "tile_x", "y", "x").write.partitionBy("tile_y").parquet(path)


def read_band(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A band's cells; a window (x_off, y_off, w, h) prunes folders of tiles and is pushed to the scan."""
    cells = spark.read.parquet(path)
    if window:
        x, y, w, h = window
        cells = cells.filter(F.col("tile_y").between(y // TILE, (y + h - 1) // TILE) & F.col("y").between(y, y + h - 1) & F.col("x").between(x, x + w - 1))
    return cells.drop("tile_y", "tile_x")


def import_dense(spark: SparkSession, path: str, value: str, dtype: str | None = None, shape: tuple[int, int] | None = None, missing: float | None = None) -> DataFrame:
    """(x, y, value) of a dense row-major file: raw bytes with a sidecar `<name>.meta.json`, or with a header of its own.

    A given dtype or shape wins over the sidecar. The file is read in strips of rows, as many tasks as it has strips.
    """
    files.register(spark)
    store, at = files.opened(path)
    kind, (rows, columns), _ = files.dense_header(store, at, dtype, shape and f"{shape[0]},{shape[1]}")
    reader = spark.read.format("dense_band").option("value", value).option("dtype", kind.str).option("shape", f"{rows},{columns}")
    reader = reader.option("type", {"f": "double", "i": "bigint", "u": "bigint", "b": "boolean"}[kind.kind])
    return (reader if missing is None else reader.option("missing", missing)).load(path)


class Catalog:
    """Bands by name and resolution under a root folder; a missing band is None."""

    def __init__(self, spark: SparkSession, root: str, resolution: str = "1nm"):
        self.spark, self.root, self.resolution = spark, root, resolution

    def path(self, band: str) -> str:
        return f"{self.root}/{band}{suffix(self.resolution)}"

    def has(self, band: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(band))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def table(self, band: str, window: tuple[int, int, int, int] | None = None) -> DataFrame | None:
        return read_band(self.spark, self.path(band), window) if self.has(band) else None

    def land(self, buffered: bool = True) -> DataFrame | None:
        """The buffered land mask, or the plain one where there is none."""
        return (self.table("land_buffered") if buffered else None) or self.table("land")

    def once(self, band: str, build) -> DataFrame:
        """The band, built and written first if it is missing."""
        if not self.has(band):
            write_band(build(), self.path(band))
        return self.table(band)

    def describe(self, bands: tuple[str, ...]) -> DataFrame:
        """(band, present) at this resolution."""
        return self.spark.createDataFrame([(b, self.has(b)) for b in bands], "band string, present boolean")

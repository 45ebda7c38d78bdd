"""The grid: cells counted from the north-west corner, and its conversions as column expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    crs: str
    dx: float
    dy: float
    xmin: float
    ymax: float
    width: int
    height: int

    @property
    def xmax(self) -> float:
        return self.xmin + self.dx * self.width

    @property
    def ymin(self) -> float:
        return self.ymax - self.dy * self.height

    @property
    def cell_nm(self) -> float:
        return self.dx * 60.0

    @classmethod
    def read(cls, path: str) -> Grid:
        with open(path) as f:
            spec = json.load(f)
        return cls(**{k: spec[k] for k in cls.__dataclass_fields__})

    def write(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)

    def to_cell(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.floor((lon - self.xmin) / self.dx).cast("long"), F.floor((self.ymax - lat) / self.dy).cast("long")

    def centre(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.xmin + (x + 0.5) * self.dx, self.ymax - (y + 0.5) * self.dy

    def clip(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.greatest(F.least(x, F.lit(self.width - 1)), F.lit(0)), F.greatest(F.least(y, F.lit(self.height - 1)), F.lit(0))

    def holds(self, x: Column, y: Column) -> Column:
        return x.between(0, self.width - 1) & y.between(0, self.height - 1)

    def window(self, lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column) -> dict[str, Column]:
        """x_off, y_off, w and h of a bounding box, clipped to the grid."""
        (x0, y0), (x1, y1) = self.to_cell(lon_min, lat_max), self.to_cell(lon_max, lat_min)
        x_off, y_off = F.greatest(F.least(x0, x1), F.lit(0)), F.greatest(F.least(y0, y1), F.lit(0))
        w, h = F.least(F.greatest(x0, x1) + 1, F.lit(self.width)) - x_off, F.least(F.greatest(y0, y1) + 1, F.lit(self.height)) - y_off
        return {"x_off": x_off, "y_off": y_off, "w": w, "h": h}


def within(cells: DataFrame, x_off: int, y_off: int, w: int, h: int) -> DataFrame:
    """The cells of a window; with literal bounds the filter reaches the Parquet scan."""
    return cells.filter(F.col("x").between(x_off, x_off + w - 1) & F.col("y").between(y_off, y_off + h - 1))


def suffix(resolution: str) -> str:
    """Of a resolution's file names: "0.5nm" gives "_05nm"; the base resolution has none."""
    return "" if resolution == "1nm" else "_" + resolution.replace(".", "")

"""Python data sources for raster and shape files: dense bands, GeoTIFF, shapefiles, read by ranges in parallel.

Each source plans byte ranges of its files (strips of rows, groups of TIFF strips or tiles, ranges of shape records), and a task
seeks to its own range: no task holds a file. Paths go through pyarrow's file systems (plain and file:// paths, s3://, gs://,
hdfs://), so executors read shared stores themselves. `register(spark)` makes the formats known to a session:

    spark.read.format("geotiff").option("value", "depth").load("s3://bucket/gebco")
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.grid import Grid

#: Bytes of cells or records that a task reads.
RANGE = 16 << 20
NPY = b"\x93NUMPY"
#: Fixed values of the TIFF format: bytes of each field type, and the tags that are read.
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_W, TILE_H, TILES, TILE_BYTES, SAMPLE_FORMAT, PIXEL, TIEPOINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, ending: str) -> list[str]:
    """The file, or the files of a folder with that ending, by name."""
    store, at = opened(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        found = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(ending)]
        return sorted(found)
    return [at]


def ranged(sizes: list[int], limit: int = RANGE) -> list[tuple[int, int]]:
    """(first, end) of runs of items of about `limit` bytes each, at least one item."""
    out, first, held = [], 0, 0
    for k, size in enumerate(sizes):
        if k > first and held + size > limit:
            out.append((first, k))
            first, held = k, 0
        held += size
    return [*out, (first, len(sizes))] if sizes else []


@dataclass
class Part(InputPartition):
    """Items first to end of a file."""

    path: str
    first: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str], ending: str):
        self.names, self.options = schema.fieldNames(), options
        self.store = opened(options["path"])[0]
        self.files = listed(options["path"], ending)
        self.window = tuple(map(int, options["window"].split(","))) if "window" in options else None
        self.limit = int(options.get("range", RANGE))

    def cells(self, values: np.ndarray, x: int, y: int, missing: float | None) -> Iterator[pa.RecordBatch]:
        """The cells of a block whose first is (x, y), a band of rows at a time; `missing` is null."""
        if self.window:
            x0, y0, w, h = self.window
            a, b = max(0, y0 - y), max(0, x0 - x)
            values, x, y = values[a : max(a, y0 + h - y), b : max(b, x0 + w - x)], x + b, y + a
        h, w = values.shape
        step = max(1, (1 << 18) // max(w, 1))
        for lo in range(0, h if w else 0, step):
            part = values[lo : lo + step]
            flat = part.reshape(-1)
            column = pa.array(flat, mask=None if missing is None else flat == missing)
            column = column.cast(pa.float64() if flat.dtype.kind == "f" else pa.bool_() if flat.dtype.kind == "b" else pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(x, x + w), len(part))), pa.array(np.repeat(np.arange(y + lo, y + lo + len(part)), w)), column.cast(self.kind)], self.names)

    def meets(self, y: int, h: int, x: int = 0, w: int = 1 << 40) -> bool:
        """Whether a block meets the window that is asked for."""
        if not self.window:
            return True
        x0, y0, ww, hh = self.window
        return y < y0 + hh and y0 < y + h and x < x0 + ww and x0 < x + w

    def partitions(self) -> list[InputPartition]:
        # Spark asks for a part even of nothing
        return [p for f in self.files for p in self.parts(f)] or [Part("", 0, 0)]


class _Source(DataSource):
    KIND = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}
    reader_class: type[_Reader]

    def schema(self) -> str:
        return f"x bigint, y bigint, `{self.options.get('value', 'value')}` {self.options.get('type', 'bigint')}"

    def reader(self, schema) -> DataSourceReader:
        made = self.reader_class(schema, dict(self.options), self.ending)
        made.kind = self.KIND.get(schema.fields[-1].dataType.simpleString())
        return made


def dense_header(store: fs.FileSystem, path: str, dtype: str | None = None, shape: str | None = None) -> tuple[np.dtype, tuple[int, int], int]:
    """(type, (rows, columns), first byte) of a dense file; a given dtype or shape ("rows,columns") wins."""
    start = 0
    with store.open_input_file(path) as f:
        head = f.read(10)
        if head[:6] == NPY:
            size = int.from_bytes(head[8:10], "little")
            text = f.read(size).decode()
            dtype = dtype or text.split("'descr': '")[1].split("'")[0]
            shape = shape or text.split("'shape': (")[1].split(")")[0]
            start = 10 + size
    if dtype is None or shape is None:
        with store.open_input_file(path.rsplit(".", 1)[0] + ".meta.json") as f:
            meta = json.loads(f.read())
        dtype, shape = dtype or meta["dtype"], shape or ",".join(map(str, meta["shape"]))
    rows, columns = (int(n) for n in str(shape).split(",") if n.strip())
    return np.dtype(dtype), (rows, columns), start


class DenseReader(_Reader):
    """Row-major cells: raw bytes with a sidecar <name>.meta.json, or a header of its own; a given dtype or shape wins over both."""

    def header(self, path: str) -> tuple[np.dtype, tuple[int, int], int]:
        return dense_header(self.store, path, self.options.get("dtype"), self.options.get("shape"))

    def parts(self, path: str) -> list[Part]:
        dtype, (rows, columns), _ = self.header(path)
        step = max(1, self.limit // max(1, columns * dtype.itemsize))
        return [Part(path, y, min(rows, y + step)) for y in range(0, rows, step) if self.meets(y, step)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.end:
            dtype, (_, columns), start = self.header(part.path)
            missing = float(self.options["missing"]) if "missing" in self.options else None
            with self.store.open_input_file(part.path) as f:
                f.seek(start + part.first * columns * dtype.itemsize)
                values = np.frombuffer(f.read((part.end - part.first) * columns * dtype.itemsize), dtype).reshape(-1, columns)
            yield from self.cells(values.astype(dtype.newbyteorder("=")), 0, part.first, missing)


class DenseBand(_Source):
    """Options: value, type (bigint, double or boolean), dtype, shape ("rows,columns"), missing, window ("x,y,w,h"), range (bytes a task)."""

    reader_class, ending = DenseReader, ".npy"

    @classmethod
    def name(cls) -> str:
        return "dense_band"


class Tiff:
    """The first image of a TIFF or BigTIFF file: its tags, and where its blocks lie."""

    def __init__(self, f):
        head = f.read(16)
        self.order = {b"II": "<", b"MM": ">"}[head[:2]]
        big = struct.unpack(f"{self.order}H", head[2:4])[0] == 43
        at, count, entry, offset = (struct.unpack(f"{self.order}Q", head[8:16])[0], "Q", 20, "Q") if big else (struct.unpack(f"{self.order}I", head[4:8])[0], "H", 12, "I")
        f.seek(at)
        (n,) = struct.unpack(f"{self.order}{count}", f.read(struct.calcsize(f"={count}")))
        raw, wide = f.read(n * entry), struct.calcsize(f"={offset}")
        self.tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, many = struct.unpack(f"{self.order}HH{offset}", raw[k * entry : k * entry + 4 + wide])
            size = many * struct.calcsize(f"={FIELD.get(kind, 'B')}")
            value = raw[k * entry + 4 + wide : (k + 1) * entry]
            if size > wide:
                f.seek(struct.unpack(f"{self.order}{offset}", value)[0])
                value = f.read(size)
            if kind in FIELD:
                self.tags[tag] = (value[:size],) if kind == 2 else struct.unpack(f"{self.order}{many}{FIELD[kind]}", value[:size])
        one = lambda tag, default=None: self.tags[tag][0] if tag in self.tags else default
        self.width, self.height, self.compression, self.predictor = one(WIDTH), one(HEIGHT), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if one(277, 1) != 1 or self.compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or self.predictor not in (1, 2):
            raise ValueError("the TIFF file has several samples a pixel, or a compression that is not read here")
        self.dtype = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[one(SAMPLE_FORMAT, 1)]}{one(BITS, 8) // 8}")
        tiled = TILES in self.tags
        self.block_w, self.block_h = (one(TILE_W), one(TILE_H)) if tiled else (self.width, one(STRIP_ROWS, self.height))
        self.offsets, self.sizes = self.tags[TILES if tiled else STRIPS], self.tags[TILE_BYTES if tiled else STRIP_BYTES]
        self.across, self.tiled = -(-self.width // self.block_w), tiled
        nodata = one(NODATA)
        self.nodata = float(nodata.strip(b"\x00 ")) if nodata else None

    def grid(self, crs: str = "EPSG:4326") -> Grid:
        """The grid of the file's pixels by its scale and tie point; of unit cells where it has none."""
        dx, dy = self.tags.get(PIXEL, (1.0, 1.0))[:2]
        i, j, _, x, y = self.tags.get(TIEPOINT, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))[:5]
        return Grid(crs, dx, dy, x - i * dx, y + j * dy, self.width, self.height)

    def place(self, k: int) -> tuple[int, int, int, int]:
        """x, y, width and height of block k's pixels inside the image."""
        x, y = k % self.across * self.block_w, k // self.across * self.block_h
        return x, y, min(self.block_w, self.width - x), min(self.block_h, self.height - y)

    def block(self, k: int, raw: bytes) -> np.ndarray:
        _, _, w, h = self.place(k)
        data = zlib.decompress(raw) if self.compression in (DEFLATE, OLD_DEFLATE) else unpacked_lzw(raw) if self.compression == LZW else raw
        rows = self.block_h if self.tiled else h
        values = np.frombuffer(data, self.dtype, rows * self.block_w).reshape(rows, self.block_w).astype(self.dtype.newbyteorder("="))
        if self.predictor == 2:
            values = np.cumsum(values, axis=1, dtype=values.dtype)
        return values[:h, :w]


def unpacked_lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    out, table, wide, held, bits, last = [], [], 9, 0, 0, b""
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < wide:
            continue
        bits -= wide
        code = held >> bits & (1 << wide) - 1
        if code == 257:
            break
        if code == 256:
            table, wide, last = [bytes([b]) for b in range(256)] + [b"", b""], 9, b""
            continue
        now = table[code] if code < len(table) else last + last[:1]
        out.append(now)
        if last:
            table.append(last + now[:1])
        # a code grows a step before its table is full
        wide, last = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047), now
    return b"".join(out)


class TiffReader(_Reader):
    def tiff(self, path: str) -> tuple[Tiff, int, int]:
        """The file, and the cell of its first pixel: on the grid of the option `grid` (xmin,ymax,dx,dy), else 0, 0."""
        with self.store.open_input_file(path) as f:
            t = Tiff(f)
        if "grid" not in self.options:
            return t, 0, 0
        xmin, ymax, dx, dy = map(float, self.options["grid"].split(","))
        own = t.grid()
        return t, round((own.xmin - xmin) / dx), round((ymax - own.ymax) / dy)

    def parts(self, path: str) -> list[Part]:
        t, x, y = self.tiff(path)
        cells = [t.block_w * t.block_h * t.dtype.itemsize] * len(t.offsets)
        runs = ranged(cells, self.limit)
        near = lambda k: (lambda bx, by, w, h: self.meets(y + by, h, x + bx, w))(*t.place(k))
        return [Part(path, a, b) for a, b in runs if any(near(k) for k in range(a, b))]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.end:
            t, x, y = self.tiff(part.path)
            with self.store.open_input_file(part.path) as f:
                for k in range(part.first, part.end):
                    bx, by, _, _ = t.place(k)
                    f.seek(t.offsets[k])
                    yield from self.cells(t.block(k, f.read(t.sizes[k])), x + bx, y + by, t.nodata)


class GeoTiff(_Source):
    """A file or a folder of files; options: value, type, grid ("xmin,ymax,dx,dy" of the grid that cells are counted on), window, range."""

    reader_class, ending = TiffReader, ".tif"

    @classmethod
    def name(cls) -> str:
        return "geotiff"


class ShapeReader(_Reader):
    """Polygons and lines of .shp files; the .shx beside a file says where its records lie."""

    def records(self, path: str) -> np.ndarray:
        with self.store.open_input_file(path[:-4] + (".shx" if path[-1] == "p" else ".SHX")) as f:
            f.seek(100)
            return np.frombuffer(f.read(), ">i4").reshape(-1, 2).astype(np.int64) * 2

    def parts(self, path: str) -> list[Part]:
        return [Part(path, a, b) for a, b in ranged(self.records(path)[:, 1].tolist(), self.limit)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.end:
            where = self.records(part.path)[part.first : part.end]
            with self.store.open_input_file(part.path) as f:
                for number, (offset, size) in enumerate(where.tolist(), part.first):
                    f.seek(offset + 8)
                    kind, rings = shape_of(f.read(size))
                    yield part.path, number, kind, rings


def shape_of(raw: bytes) -> tuple[str | None, list | None]:
    """(kind, rings or lines of points) of a record; heights and measures are left out."""
    kind = {3: "line", 5: "polygon"}.get(struct.unpack("<i", raw[:4])[0] % 10)
    if kind is None:
        return None, None
    parts, points = struct.unpack("<ii", raw[36:44])
    first = np.append(np.frombuffer(raw, "<i4", parts, 44), points)
    at = np.frombuffer(raw, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    return kind, [[(x, y) for x, y in at[a:b].tolist()] for a, b in zip(first, first[1:])]


class Shapefile(_Source):
    """A file or a folder of files: (file, record, kind, rings); records without lines or polygons have null rings."""

    reader_class, ending = ShapeReader, ".shp"

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "file string, record bigint, kind string, rings array<array<struct<lon: double, lat: double>>>"


def register(spark: SparkSession) -> None:
    for source in (DenseBand, GeoTiff, Shapefile):
        spark.dataSource.register(source)


def edges_in_cells(shapes: DataFrame, grid: Grid) -> DataFrame:
    """(file, record, x1, y1, x2, y2): the edges of all rings of each shape, in cells of the grid, as raster.rasterised takes them."""
    rings = shapes.select("file", "record", F.explode("rings").alias("r")).filter(F.size("r") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda i: F.struct(F.get("r", i).alias("a"), F.get("r", i + 1).alias("b")))
    x, y = (lambda p: (F.col(f"e.{p}.lon") - grid.xmin) / grid.dx), (lambda p: (grid.ymax - F.col(f"e.{p}.lat")) / grid.dy)
    return rings.select("file", "record", F.explode(pairs).alias("e")).select("file", "record", x("a").alias("x1"), y("a").alias("y1"), x("b").alias("x2"), y("b").alias("y2"))


def tiff_bytes(values: np.ndarray, grid: Grid, nodata: float | None, block: int = 64) -> bytes:
    """A tiled, deflated GeoTIFF of one band."""
    h, w = values.shape
    across, down = -(-w // block), -(-h // block)
    full = np.zeros((down * block, across * block), values.dtype)
    full[:h, :w] = values
    tiles = [zlib.compress(full[j * block : (j + 1) * block, i * block : (i + 1) * block].tobytes()) for j in range(down) for i in range(across)]
    offsets = np.cumsum([8, *map(len, tiles)]).tolist()
    at = offsets[-1] + offsets[-1] % 2
    fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [values.dtype.itemsize * 8]), (COMPRESSION, 3, [DEFLATE]), (277, 3, [1]), (TILE_W, 3, [block]), (TILE_H, 3, [block]),
              (TILES, 4, offsets[:-1]), (TILE_BYTES, 4, [len(t) for t in tiles]), (SAMPLE_FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]]),
              (PIXEL, 12, [grid.dx, grid.dy, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, grid.xmin, grid.ymax, 0.0])]
    fields += [(NODATA, 2, [str(nodata).encode() + b"\x00"])] if nodata is not None else []
    more, entries, later = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, kind, items in fields:
        data = items[0] if kind == 2 else struct.pack(f"<{len(items)}{FIELD[kind]}", *items)
        many = len(data) if kind == 2 else len(items)
        value = data.ljust(4, b"\x00") if len(data) <= 4 else struct.pack("<I", later + len(more))
        more += data + b"\x00" * (len(data) % 2) if len(data) > 4 else b""
        entries += struct.pack("<HHI", tag, kind, many) + value
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(tiles) + b"\x00" * (at - offsets[-1]) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + more


def write_tiffs(cells: DataFrame, value: str, folder: str, grid: Grid, side: int = 1024, dtype: str = "<i2", nodata: float = -32768) -> DataFrame:
    """Cells (x, y, value) as a folder of GeoTIFF files, one for each square of side x side cells, written by the tasks: (file, cells)."""
    dealt = cells.select("x", "y", F.col(value).alias("v"), F.expr(f"x div {side}").alias("i"), F.expr(f"y div {side}").alias("j"))

    def write(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        w, h = min(side, grid.width - i * side), min(side, grid.height - j * side)
        values = np.full((h, w), nodata, dtype)
        values[table.column("y").to_numpy() - j * side, table.column("x").to_numpy() - i * side] = table.column("v").fill_null(int(nodata)).to_numpy()
        own = Grid(grid.crs, grid.dx, grid.dy, grid.xmin + i * side * grid.dx, grid.ymax - j * side * grid.dy, w, h)
        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        name = f"{at}/tile-{j:05d}-{i:05d}.tif"
        with store.open_output_stream(name) as f:
            f.write(tiff_bytes(values, own, nodata))
        return pa.table({"file": [name], "cells": [table.num_rows]})

    return dealt.groupBy("i", "j").applyInArrow(write, "file string, cells bigint")


def write_shapes(polygons: DataFrame, folder: str) -> DataFrame:
    """Polygons (part, rings of (lon, lat)) as a folder of shapefiles, one for each `part`, written by the tasks: (file, records)."""

    def write(table: pa.Table) -> pa.Table:
        store, at = opened(folder)
        store.create_dir(at, recursive=True)
        shp, shx, place = b"", b"", 50
        for number, rings in enumerate(table.column("rings").to_pylist(), 1):
            points = np.array([(p["lon"], p["lat"]) for r in rings for p in r])
            first = np.cumsum([0, *map(len, rings)])[:-1]
            box = (*points.min(axis=0), *points.max(axis=0))
            body = struct.pack("<i4dii", 5, *box, len(rings), len(points)) + first.astype("<i4").tobytes() + points.astype("<f8").tobytes()
            shp += struct.pack(">ii", number, len(body) // 2) + body
            shx += struct.pack(">ii", place, len(body) // 2)
            place += 4 + len(body) // 2
        name = f"{at}/part-{table.column('part')[0].as_py():05d}"
        for ending, body in ((".shp", shp), (".shx", shx)):
            head = struct.pack(">i20xi", 9994, 50 + len(body) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
            with store.open_output_stream(name + ending) as f:
                f.write(head + body)
        return pa.table({"file": [name], "records": [table.num_rows]})

    return polygons.select("part", "rings").groupBy("part").applyInArrow(write, "file string, records bigint")

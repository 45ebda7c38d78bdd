"""The file data sources read back what plain writers wrote, in several parts."""

import json
import struct
import zlib

import numpy as np
import pytest

from brinegrid.functions.grid import Grid
from brinegrid.operators import raster
from brinegrid.sources import bands, files


@pytest.fixture(scope="module")
def ready(spark):
    files.register(spark)
    return spark


def cells(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def band(seed=1, h=37, w=23, dtype="i2"):
    return np.random.default_rng(seed).integers(-500, 500, (h, w)).astype(dtype)


def want(values, missing=None, window=None):
    x0, y0, w, h = window or (0, 0, values.shape[1], values.shape[0])
    return {(x, y): None if values[y, x] == missing else values[y, x].item() for y in range(y0, min(y0 + h, values.shape[0])) for x in range(x0, min(x0 + w, values.shape[1]))}


def test_dense_band_with_header_and_with_sidecar(ready, tmp_path):
    values = band()
    np.save(f"{tmp_path}/own.npy", values)
    values.tofile(f"{tmp_path}/raw.npy")
    (tmp_path / "raw.meta.json").write_text(json.dumps({"shape": list(values.shape), "dtype": "int16"}))
    for name in ("own", "raw"):
        df = ready.read.format("dense_band").option("value", "depth").option("range", 200).load(f"{tmp_path}/{name}.npy")
        assert df.rdd.getNumPartitions() == 10 and cells(df) == want(values) and df.columns == ["x", "y", "depth"]
    part = ready.read.format("dense_band").option("window", "5,8,90,4").option("missing", values[9, 6].item()).option("range", 100).load(f"file://{tmp_path}/own.npy")
    assert cells(part) == want(values, values[9, 6], (5, 8, 90, 4)) and part.rdd.getNumPartitions() < 4
    (values > 0).astype("u1").tofile(f"{tmp_path}/mask.npy")
    mask = ready.read.format("dense_band").option("shape", "37,23").option("dtype", "bool").option("type", "boolean").load(f"{tmp_path}/mask.npy")
    assert cells(mask) == want(values > 0)


def test_import_dense_finds_type_and_shape(ready, tmp_path):
    values = band(3, dtype="f4")
    np.save(f"{tmp_path}/d.npy", values)
    df = bands.import_dense(ready, f"{tmp_path}/d.npy", "density", missing=float(values[1, 1]))
    assert df.schema["density"].dataType.simpleString() == "double" and cells(df) == want(values, values[1, 1])
    assert bands.import_dense(ready, f"{tmp_path}/d.npy", "n", "<i4", (37, 23)).count() == values.size


def packed_lzw(data):
    """The encoder of the format, by its definition."""
    bits, table, now = [], {bytes([b]): b for b in range(256)}, b""
    wide, free = 9, 258

    def put(code):
        bits.append(f"{code:0{wide}b}")

    put(256)
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now])
        table[now + bytes([b])] = free
        free += 1
        wide = 9 + (free > 511) + (free > 1023) + (free > 2047)
        if free > 4093:
            put(256)
            table, wide, free = {bytes([b]): b for b in range(256)}, 9, 258
        now = bytes([b])
    if now:
        put(table[now])
        free += 1
        wide = 9 + (free > 511) + (free > 1023) + (free > 2047)
    put(257)
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


@pytest.mark.parametrize("size", [0, 1, 300, 5000, 60000])
def test_lzw_round_trip(size):
    rng = np.random.default_rng(size)
    for data in (bytes(size), rng.integers(0, 256, size).astype("u1").tobytes(), (b"abcab" * size)[:size]):
        assert files.unpacked_lzw(packed_lzw(data)) == data


def stripped(values, order, compression, predictor, big=False, rows=5):
    """A TIFF of strips, by a writer of its own."""
    h, w = values.shape
    strips = []
    for y in range(0, h, rows):
        part = values[y : y + rows]
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(values.dtype)
        raw = part.astype(values.dtype.newbyteorder(order)).tobytes()
        strips.append({1: raw, 5: packed_lzw(raw) if compression == 5 else b"", 8: zlib.compress(raw)}[compression])
    head = 16 if big else 8
    offsets = np.cumsum([head, *map(len, strips)]).tolist()
    size = "Q" if big else "I"
    fields = [(256, "I", [w]), (257, "I", [h]), (258, "H", [values.dtype.itemsize * 8]), (259, "H", [compression]), (273, size, offsets[:-1]), (277, "H", [1]), (278, "I", [rows]), (279, "I", [len(s) for s in strips]), (317, "H", [predictor]), (339, "H", [2])]
    code = {"H": 3, "I": 4, "Q": 16}
    entry, wide = (20, 8) if big else (12, 4)
    later, entries, more = offsets[-1] + (8 if big else 2) + entry * len(fields) + wide, b"", b""
    for tag, kind, items in fields:
        data = struct.pack(f"{order}{len(items)}{kind}", *items)
        value = data.ljust(wide, b"\0") if len(data) <= wide else struct.pack(f"{order}{size}", later + len(more))
        more += data if len(data) > wide else b""
        entries += struct.pack(f"{order}HH{size}", tag, code[kind], len(items)) + value
    mark = b"II" if order == "<" else b"MM"
    top = mark + struct.pack(f"{order}HHHQ", 43, 8, 0, offsets[-1]) if big else mark + struct.pack(f"{order}HI", 42, offsets[-1])
    return top + b"".join(strips) + struct.pack(f"{order}{'Q' if big else 'H'}", len(fields)) + entries + struct.pack(f"{order}{size}", 0) + more


@pytest.mark.parametrize(("order", "compression", "predictor", "big"), [("<", 1, 1, False), (">", 8, 2, False), ("<", 5, 2, False), (">", 5, 1, True)])
def test_tiff_strips(ready, tmp_path, order, compression, predictor, big):
    values = band()
    (tmp_path / "a.tif").write_bytes(stripped(values, order, compression, predictor, big))
    df = ready.read.format("geotiff").option("range", 300).load(f"{tmp_path}/a.tif")
    assert df.rdd.getNumPartitions() > 3 and cells(df) == want(values)
    assert cells(ready.read.format("geotiff").option("window", "3,7,4,9").load(f"{tmp_path}/a.tif")) == want(values, None, (3, 7, 4, 9))


def test_tiff_tiles_of_a_folder_form_one_raster(ready, tmp_path):
    grid, values = Grid("EPSG:4326", 0.1, 0.1, -20.0, 60.0, 70, 45), band(2, 45, 70)
    table = ready.createDataFrame([(x, y, None if (x + y) % 7 == 0 else int(values[y, x])) for x in range(70) for y in range(45)], "x bigint, y bigint, v bigint")
    written = files.write_tiffs(table, "v", f"{tmp_path}/tiles", grid, side=32).collect()
    assert len(written) == 6 and sum(r.cells for r in written) == 3150
    back = ready.read.format("geotiff").option("value", "v").option("grid", "-20.0,60.0,0.1,0.1").load(f"{tmp_path}/tiles")
    assert back.rdd.getNumPartitions() == 6 and cells(back) == cells(table)
    with open(written[0].file, "rb") as f:
        own = files.Tiff(f).grid()
    assert own.dx == own.dy == 0.1 and own.width in (32, 6) and round((own.xmin + 20) / 0.1) % 32 == 0


def test_shapefile_records_holes_and_nulls(ready, tmp_path):
    outer, hole = [(1.0, 1.0), (9.0, 1.0), (9.0, 8.0), (1.0, 8.0), (1.0, 1.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)]
    point = lambda p: {"lon": float(p[0]), "lat": 10.0 - p[1]}
    rows = [(0, [[point(p) for p in outer], [point(p) for p in hole]])] + [(0, [[point((k + a, 9 + b)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0))]]) for k in range(8)]
    files.write_shapes(ready.createDataFrame(rows, "part bigint, rings array<array<struct<lon: double, lat: double>>>"), f"{tmp_path}/s").collect()
    df = ready.read.format("shapefile").option("range", 150).load(f"{tmp_path}/s")
    assert df.rdd.getNumPartitions() > 3 and df.count() == 9
    grid = Grid("EPSG:4326", 1.0, 1.0, 0.0, 10.0, 10, 10)
    edges = files.edges_in_cells(df, grid)
    burnt = {(r.x, r.y) for r in raster.rasterised(edges.filter("record = 0"), ("file", "record"), (10, 10)).collect()}
    assert burnt == {(x, y) for x in range(1, 9) for y in range(1, 8) if not (3 <= x < 6 and 3 <= y < 6)}
    assert files.shape_of(struct.pack("<i", 0)) == (None, None)


def test_an_empty_folder_has_no_rows(ready, tmp_path):
    (tmp_path / "none").mkdir()
    assert ready.read.format("geotiff").load(f"{tmp_path}/none").count() == 0
    assert ready.read.format("shapefile").load(f"{tmp_path}/none").count() == 0

"""GeoTIFF of a regular two-dimensional field: strips of 32-bit floats with their tie point and pixel size."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

import pyarrow as pa
from pyspark.sql import SparkSession

from ..frame import Coord, Grid, GridError
from ..functions.axes import is_regular
from .bytesio import created, slabs
from .store import Format, add_format, add_writer

# TIFF tags of the file.
NO_DATA = -1e20


def pieces(grid: Grid) -> Iterator[bytes]:
    """The bytes of the file, the cells a slab at a time."""
    x, y = grid.coord(axis="x", is_dim=True), grid.coord(axis="y", is_dim=True)
    if len(grid.dims) != 2 or not is_regular(x) or not is_regular(y):
        raise GridError("a raster needs two regular axes")
    ny, nx = len(y.points), len(x.points)
    dx, dy = abs(float(x.points[1] - x.points[0])), abs(float(y.points[1] - y.points[0]))
    left, top = float(x.points.min()) - dx / 2, float(y.points.max()) + dy / 2
    length, blank = 4 * ny * nx, f"{NO_DATA:g}\0".encode()
    scale, tie = struct.pack("<3d", dx, dy, 0), struct.pack("<6d", 0, 0, 0, left, top, 0)
    keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    extra = [scale, tie, keys, blank + bytes(len(blank) % 2)]
    at, places = 8 + length, []
    for e in extra:
        places.append(at)
        at += len(e)
    entries = [
        (256, 4, 1, nx), (257, 4, 1, ny), (258, 3, 1, 32), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, ny), (279, 4, 1, length), (339, 3, 1, 3),
        (33550, 12, 3, places[0]), (33922, 12, 6, places[1]), (34735, 3, 16, places[2]), (42113, 2, len(blank), places[3]),
    ]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    yield b"II*\0" + struct.pack("<I", at)
    yield from slabs(grid, [*y.dims, *x.dims], "<f4", NO_DATA, falling=() if y.points[0] > y.points[-1] else y.dims)
    yield b"".join(extra) + directory


def to_bytes(grid: Grid) -> bytes:
    return b"".join(pieces(grid))


def save_raster(grid: Grid, path: str, **_) -> None:
    with created(grid.spark, path) as stream:
        for piece in pieces(grid):
            stream.write(piece)


# Widths of TIFF number kinds.
WIDTHS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}


def _directory(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the entries of a file's first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise GridError("no TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in WIDTHS:
            continue
        code, width = WIDTHS[kind]
        place = at + 10 + 12 * k if width * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        out[tag] = (data[place : place + count],) if kind == 2 else struct.unpack_from(f"{order}{count}{code}", data, place)
    return order, out


def load_raster(spark: SparkSession, path: str) -> Grid:
    """A GeoTIFF of uncompressed 32-bit floats as a latitude-longitude field, rows from the north; cells are read by a task."""
    def facts(batches):
        for b in batches:
            for content in b.column(0):
                _, e = _directory(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([[float(x) for x in (e[256][0], e[257][0], *e[33550][:2], *e[33922][3:5])]], pa.list_(pa.float64()))], names=["f"])

    files = spark.read.format("binaryFile").load(path).select("content")
    nx, ny, dx, dy, left, top = files.mapInArrow(facts, "f array<double>").head()[0]
    nx, ny = int(nx), int(ny)

    def cells(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                order, e = _directory(data)
                if e.get(258) != (32,) or e.get(259, (1,)) != (1,) or e.get(339) != (3,):
                    raise GridError("only uncompressed 32-bit floats are read")
                blank = float(e[42113][0].split(b"\0")[0]) if 42113 in e else None
                rows = e.get(278, (ny,))[0]
                for k, (at, size) in enumerate(zip(e[273], e[279])):
                    v = np.frombuffer(data, order + "f4", size // 4, at).astype(float)
                    y, x = np.divmod(np.arange(len(v)), nx)
                    yield pa.RecordBatch.from_arrays([pa.array(y + k * rows, pa.int32()), pa.array(x, pa.int32()), pa.array(v, mask=np.zeros(len(v), bool) if blank is None else np.isclose(v, blank, rtol=1e-6, atol=0))], names=["i_latitude", "i_longitude", "v"])

    y = Coord(standard_name="latitude", units="degrees", points=top - dy * (np.arange(ny) + 0.5), dims=("latitude",), is_dim=True)
    x = Coord(standard_name="longitude", units="degrees", points=left + dx * (np.arange(nx) + 0.5), dims=("longitude",), is_dim=True)
    return Grid(df=files.mapInArrow(cells, "i_latitude int, i_longitude int, v double"), dims={"latitude": ny, "longitude": nx}, coords=(y, x), long_name="raster")


add_writer("tif", save_raster)
add_format(Format(6, "GeoTIFF", lambda p, b: b[:4] in (b"II*\0", b"MM\0*"), lambda spark, path: [load_raster(spark, path)]))

"""Polygons of shape files, and masks by them."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..frame import Coord, Grid, GridError
from ..operators.subset import mask_where, polygon_weights
from .bytesio import with_file

# The file's mark, and the shape kinds that are polygons (plain, with heights, with measures).
MARK, HEADER, POLYGONS = 9994, 100, (5, 15, 25)


def rings(read, size: int):
    """The rings of every polygon of a file: (shape number, points)."""
    if struct.unpack(">i", read(0, 4))[0] != MARK:
        raise GridError("no shape file")
    at, k = HEADER, 0
    while at + 12 <= size:
        words = struct.unpack(">i", read(at + 4, 4))[0]
        raw = read(at + 8, words * 2)
        if struct.unpack_from("<i", raw)[0] in POLYGONS:
            parts, points = struct.unpack_from("<2i", raw, 36)
            begins = [*struct.unpack_from(f"<{parts}i", raw, 44), points]
            xy = np.frombuffer(raw, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            for a, b in zip(begins, begins[1:]):
                yield k, xy[a:b].tolist()
        at, k = at + 8 + words * 2, k + 1


def load_rings(spark: SparkSession, path: str) -> list[list[tuple[float, float]]]:
    """Rings of all polygons; outer ones run clockwise, holes the other way. Geometry, so small beside cells."""

    def rows(read, size):
        found = list(rings(read, size))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([p for _, p in found], pa.list_(pa.list_(pa.float64())))], names=["k", "p"])

    return [[tuple(q) for q in r.p] for r in with_file(spark, path, rows, "k int, p array<array<double>>").collect()]


def _turn(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def shape_weights(x: Coord, y: Coord, all_rings) -> np.ndarray:
    """The share of each cell that polygons cover: outer rings less holes."""
    out = np.zeros((len(y.points), len(x.points)))
    for ring in all_rings:
        out += polygon_weights(x, y, ring[:-1] if ring[0] == ring[-1] else ring) * (-1 if _turn([*ring, ring[0]]) > 0 else 1)
    return np.clip(out, 0, 1)


def mask_outside_shapefile(grid: Grid, path: str, minimum_weight: float = 0.5, invert: bool = False) -> Grid:
    """Mask the cells of which the file's polygons cover less than ``minimum_weight``."""
    x, y = grid.coord(axis="x"), grid.coord(axis="y")
    inside = shape_weights(x, y, load_rings(grid.spark, path)) >= max(minimum_weight, 1e-12)
    return mask_where(grid, Coord(long_name="outside", points=inside if invert else ~inside, dims=(*y.dims, *x.dims)))


def polygon_file(polygons: list[list[list[tuple[float, float]]]]) -> bytes:
    """A shape file of polygons, each a list of rings."""
    body = b""
    for k, parts in enumerate(polygons):
        flat = np.array([q for ring in parts for q in ring], float)
        box = [*flat.min(axis=0), *flat.max(axis=0)]
        begins = np.cumsum([0, *(len(r) for r in parts[:-1])]).tolist()
        raw = struct.pack("<i4d2i", 5, *box, len(parts), len(flat)) + struct.pack(f"<{len(parts)}i", *begins) + flat.astype("<f8").tobytes()
        body += struct.pack(">2i", k + 1, len(raw) // 2) + raw
    whole = np.array([q for parts in polygons for ring in parts for q in ring], float)
    return struct.pack(">7i", MARK, 0, 0, 0, 0, 0, (HEADER + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *whole.min(axis=0), *whole.max(axis=0), 0, 0, 0, 0) + body

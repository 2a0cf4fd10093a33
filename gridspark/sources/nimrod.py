"""NIMROD files: radar and nowcast fields, a header of 512 bytes and a grid each, read by ranges and written."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..frame import Coord, Grid, GridError, monotonic
from ..functions.systems import GeogCS, osgb
from ..units import Unit, civil_from_days, days_from_civil
from .bytesio import created, slabs, with_file, with_spans
from .store import Format, add_format, add_writer, problem

# The header's parts in bytes, and places in its integers and reals (from 0).
HEADER, INTS, REALS, MORE_REALS, TEXT, MORE_INTS = 512, 31, 28, 45, 56, 51
VALID, ISSUED, KIND, WIDTH, GRID, ROWS, COLS, CODE, VERTICAL, CORNER, MISSING_INT, PERIOD = 0, 6, 11, 12, 14, 15, 16, 18, 19, 23, 24, 25
HEIGHT, NORTH, ROW_STEP, EAST, COLUMN_STEP, MISSING = 0, 2, 3, 4, 5, 6
NATIONAL, GEOGRAPHIC, PLANE = 0, 1, 4
DTYPES = {(0, 4): ">f4", (1, 1): ">i1", (1, 2): ">i2", (1, 4): ">i4", (2, 1): ">u1"}
LEVELS = {0: ("height", "m"), 1: ("altitude", "m"), 3: ("air_pressure", "hPa"), 4: ("sigma", "1")}
UNSET = -32767


def _records(read, size: int):
    """(integers, reals, texts, begin, bytes) of each field."""
    at = 0
    while at + HEADER + 8 <= size:
        raw = read(at, HEADER + 12)
        if struct.unpack_from(">i", raw)[0] != HEADER:
            raise GridError("broken NIMROD record")
        ints = np.frombuffer(raw, ">i2", INTS, 4).astype(int).tolist()
        reals = np.frombuffer(raw, ">f4", REALS, 4 + 2 * INTS).astype(float).tolist()
        texts = raw[4 + 2 * INTS + 4 * (REALS + MORE_REALS) :][:TEXT].decode("latin-1")
        (own,) = struct.unpack_from(">i", raw, HEADER + 8)
        yield ints, reals, [texts[:8].strip("\0 "), texts[8:32].strip("\0 "), texts[32:].strip("\0 ")], at + HEADER + 12, own
        at += HEADER + 8 + own + 8


def _hours(parts: list[int]) -> float:
    return float(days_from_civil(*parts[:3])) * 24 + parts[3] + parts[4] / 60 + (parts[5] / 3600 if len(parts) > 5 and parts[5] > 0 else 0)


def _field(spark: SparkSession, path: str, ints, reals, texts, begin: int, size: int) -> Grid:
    rows, cols, dtype = ints[ROWS], ints[COLS], DTYPES.get((ints[KIND], ints[WIDTH]))
    if dtype is None or rows * cols * np.dtype(dtype).itemsize != size:
        raise GridError(f"values of kind {ints[KIND]} and width {ints[WIDTH]} aren't read")
    if ints[GRID] not in (NATIONAL, GEOGRAPHIC, PLANE):
        raise GridError(f"grids of kind {ints[GRID]} aren't read")
    plane = ints[GRID] != GEOGRAPHIC
    system, names, units = (osgb(), ("projection_x_coordinate", "projection_y_coordinate"), "m") if plane else (GeogCS(6_371_229.0), ("longitude", "latitude"), "degrees")
    down, left = ints[CORNER] in (0, 2), ints[CORNER] in (0, 1)
    y = reals[NORTH] + abs(reals[ROW_STEP]) * np.arange(rows) * (-1 if down else 1)
    x = reals[EAST] + abs(reals[COLUMN_STEP]) * np.arange(cols) * (1 if left else -1)
    coords = [Coord(standard_name=n, units=units, points=p, dims=(d,), is_dim=monotonic(p), coord_system=system) for n, p, d in ((names[1], y, "y"), (names[0], x, "x"))]
    valid, issued = _hours(ints[VALID : VALID + 6]), _hours(ints[ISSUED : ISSUED + 5])
    span = ints[PERIOD] / 60 if ints[PERIOD] > 0 else 0.0
    epoch = "hours since 1970-01-01"
    coords.append(Coord(standard_name="time", units=epoch, points=np.array(valid), bounds=np.array([valid - span, valid]) if span else None, dims=()))
    coords.append(Coord(standard_name="forecast_reference_time", units=epoch, points=np.array(issued), dims=()))
    coords.append(Coord(standard_name="forecast_period", units="hours", points=np.array(valid - issued), dims=()))
    if ints[VERTICAL] in LEVELS and reals[HEIGHT] > UNSET:
        name, unit = LEVELS[ints[VERTICAL]]
        coords.append(Coord(long_name=name, units=unit, points=np.array(reals[HEIGHT]), dims=()))
    missing = reals[MISSING] if dtype == ">f4" else float(ints[MISSING_INT])

    def cells(first: int, raw: bytes):
        v = np.frombuffer(raw, dtype).astype(float)
        j, i = np.divmod(np.arange(first, first + len(v)), cols)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(v, mask=v == missing)], names=["i_y", "i_x", "v"])

    width, step = np.dtype(dtype).itemsize, 1 << 20
    spans = [(k, begin + k * width, min(step, rows * cols - k) * width) for k in range(0, rows * cols, step)]
    try:
        Unit.parse(texts[0])
        unit = texts[0] or "1"
    except ValueError:
        unit = "unknown"
    facts = {"field_code": ints[CODE], "source": texts[1], **({"invalid_units": texts[0]} if unit == "unknown" else {})}
    return Grid(df=with_spans(spark, path, spans, cells, "i_y int, i_x int, v double"), dims={"y": rows, "x": cols}, coords=tuple(coords), long_name=texts[2] or f"field {ints[CODE]}", units=unit, attributes=facts)


def load_nimrod(spark: SparkSession, path: str) -> list[Grid]:
    """One field a record; a field that can't be read is noted as a problem."""
    kinds = "i array<long>, r array<double>, t array<string>, b long, s long"

    def rows(read, size):
        found = list(_records(read, size))
        types = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["i", "r", "t", "b", "s"])

    out = []
    for k, x in enumerate(with_file(spark, path, rows, kinds).collect()):  # headers only
        with problem(path, f"record {k}"):
            out.append(_field(spark, path, list(x.i), list(x.r), list(x.t), x.b, x.s))
    return out


def save_nimrod(grid: Grid, path: str, **_) -> None:
    """One field of 32-bit floats, rows as they are."""
    x, y = grid.coord(axis="x", is_dim=True), grid.coord(axis="y", is_dim=True)
    if len(grid.dims) != 2:
        raise GridError("a record has two dimensions")
    ints, reals, missing = [UNSET] * INTS, [float(UNSET)] * REALS, -32768.0
    time = next((c for c in grid.coords if c.name() == "time" and not c.dims), None)
    minutes = int(round(float(time.with_units("hours since 1970-01-01").points) * 60)) if time is not None else 0
    stamp = [*(int(v) for v in civil_from_days(minutes // 1440, "standard")), minutes % 1440 // 60, minutes % 60]
    ints[VALID : VALID + 6], ints[ISSUED : ISSUED + 5] = [*stamp, 0], stamp
    ints[KIND], ints[WIDTH], ints[ROWS], ints[COLS], ints[CODE] = 0, 4, len(y.points), len(x.points), int(grid.attributes.get("field_code", 0))
    ints[GRID] = GEOGRAPHIC if x.units.startswith("degree") else NATIONAL
    ints[CORNER] = (0 if y.points[0] > y.points[-1] else 1) + (0 if x.points[-1] > x.points[0] else 2)
    for at, value in ((NORTH, y.points[0]), (ROW_STEP, abs(y.points[1] - y.points[0])), (EAST, x.points[0]), (COLUMN_STEP, abs(x.points[1] - x.points[0])), (MISSING, missing)):
        reals[at] = float(value)
    text = f"{grid.units[:8]:<8}{str(grid.attributes.get('source', ''))[:24]:<24}{grid.name()[:24]:<24}".encode("latin-1", "replace")
    head = np.array(ints, ">i2").tobytes() + np.array(reals, ">f4").tobytes() + np.full(MORE_REALS, UNSET, ">f4").tobytes() + text + np.full(MORE_INTS, UNSET, ">i2").tobytes()
    size = 4 * grid.size
    with created(grid.spark, path) as stream:
        stream.write(struct.pack(">i", HEADER) + head + struct.pack(">ii", HEADER, size))
        for piece in slabs(grid, [*y.dims, *x.dims], ">f4", missing):
            stream.write(piece)
        stream.write(struct.pack(">i", size))


add_format(Format(6, "NIMROD", lambda p, b: b[:4] == struct.pack(">i", HEADER), load_nimrod))
add_writer("nimrod", save_nimrod)

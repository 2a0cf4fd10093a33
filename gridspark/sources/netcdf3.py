"""Classic netCDF files (CDF-1 and CDF-2), read and written in pure Python, as fields.

Headers and coordinates are read by a task and sent to the driver; cells are
read by byte ranges dealt out over tasks. Files are written a slab at a time.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..frame import Coord, Grid, GridError, index, monotonic
from ..functions.axes import axis_of
from .bytesio import created, slabs, with_file, with_spans
from .store import Format, add_format, add_writer

# The types and tags of the classic format.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
FILLS = {1: -127, 3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36}


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    kind: int
    attributes: dict
    begin: int
    size: int
    record: bool = False


@dataclass
class Header:
    dims: dict[str, int] = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    records: int = 0
    record_size: int = 0


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        self.wide = data[3] == 2

    def number(self) -> int:
        (x,) = struct.unpack_from(">i", self.data, self.at)
        self.at += 4
        return x

    def offset(self) -> int:
        if not self.wide:
            return self.number()
        (x,) = struct.unpack_from(">q", self.data, self.at)
        self.at += 8
        return x

    def text(self) -> str:
        n = self.number()
        out = self.data[self.at : self.at + n].decode()
        self.at += n + (-n % 4)
        return out

    def attributes(self) -> dict:
        tag, n = self.number(), self.number()
        if tag not in (0, ATTRIBUTE):
            raise GridError("broken attribute list")
        out = {}
        for _ in range(n):
            name, kind, count = self.text(), self.number(), self.number()
            dtype = np.dtype(KINDS[kind])
            size = dtype.itemsize * count
            raw = self.data[self.at : self.at + size]
            self.at += size + (-size % 4)
            values = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, dtype).tolist()
            out[name] = values if kind == 2 or len(values) != 1 else values[0]
        return out


def read_header(data: bytes) -> Header:
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise GridError("no classic netCDF file")
    r, out = _Reader(data), Header()
    out.records = r.number()
    r.number()
    names = []
    for _ in range(r.number()):
        name = r.text()
        names.append(name)
        out.dims[name] = r.number()
    unlimited = [n for n in names if out.dims[n] == 0]
    out.attributes = r.attributes()
    r.number()
    for _ in range(r.number()):
        name = r.text()
        dims = tuple(names[r.number()] for _ in range(r.number()))
        attributes, kind, size, begin = r.attributes(), r.number(), r.number(), r.offset()
        out.variables[name] = Variable(name, dims, kind, attributes, begin, size, bool(dims) and dims[0] in unlimited)
    for n in unlimited:
        out.dims[n] = out.records
    own = [v for v in out.variables.values() if v.record]
    out.record_size = sum(v.size for v in own) if len(own) > 1 else (_slice_bytes(out, own[0]) if own else 0)
    return out


def _slice_bytes(h: Header, v: Variable) -> int:
    shape = [h.dims[d] for d in v.dims[1:]] if v.record else [h.dims[d] for d in v.dims]
    return int(np.prod(shape, dtype=np.int64)) * np.dtype(KINDS[v.kind]).itemsize


def spans(h: Header, v: Variable, cells: int = 1 << 20) -> list[tuple[int, int, int]]:
    """(first cell in the variable's order, begin, bytes) of stretches of at most ``cells`` cells."""
    width = np.dtype(KINDS[v.kind]).itemsize
    inner = _slice_bytes(h, v) // width
    rows = h.records if v.record else 1
    return [(r * inner + k, v.begin + r * h.record_size + k * width, min(cells, inner - k) * width) for r in range(rows) for k in range(0, inner, cells)]


def decoded(raw: bytes, v: Variable) -> np.ndarray:
    """Stored bytes as values: packed ones unpacked, fills masked."""
    dtype = np.dtype(KINDS[v.kind])
    a = np.frombuffer(raw, dtype, len(raw) // dtype.itemsize)
    if v.kind == 2:
        return a
    fill = v.attributes.get("_FillValue", v.attributes.get("missing_value", FILLS.get(v.kind)))
    mask = np.zeros(a.shape, bool) if fill is None else a == np.asarray(fill, dtype)
    out = a.astype(dtype.newbyteorder("="))
    if "scale_factor" in v.attributes or "add_offset" in v.attributes:
        out = out * float(v.attributes.get("scale_factor", 1)) + float(v.attributes.get("add_offset", 0))
    return np.ma.array(out, mask=mask) if mask.any() else out


def read_array(data: bytes, h: Header, v: Variable, first: int | None = None, last: int | None = None) -> np.ndarray:
    """A variable's values, or those of a range of its leading dimension."""
    return array_through(lambda begin, size: data[begin : begin + size], h, v)[first:last]


def array_through(read, h: Header, v: Variable) -> np.ndarray:
    """A variable's values, read by ``read(begin, size)``."""
    raw = b"".join(read(begin, size) for _, begin, size in spans(h, v))
    return decoded(raw, v).reshape([h.dims[d] for d in v.dims])


def header_through(read, size: int) -> Header:
    """The header, from as much of the file's begin as it takes."""
    take = 1 << 16
    while True:
        try:
            return read_header(read(0, min(take, size)))
        except (struct.error, ValueError, IndexError, KeyError):
            if take >= size:
                raise
            take *= 8


def _helpers(h: Header) -> set[str]:
    """Variables that describe others: bounds, auxiliary coordinates, measures, ancillaries."""
    out: set[str] = set()
    for v in h.variables.values():
        a = v.attributes
        out.update([a.get("bounds"), *str(a.get("coordinates", "")).split(), *str(a.get("cell_measures", "")).replace(":", " ").split()[1::2], *str(a.get("ancillary_variables", "")).split()])
    return {n for n in out if n in h.variables}


def describe_file(spark: SparkSession, path: str) -> tuple[Header, dict[str, np.ndarray]]:
    """The header and the arrays of all coordinates, read by a task; no data variable reaches the driver."""

    def rows(read, size):
        h = header_through(read, size)
        small = {n: array_through(read, h, v) for n, v in h.variables.items() if n in h.dims or n in _helpers(h) or not v.dims}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((h, small))], pa.binary())], names=["b"])

    return pickle.loads(with_file(spark, path, rows, "b binary").head()[0])


def _coord(h: Header, arrays: dict[str, np.ndarray], v: Variable, dims: tuple[str, ...], axis: bool) -> Coord:
    a = v.attributes
    points = arrays[v.name]
    if v.kind == 2:
        points = np.array([b"".join(row).decode().rstrip("\0 ") for row in points.reshape(-1, points.shape[-1])]).reshape(points.shape[:-1])
        dims = dims[:-1]
    bounds = None
    if a.get("bounds") in h.variables:
        bounds = np.asarray(arrays[a["bounds"]])
    points = np.asarray(points)
    extra = {k: x for k, x in a.items() if k not in ("standard_name", "long_name", "units", "bounds", "calendar", "axis")}
    c = Coord(standard_name=a.get("standard_name"), long_name=a.get("long_name"), var_name=v.name, units=a.get("units", "1"), calendar=a.get("calendar", "standard"), points=points, bounds=bounds, dims=dims, is_dim=axis and points.dtype.kind in "iuf" and monotonic(points), attributes=extra)
    if c.is_dim and axis_of(c) == "x" and c.modulus and len(points) > 1 and np.isclose(abs(points[-1] - points[0]) + abs(points[1] - points[0]), c.modulus):
        from dataclasses import replace

        c = replace(c, circular=True)
    return c


def load_netcdf3(spark: SparkSession, path: str, constraints: list | None = None) -> list[Grid]:
    """One field for each data variable; names that no constraint can match are skipped before any cell is read."""
    h, arrays = describe_file(spark, path)
    helpers = _helpers(h)
    wanted = [c.name for c in constraints or [] if c.name is not None]
    out = []
    for v in h.variables.values():
        if v.name in helpers or v.name in h.dims or not v.dims or v.kind == 2:
            continue
        a = v.attributes
        if constraints and len(wanted) == len(constraints) and not set(wanted) & {v.name, a.get("standard_name"), a.get("long_name")}:
            continue
        dims = {d: h.dims[d] for d in v.dims}
        coords = [_coord(h, arrays, h.variables[d], (d,), True) for d in v.dims if d in h.variables]
        for name in str(a.get("coordinates", "")).split():
            if name in h.variables and set(h.variables[name].dims[: len(h.variables[name].dims) - (h.variables[name].kind == 2)]) <= set(dims):
                coords.append(_coord(h, arrays, h.variables[name], h.variables[name].dims, False))
        keep = {k: x for k, x in a.items() if k not in ("standard_name", "long_name", "units", "coordinates", "_FillValue", "missing_value", "scale_factor", "add_offset", "cell_measures", "ancillary_variables", "cell_methods")}
        out.append(Grid(df=_cells(spark, path, h, v, dims), dims=dims, coords=tuple(coords), standard_name=a.get("standard_name"), long_name=a.get("long_name"), var_name=v.name, units=a.get("units", "1"), attributes={**h.attributes, **keep}))
    return out


def _cells(spark: SparkSession, path: str, h: Header, v: Variable, dims: dict[str, int]) -> DataFrame:
    """The cells of a variable, lazily."""
    keys, shape = [index(d) for d in dims], tuple(dims.values())

    def rows(first: int, raw: bytes):
        part = np.ma.asarray(decoded(raw, v).astype(float))
        at = np.unravel_index(np.arange(first, first + len(part)), shape)
        values = pa.array(part.filled(0.0), mask=np.ma.getmaskarray(part))
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in at), values], names=[*keys, "v"])

    return with_spans(spark, path, spans(h, v), rows, ", ".join([*(f"`{k}` int" for k in keys), "v double"]))


# Writing.


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw + bytes(-len(raw) % 4)


def _attributes(items: dict) -> bytes:
    if not items:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", ATTRIBUTE, len(items))
    for name, value in items.items():
        if isinstance(value, str):
            raw, kind, n = value.encode(), 2, len(value.encode())
        else:
            a = np.atleast_1d(np.asarray(value))
            a = a.astype(">i4") if a.dtype.kind in "iub" else a.astype(">f8")
            raw, kind, n = a.tobytes(), CODES[a.dtype.str[1:]], len(a)
        out += _text(name) + struct.pack(">ii", kind, n) + raw + bytes(-len(raw) % 4)
    return out


def pieces(grid: Grid) -> Iterator[bytes]:
    """A field as the bytes of a CDF-2 file: the header, the coordinates, then the cells a slab at a time."""
    names, dims = [], dict(grid.dims)
    arrays: dict[str, tuple[tuple[str, ...], np.ndarray, dict]] = {}
    for c in grid.coords:
        if c.points.dtype.kind not in "iuf":
            continue
        name = c.dims[0] if c.is_dim else (c.var_name or c.name()).replace(" ", "_")
        own = {k: v for k, v in (("standard_name", c.standard_name), ("long_name", c.long_name), ("units", c.units)) if v}
        if " since " in c.units:
            own["calendar"] = c.calendar
        if c.bounds is not None:
            k = c.bounds.shape[-1]
            dims[f"bnds{k}"] = k
            own["bounds"] = f"{name}_bnds"
            arrays[f"{name}_bnds"] = ((*c.dims, f"bnds{k}"), c.bounds, {})
        arrays[name] = (c.dims, c.points, own)
        if not c.is_dim:
            names.append(name)
    own = {k: v for k, v in (("standard_name", grid.standard_name), ("long_name", grid.long_name), ("units", grid.units), ("coordinates", " ".join(names))) if v}
    order = list(dims)
    head = b"CDF\2" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSION, len(order)) + b"".join(_text(d) + struct.pack(">i", dims[d]) for d in order)
    head += _attributes({k: v for k, v in grid.attributes.items() if isinstance(v, (str, int, float))})
    packed = {n: (d, a.astype(">i4" if a.dtype.kind in "iu" and a.size and np.abs(a).max() < 2**31 else ">f8"), x) for n, (d, a, x) in arrays.items()}
    table = [(n, d, CODES[a.dtype.str[1:]], a.nbytes, x) for n, (d, a, x) in packed.items()]
    table.append(((grid.var_name or grid.name()).replace(" ", "_"), tuple(grid.dims), CODES["f8"], 8 * grid.size, own | {"_FillValue": FILLS[6]}))

    def variables(begins: dict[str, int]) -> bytes:
        out = struct.pack(">ii", VARIABLE, len(table))
        for n, d, kind, size, x in table:
            out += _text(n) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", order.index(k)) for k in d) + _attributes(x)
            out += struct.pack(">iI", kind, min(size + (-size % 4), 2**32 - 1)) + struct.pack(">q", begins.get(n, 0))
        return out

    at, begins = len(head) + len(variables({})), {}
    for n, _, _, size, _ in table:
        begins[n] = at
        at += size + (-size % 4)
    yield head + variables(begins)
    for _, a, _ in packed.values():
        yield a.tobytes() + bytes(-a.nbytes % 4)
    yield from slabs(grid, list(grid.dims), ">f8", FILLS[6])


def to_bytes(grid: Grid) -> bytes:
    return b"".join(pieces(grid))


def save_netcdf3(grid: Grid, path: str, **_) -> None:
    with created(grid.spark, path) as stream:
        for piece in pieces(grid):
            stream.write(piece)


def header_facts(spark: SparkSession, path: str) -> DataFrame:
    """Name, kind and shape of every variable, as a table."""
    h, _ = describe_file(spark, path)
    return spark.createDataFrame([(v.name, KINDS[v.kind], [h.dims[d] for d in v.dims]) for v in h.variables.values()], "name string, kind string, shape array<int>")


add_format(Format(6, "netCDF classic", lambda p, b: b[:3] == b"CDF" and b[3:4] in (b"\1", b"\2"), load_netcdf3, wants_constraints=True))
add_writer("nc", save_netcdf3)

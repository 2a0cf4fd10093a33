"""The data model: a field over named dimensions as a DataFrame of cells plus small coordinates.

A :class:`Grid` holds one row a cell: an INT index for each dimension
(``i_<dim>``) and the value ``v``. A NULL value is a masked cell, and so is an
absent row, so sparse and dense layouts mean the same. Coordinates live on
the driver as arrays (they are as long as a dimension, never as long as the
data) and become broadcast tables of a checked size only where a plan needs
them. Everything on the DataFrame is lazy.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .units import Unit, to_seconds

#: Cells up to which a side of a join is broadcast (a cell is an index or two and a double).
BROADCAST_CELLS = 1_000_000


class GridError(ValueError):
    """A request that the data model doesn't allow."""


def index(dim: str) -> str:
    return f"i_{dim}"


@dataclass(frozen=True)
class Named:
    standard_name: str | None = None
    long_name: str | None = None
    var_name: str | None = None
    units: str = "1"
    attributes: dict[str, Any] = field(default_factory=dict)

    def name(self, default: str = "unknown") -> str:
        return self.standard_name or self.long_name or self.var_name or default

    def matches(self, name: str) -> bool:
        return name in (self.standard_name, self.long_name, self.var_name)


@dataclass(frozen=True)
class CellMethod:
    method: str
    coords: tuple[str, ...] = ()
    intervals: tuple[str, ...] = ()
    comments: tuple[str, ...] = ()

    def __str__(self) -> str:
        return ", ".join(self.coords) + f": {self.method}"


@dataclass(frozen=True)
class Coord(Named):
    """Labels over none, one or more dimensions. ``bounds`` has one trailing axis more than ``points``.

    ``role``: coord, measure or ancillary. ``is_dim``: the dimension's own
    axis; then the points are numeric, strictly monotonic and never masked.
    """

    points: np.ndarray = None
    bounds: np.ndarray | None = None
    dims: tuple[str, ...] = ()
    is_dim: bool = False
    circular: bool = False
    climatological: bool = False
    coord_system: Any = None
    calendar: str = "standard"
    role: str = "coord"

    def __post_init__(self):
        points = np.asarray(self.points)
        object.__setattr__(self, "points", points)
        if self.bounds is not None:
            bounds = np.asarray(self.bounds)
            if bounds.shape[:-1] != points.shape:
                raise GridError(f"bounds {bounds.shape} don't fit points {points.shape}")
            object.__setattr__(self, "bounds", bounds)
        if points.ndim != len(self.dims):
            raise GridError(f"coordinate {self.name()} has {points.ndim} axes for dimensions {self.dims}")
        if self.is_dim:
            if points.ndim != 1 or points.dtype.kind not in "iuf":
                raise GridError("a dimension coordinate is numeric with one axis")
            if not monotonic(points):
                raise GridError(f"the points of {self.name()} aren't strictly monotonic")

    @property
    def modulus(self) -> float | None:
        return {"degrees": 360.0, "degree": 360.0, "degrees_east": 360.0, "radians": 2 * np.pi}.get(self.units)

    def cells(self) -> list[Cell]:
        return [Cell(p, None if self.bounds is None else tuple(b)) for p, b in zip(self.points.ravel(), self.points.ravel() if self.bounds is None else self.bounds.reshape(-1, self.bounds.shape[-1]))]

    def with_units(self, units: str) -> Coord:
        scale, shift = Unit.parse(self.units).linear(Unit.parse(units))
        return replace(self, points=self.points * scale + shift, bounds=None if self.bounds is None else self.bounds * scale + shift, units=units)

    def seconds(self) -> np.ndarray:
        """Whole seconds since 1970 of a time coordinate."""
        return to_seconds(self.points, self.units, self.calendar)

    def same_axis(self, other: Coord) -> bool:
        return self.name() == other.name() and self.units == other.units and equal_points(self, other)

    def guess_bounds(self, position: float = 0.5, monthly: bool = False, yearly: bool = False) -> Coord:
        from .functions.axes import guessed_bounds

        return replace(self, bounds=guessed_bounds(self, position, monthly, yearly))

    @staticmethod
    def regular(zeroth: float, step: float, count: int, dim: str, with_bounds: bool = False, **names) -> Coord:
        """Points ``zeroth + step * (1 … count)``."""
        points = zeroth + step * np.arange(1, count + 1)
        bounds = np.stack([points - step / 2, points + step / 2], axis=1) if with_bounds else None
        return Coord(points=points, bounds=bounds, dims=(dim,), is_dim=count > 0 and step != 0, **names)


@dataclass(frozen=True)
class Cell:
    """A point with optional bounds; comparing with a number or date means containment."""

    point: Any
    bound: tuple | None = None

    def contains(self, x) -> bool:
        return self.point == x if self.bound is None else min(self.bound) <= x <= max(self.bound)

    def __eq__(self, other):
        if isinstance(other, Cell):
            return self.point == other.point and self.bound == other.bound
        return bool(other == self.point) if hasattr(other, "_compare_parts") and self.bound is None else self.contains(other)

    def __hash__(self):
        return hash((self.point, self.bound))

    def _low(self):
        return self.point if self.bound is None else min(self.bound)

    def _high(self):
        return self.point if self.bound is None else max(self.bound)

    def __gt__(self, other):
        return self.point > other.point if isinstance(other, Cell) else self._low() > other

    def __le__(self, other):
        return self.point <= other.point if isinstance(other, Cell) else self._low() <= other

    def __lt__(self, other):
        return self.point < other.point if isinstance(other, Cell) else self._high() < other

    def __ge__(self, other):
        return self.point >= other.point if isinstance(other, Cell) else self._high() >= other

    def __mod__(self, m):
        return Cell(self.point % m, None if self.bound is None else tuple(b % m for b in self.bound))

    def __add__(self, x):
        return Cell(self.point + x, None if self.bound is None else tuple(b + x for b in self.bound))


def monotonic(points: np.ndarray) -> bool:
    if len(points) < 2:
        return True
    d = np.diff(points)
    return bool(np.all(d > 0) or np.all(d < 0))


def equal_points(a: Coord, b: Coord) -> bool:
    if a.points.shape != b.points.shape or (a.bounds is None) != (b.bounds is None):
        return False
    return bool(np.array_equal(a.points, b.points)) and (a.bounds is None or bool(np.array_equal(a.bounds, b.bounds)))


@dataclass(frozen=True)
class Grid(Named):
    """One field. ``dims`` maps each dimension, in order, to its length."""

    df: DataFrame = None
    dims: dict[str, int] = field(default_factory=dict)
    coords: tuple[Coord, ...] = ()
    cell_methods: tuple[CellMethod, ...] = ()
    derived: tuple[Any, ...] = ()

    # Building.

    @staticmethod
    def from_table(df: DataFrame, axes: dict[str, Sequence | np.ndarray], value: str | Column, dense: bool = False, limit: int = 1_000_000, source: DataFrame | None = None, outside: str = "error", **names) -> Grid:
        """A grid from a table with one column for each axis.

        ``axes`` maps a dimension (and column) to its points; without points
        (None) the distinct values are read from ``source`` (``df`` itself by
        default; name the table below an aggregate to read one column of it),
        at most ``limit`` of them. A row beside the points given (a new value,
        or null) stops the plan when it runs, or is left out if ``outside`` is
        "drop". Repeated cells are an error of the caller, found by
        :meth:`repeated_cells`. ``dense`` adds a masked row for every cell that
        has none.
        """
        if outside not in ("error", "drop"):
            raise GridError("rows beside the points are an error or dropped")
        spark, coords, dims = df.sparkSession, [], {}
        out = df.withColumn("v", (F.col(value) if isinstance(value, str) else value).cast("double"))
        found = _distinct(df if source is None else source, [d for d, p in axes.items() if p is None], limit)
        for dim, points in axes.items():
            strict = points is not None and outside == "error"
            points = np.asarray(found[dim] if points is None else points)
            numeric = points.dtype.kind in "iuf"
            coords.append(Coord(long_name=dim, points=points, dims=(dim,), is_dim=numeric and monotonic(points)))
            dims[dim] = len(points)
            kind = "double" if points.dtype.kind == "f" else "long" if numeric else df.schema[dim].dataType.simpleString()
            table = local_table(spark, [(p, i) for i, p in enumerate(points.tolist())], f"`_p` {kind}, `{index(dim)}` int")
            out = out.join(sized(table, len(points)), F.col(f"`{dim}`") == F.col("_p"), "left" if strict else "inner").drop("_p")
            if strict:
                lost = F.raise_error(F.concat(F.lit(f"axis {dim} has no point "), F.coalesce(F.col(f"`{dim}`").cast("string"), F.lit("null")))).cast("int")
                out = out.withColumn(index(dim), F.when(F.col(f"`{index(dim)}`").isNull(), lost).otherwise(F.col(f"`{index(dim)}`")))
        out = out.select(*(index(d) for d in dims), "v")
        grid = Grid(df=out, dims=dims, coords=tuple(coords), **names)
        return grid.dense() if dense else grid

    def with_df(self, df: DataFrame, **changes) -> Grid:
        return replace(self, df=df, **changes)

    def named(self, name: str) -> Grid:
        return replace(self, standard_name=None, long_name=name, var_name=None)

    # Looking things up.

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.dims.values())

    @property
    def size(self) -> int:
        return int(np.prod(list(self.dims.values()), dtype=object)) if self.dims else 1

    def keys(self, without: Iterable[str] = ()) -> list[str]:
        gone = set(without)
        return [index(d) for d in self.dims if d not in gone]

    def find(self, name: str | Coord | None = None, role: str | None = None, dims: tuple[str, ...] | None = None, is_dim: bool | None = None, axis: str | None = None) -> list[Coord]:
        """Coordinates by name, role, dimensions, kind or axis (x, y, z, t)."""
        from .functions.axes import axis_of

        out = []
        for c in self.coords:
            if name is not None and not (c.same_axis(name) if isinstance(name, Coord) else c.matches(name)):
                continue
            if role is not None and c.role != role or dims is not None and c.dims != tuple(dims) or is_dim is not None and c.is_dim != is_dim:
                continue
            if axis is not None and axis_of(c) != axis.lower():
                continue
            out.append(c)
        return out

    def coord(self, name: str | Coord | None = None, **how) -> Coord:
        found = self.find(name, **how)
        if len(found) != 1:
            raise GridError(f"{len(found)} coordinates match {name.name() if isinstance(name, Coord) else name!r} {how or ''}")
        return found[0]

    def dim_coord(self, dim: str) -> Coord | None:
        return next((c for c in self.coords if c.is_dim and c.dims == (dim,)), None)

    def dims_of(self, names: str | Coord | Iterable[str | Coord]) -> list[str]:
        """The dimensions, in order, that coordinates (or dimensions by name) span."""
        names = [names] if isinstance(names, (str, Coord)) else list(names)
        own: set[str] = set()
        for n in names:
            found = self.find(n)
            if not found and isinstance(n, str) and n in self.dims:
                own.add(n)
                continue
            own.update(self.coord(n).dims)
        return [d for d in self.dims if d in own]

    # Editing components.

    def with_coord(self, coord: Coord) -> Grid:
        for d, n in zip(coord.dims, coord.points.shape):
            if self.dims.get(d) != n:
                raise GridError(f"{coord.name()} has {n} points on {d}, which has {self.dims.get(d)}")
        if coord.is_dim and self.dim_coord(coord.dims[0]):
            raise GridError(f"{coord.dims[0]} has a dimension coordinate already")
        if any(c.name() == coord.name() and c.role == coord.role for c in self.coords):
            raise GridError(f"there is a {coord.role} {coord.name()} already")
        return replace(self, coords=(*self.coords, coord))

    def without_coord(self, name: str | Coord) -> Grid:
        gone = self.coord(name)
        return replace(self, coords=tuple(c for c in self.coords if c is not gone))

    def replace_coord(self, coord: Coord) -> Grid:
        old = [c for c in self.coords if c.name() == coord.name() and c.role == coord.role]
        if len(old) != 1:
            raise GridError(f"{len(old)} coordinates are called {coord.name()}")
        return replace(self, coords=tuple(coord if c is old[0] else c for c in self.coords))

    # Content.

    def dense(self) -> Grid:
        """An explicit row for every cell."""
        cells = None
        for d, n in self.dims.items():
            axis = self.spark.range(n).select(F.col("id").cast("int").alias(index(d)))
            cells = axis if cells is None else cells.crossJoin(axis)
        return self if cells is None else self.with_df(cells.join(self.df, self.keys(), "left"))

    def repeated_cells(self) -> DataFrame:
        """Cells that have more than one row."""
        return self.df.groupBy(*self.keys()).count().where("count > 1")

    def labelled(self, *names: str, value: str | None = None) -> DataFrame:
        """Long form: a column for each coordinate named (all one-axis dimension coordinates by default), then the value."""
        out = self.df
        wanted = [self.coord(n) for n in names] if names else [c for c in (self.dim_coord(d) or next(iter(self.find(dims=(d,))), None) for d in self.dims) if c is not None]
        for c in wanted:
            out = join_table(out, self, c, c.name())
        return out.select(*(f"`{c.name()}`" for c in wanted), F.col("v").alias(value or self.name("v")))

    def convert_units(self, units: str) -> Grid:
        scale, shift = Unit.parse(self.units).linear(Unit.parse(units))
        return replace(self, df=self.df.withColumn("v", F.col("v") * F.lit(scale) + F.lit(shift)), units=units)

    def equals(self, other: Grid) -> bool:
        """Same metadata, coordinates and cells; masked cells equal masked cells."""
        if (self.name(), self.units, self.attributes, self.dims, self.cell_methods) != (other.name(), other.units, other.attributes, other.dims, other.cell_methods):
            return False
        if len(self.coords) != len(other.coords) or any(not any(c.same_axis(o) and c.dims == o.dims for o in other.coords) for c in self.coords):
            return False
        own, theirs = self.df.where("v is not null"), other.df.where("v is not null").select(*self.df.columns)
        return own.exceptAll(theirs).isEmpty() and theirs.exceptAll(own).isEmpty()

    def is_compatible(self, other: Grid, ignore: Iterable[str] = ()) -> bool:
        """Same name, units, cell methods and common attributes."""
        common = (set(self.attributes) & set(other.attributes)) - set(ignore)
        return self.name() == other.name() and self.units == other.units and self.cell_methods == other.cell_methods and all(self.attributes[k] == other.attributes[k] for k in common)

    def fingerprint(self) -> tuple[int, int]:
        """(unmasked cells, an order-free 64-bit checksum), one aggregate over the cells."""
        row = self.df.where("v is not null").agg(F.count("*"), F.sum(F.xxhash64(*self.keys(), "v").cast("decimal(38,0)"))).head()
        return row[0], int(row[1] or 0) & (1 << 64) - 1

    def describe(self) -> dict:
        """Names, shape, coordinates and cell methods, as JSON-ready values."""
        return {
            "name": self.name(), "units": self.units, "dims": dict(self.dims), "attributes": {k: str(v) for k, v in sorted(self.attributes.items())}, "cell_methods": [str(m) for m in self.cell_methods],
            "coords": [{"name": c.name(), "role": c.role, "units": c.units, "dims": list(c.dims), "dim": c.is_dim, "bounds": c.bounds is not None} for c in self.coords],
        }

    def summary(self) -> str:
        axes = "; ".join(f"{d}: {n}" for d, n in self.dims.items())
        return f"{self.name()} / ({self.units})  ({axes or 'scalar'})"

    def __repr__(self) -> str:
        return f"<Grid {self.summary()}>"

    def describe_json(self) -> str:
        return json.dumps(self.describe(), sort_keys=True)

    # Operators, as methods.

    def _maths(self, name: str, *args, **kw):
        from .operators import maths

        return getattr(maths, name)(self, *args, **kw)

    def __add__(self, other):
        return self._maths("add", other)

    __radd__ = __add__

    def __sub__(self, other):
        return self._maths("subtract", other)

    def __rsub__(self, other):
        return self._maths("subtract", other) * -1

    def __mul__(self, other):
        return self._maths("multiply", other)

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self._maths("divide", other)

    def __rtruediv__(self, other):
        return self._maths("exponentiate", -1) * other

    def __pow__(self, power):
        return self._maths("exponentiate", power)

    def __neg__(self):
        return self * -1

    def __abs__(self):
        return self._maths("absolute")

    def __getitem__(self, keys):
        from .operators.subset import take

        return take(self, keys)

    def extract(self, constraint):
        from .operators.subset import extract

        return extract(self, constraint)

    def collapsed(self, coords, aggregator, **kw):
        from .operators.reduce import collapsed

        return collapsed(self, coords, aggregator, **kw)

    def aggregated_by(self, coords, aggregator, **kw):
        from .operators.reduce import aggregated_by

        return aggregated_by(self, coords, aggregator, **kw)

    def rolling_window(self, coord, aggregator, window, **kw):
        from .operators.reduce import rolling_window

        return rolling_window(self, coord, aggregator, window, **kw)

    def interpolate(self, points, scheme):
        from .operators.interpolate import interpolate

        return interpolate(self, points, scheme)

    def regrid(self, target, scheme):
        return scheme.regrid(self, target)


def _distinct(df: DataFrame, columns: list[str], limit: int) -> dict[str, list]:
    """The sorted distinct values of several columns, in one pass; nulls left out."""
    if not columns:
        return {}
    entries = [F.struct(F.lit(k).alias("k"), *(F.when(F.lit(j == k), F.col(f"`{c}`")).alias(f"x{j}") for j, c in enumerate(columns))) for k, _ in enumerate(columns)]
    rows = df.select(*(f"`{c}`" for c in columns)).select(F.explode(F.array(*entries)).alias("e")).select("e.*").distinct().limit(len(columns) * (limit + 1)).collect()
    out: dict[str, list] = {c: [] for c in columns}
    for r in rows:
        if r[1 + r[0]] is not None:
            out[columns[r[0]]].append(r[1 + r[0]])
    for c, values in out.items():
        if len(values) > limit:
            raise GridError(f"axis {c} has more than {limit} points")
        values.sort()
    return out


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table the plan holds itself, so its size is known to the optimiser; ``schema`` in simple DDL."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[n.strip("`") for n, _ in fields]))


def sized(df: DataFrame, cells: int) -> DataFrame:
    """A broadcast hint where the known number of rows allows it; else the optimiser decides."""
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


def coord_table(grid: Grid, coord: Coord, column: str, bounds: bool = False) -> DataFrame:
    """A coordinate as a table: its dimensions' indices, points, and lo and hi where asked."""
    shape = coord.points.shape
    where = np.indices(shape).reshape(len(shape), -1).tolist() if shape else []
    kind = {"f": "double", "i": "long", "u": "long", "b": "boolean"}.get(coord.points.dtype.kind, "string")
    values = coord.points.ravel().tolist()
    schema = "".join(f"`{index(d)}` int, " for d in coord.dims) + f"`{column}` {kind}"
    cols = [*where, values]
    if bounds:
        b = coord.bounds.reshape(-1, coord.bounds.shape[-1]).astype(float)
        cols += [b.min(axis=1).tolist(), b.max(axis=1).tolist()]
        schema += f", `{column}_lo` double, `{column}_hi` double"
    return local_table(grid.spark, list(zip(*cols)), schema)


def join_table(df: DataFrame, grid: Grid, coord: Coord, column: str, bounds: bool = False) -> DataFrame:
    """``df`` with a coordinate's points as a column."""
    table = coord_table(grid, coord, column, bounds)
    if not coord.dims:
        return df.crossJoin(F.broadcast(table))  # one row
    return df.join(sized(table, coord.points.size), [index(d) for d in coord.dims])

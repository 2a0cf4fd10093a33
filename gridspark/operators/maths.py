"""Field arithmetic: alignment by shared coordinates, units, then one join and one expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..frame import Coord, Grid, GridError, index, join_table, sized
from ..units import Unit, UnitError
from .shape import clear_identity

#: Elementwise functions by name: expression and what becomes of the units.
UNARY: dict[str, Callable[[Column], Column]] = {
    "absolute": F.abs, "exp": F.exp, "log": F.ln, "log2": F.log2, "log10": F.log10, "sqrt": F.sqrt, "square": lambda v: v * v, "negative": lambda v: -v, "sign": F.signum,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "ceil": lambda v: F.ceil(v).cast("double"), "floor": lambda v: F.floor(v).cast("double"), "rint": F.rint, "degrees": F.degrees, "radians": F.radians,
    "isnan": lambda v: F.isnan(v).cast("double"), "reciprocal": lambda v: F.try_divide(F.lit(1.0), v), "cbrt": F.cbrt, "expm1": F.expm1, "log1p": F.log1p, "trunc": lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"),
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": F.try_divide, "power": F.pow, "maximum": F.greatest, "minimum": F.least,
    "arctan2": F.atan2, "hypot": F.hypot, "fmod": lambda a, b: F.try_mod(a, b), "remainder": lambda a, b: F.pmod(a, b),
}


def resolved(a: Grid, b: Grid) -> dict[str, str]:
    """b's dimensions as a's: by equal axes, then by equal auxiliary coordinates, then by name or the one length left."""
    out: dict[str, str] = {}

    def pair(mine: Coord, theirs: Coord) -> None:
        if not np.array_equal(mine.points, theirs.points):
            raise GridError(f"the points of {mine.name()} differ")
        if mine.bounds is not None and theirs.bounds is not None and not np.array_equal(mine.bounds, theirs.bounds):
            raise GridError(f"the bounds of {mine.name()} differ")
        out[theirs.dims[0]] = mine.dims[0]

    for dims_only in (True, False):
        for theirs in b.coords:
            if len(theirs.dims) != 1 or theirs.dims[0] in out or theirs.is_dim != dims_only or theirs.role != "coord":
                continue
            for mine in a.coords:
                if len(mine.dims) == 1 and mine.name() == theirs.name() and mine.units == theirs.units and mine.dims[0] not in out.values():
                    if mine.points.shape == theirs.points.shape:
                        pair(mine, theirs)
                    elif dims_only:
                        raise GridError(f"the lengths of {mine.name()} differ")
                    break
    for d, n in b.dims.items():
        if d in out:
            continue
        free = [x for x, k in a.dims.items() if x not in out.values() and k == n]
        if d in free:
            out[d] = d
        elif len(free) == 1:
            out[d] = free[0]
        else:
            raise GridError(f"dimension {d} matches none of {a.name()}")
    return out


def _metadata(a: Grid, b: Grid | None, units: str) -> Grid:
    """The result's metadata: common attributes, coordinates of the first that the second doesn't contradict."""
    out = clear_identity(a)
    coords = [c for c in a.coords if c.role == "coord"]
    if b is not None:
        out = replace(out, attributes={k: v for k, v in a.attributes.items() if b.attributes.get(k) == v})
        clash = {c.name() for c in b.coords if not c.dims and any(x.name() == c.name() and not x.dims and not x.same_axis(c) for x in a.coords)}
        coords = [c for c in coords if c.name() not in clash]
        coords += [c for c in b.coords if not c.dims and c.role == "coord" and not a.find(c.name()) and c.name() not in clash]
    return replace(out, units=units, coords=tuple(coords))


def binary(a: Grid, other, op: Callable[[Column, Column], Column], units: str, dim: str | None = None) -> Grid:
    """``op`` on matching cells of a field and a field, coordinate, array or number.

    The lower-rank field is joined on its own dimensions, broadcast where its
    size allows; a cell masked on either side is masked.
    """
    if isinstance(other, (int, float, np.number)):
        return _metadata(a, None, units).with_df(a.df.withColumn("v", op(F.col("v"), F.lit(float(other)))))
    if isinstance(other, np.ndarray):
        dims = tuple(a.dims)[len(a.dims) - other.ndim :]
        other = Coord(long_name="array", points=other, dims=dims)
    if isinstance(other, str):
        other = a.coord(other)
    if isinstance(other, Coord):
        if dim is not None:
            other = replace(other, dims=(dim,))
        df = join_table(a.df, a, other, "_o")
        return _metadata(a, None, units).with_df(df.withColumn("v", op(F.col("v"), F.col("_o").cast("double"))).select(*a.df.columns))
    b: Grid = other
    swap = len(b.dims) > len(a.dims)
    big, small = (b, a) if swap else (a, b)
    names = resolved(big, small)
    right = small.df.select(*(F.col(index(d)).alias(index(names[d])) for d in small.dims), F.col("v").alias("_o"))
    on = [index(names[d]) for d in small.dims]
    df = big.df.join(sized(right, small.size), on) if on else big.df.crossJoin(F.broadcast(right))  # a scalar field has one row
    x, y = (F.col("_o"), F.col("v")) if swap else (F.col("v"), F.col("_o"))
    out = df.withColumn("v", op(x, y)).select(*big.df.columns)
    made = _metadata(big, small, units)
    if swap:
        made = replace(made, attributes={k: v for k, v in a.attributes.items() if b.attributes.get(k) == v})
    return made.with_df(out)


def _units_of(other) -> Unit:
    return Unit.parse(other.units) if isinstance(other, (Grid, Coord)) else Unit.parse("1")


def _added(a: Grid, other, op, dim) -> Grid:
    if isinstance(other, str):
        other = a.coord(other)
    if isinstance(other, (Grid, Coord)) and not Unit.parse(a.units).same(_units_of(other)):
        raise UnitError(f"units {a.units!r} and {other.units!r} differ")
    return binary(a, other, BINARY[op], a.units, dim)


def add(a: Grid, other, dim: str | None = None) -> Grid:
    return _added(a, other, "add", dim)


def subtract(a: Grid, other, dim: str | None = None) -> Grid:
    return _added(a, other, "subtract", dim)


def multiply(a: Grid, other, dim: str | None = None) -> Grid:
    other = a.coord(other) if isinstance(other, str) else other
    units = a.units if not isinstance(other, (Grid, Coord)) else (Unit.parse(a.units) * _units_of(other)).symbol()
    return binary(a, other, BINARY["multiply"], units, dim)


def divide(a: Grid, other, dim: str | None = None) -> Grid:
    """Division by zero masks the cell."""
    other = a.coord(other) if isinstance(other, str) else other
    units = a.units if not isinstance(other, (Grid, Coord)) else (Unit.parse(a.units) / _units_of(other)).symbol()
    return binary(a, other, BINARY["divide"], units, dim)


def exponentiate(a: Grid, power: float) -> Grid:
    units = a.units if power == 1 else (Unit.parse(a.units) ** power).symbol()
    body = F.try_divide(F.lit(1.0), F.col("v")) if power == -1 else F.pow(F.col("v"), F.lit(float(power)))
    return _metadata(a, None, units).with_df(a.df.withColumn("v", body))


def unary(a: Grid, name: str, units: str) -> Grid:
    return _metadata(a, None, units).with_df(a.df.withColumn("v", UNARY[name](F.col("v"))))


def absolute(a: Grid) -> Grid:
    return unary(a, "absolute", a.units)


def exp(a: Grid) -> Grid:
    return unary(a, "exp", "1")


def log(a: Grid) -> Grid:
    """Natural logarithm; cells at or below zero become masked."""
    return unary(a, "log", f"ln(re 1 {a.units})")


def log2(a: Grid) -> Grid:
    return unary(a, "log2", f"lb(re 1 {a.units})")


def log10(a: Grid) -> Grid:
    return unary(a, "log10", f"lg(re 1 {a.units})")


def apply_function(a: Grid, function: str | Callable, other=None, units: str | None = None, name: str | None = None) -> Grid:
    """A named elementwise function, or a NumPy function of one or two arrays, run on Arrow batches."""
    units = a.units if units is None else units
    if isinstance(function, str):
        made = unary(a, function, units) if other is None else binary(a, other, BINARY[function], units)
    else:
        if other is None:

            @pandas_udf("double")
            def run(x: pd.Series) -> pd.Series:
                return pd.Series(function(x.to_numpy(float))).where(x.notna())

            made = _metadata(a, None, units).with_df(a.df.withColumn("v", run(F.col("v"))))
        else:

            @pandas_udf("double")
            def run2(x: pd.Series, y: pd.Series) -> pd.Series:
                return pd.Series(function(x.to_numpy(float), y.to_numpy(float))).where(x.notna() & y.notna())

            made = binary(a, other, run2, units)
    return made.named(name) if name else made


class FieldFunction:
    """A data function with a units function, to be applied to fields like a method."""

    def __init__(self, data: Callable | str, units: Callable[..., str]):
        self.data, self.units = data, units

    def __call__(self, a: Grid, other=None, name: str | None = None) -> Grid:
        units = self.units(a) if other is None else self.units(a, other)
        return apply_function(a, self.data, other, units, name)


#: Cells of a series that one task of a running function takes.
RUN = 4096


def cumulative(a: Grid, coord: str, kind: str = "sum") -> Grid:
    """Running sum, minimum or maximum along a coordinate's dimension, missing cells skipped.

    A series longer than ``RUN`` runs block by block; what the blocks before
    give is run over one row a block and added to the cells.
    """
    from pyspark.sql import Window

    (d,) = a.dims_of(coord)
    col, others, of = index(d), a.keys([d]), getattr(F, kind)
    if a.dims[d] <= RUN:
        frame = Window.partitionBy(*others).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
        return a.with_df(a.df.withColumn("v", F.when(F.col("v").isNotNull(), of("v").over(frame))))
    cells = a.df.where("v is not null").withColumn("_run", F.expr(f"`{col}` div {RUN}"))
    inside = Window.partitionBy(*others, "_run").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*others).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.groupBy(*others, "_run").agg(of("v").alias("_all")).withColumn("_before", of("_all").over(earlier)).drop("_all")
    own = cells.withColumn("v", of("v").over(inside)).join(before, [*others, "_run"])
    joined = F.col("v") + F.coalesce("_before", F.lit(0.0)) if kind == "sum" else (F.least if kind == "min" else F.greatest)(F.col("v"), F.coalesce("_before", F.col("v")))
    return a.with_df(own.select(*a.keys(), joined.alias("v")))


def coord_maths(c: Coord, op: str, other: float | Coord) -> Coord:
    """Points and bounds of a coordinate with a number or another coordinate."""
    f = {"add": np.add, "subtract": np.subtract, "multiply": np.multiply, "divide": np.true_divide}[op]
    x = other.points if isinstance(other, Coord) else other
    bounds = None if c.bounds is None else f(c.bounds, (other.bounds if isinstance(other, Coord) and other.bounds is not None else np.asarray(x)[..., None] if isinstance(other, Coord) else x))
    units = c.units
    if isinstance(other, Coord) and op in ("multiply", "divide"):
        units = (Unit.parse(c.units) * Unit.parse(other.units) if op == "multiply" else Unit.parse(c.units) / Unit.parse(other.units)).symbol()
    points = f(c.points, x)
    from ..frame import monotonic

    return replace(c, points=points, bounds=bounds, units=units, is_dim=c.is_dim and monotonic(points))

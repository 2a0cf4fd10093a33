"""Constraints, indexing, range selection on modular axes, masks.

Predicates are evaluated on the coordinates' arrays; the cells then get an
index filter, a range where the kept cells are contiguous, so it reaches the
scan. Only scattered selections need a (broadcast) table of kept indices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Cell, Coord, Grid, GridError, index, join_table, local_table, monotonic, sized


def _taken(c: Coord, picks: dict[str, np.ndarray], dropped: set[str]) -> Coord:
    points, bounds = c.points, c.bounds
    for axis, d in enumerate(c.dims):
        if d in picks:
            points = points.take(picks[d], axis=axis)
            bounds = None if bounds is None else bounds.take(picks[d], axis=axis)
    axes = tuple(k for k, d in enumerate(c.dims) if d in dropped)
    points = points.squeeze(axis=axes) if axes else points
    bounds = None if bounds is None else bounds.squeeze(axis=axes) if axes else bounds
    dims = tuple(d for d in c.dims if d not in dropped)
    whole = all(len(picks[d]) == c.points.shape[k] for k, d in enumerate(c.dims) if d in picks)
    return replace(c, points=points, bounds=bounds, dims=dims, is_dim=c.is_dim and bool(dims) and monotonic(points), circular=c.circular and whole)


def take_indices(grid: Grid, picks: dict[str, np.ndarray], dropped: Iterable[str] = ()) -> Grid:
    """Keep the listed indices of each dimension, in that order; ``dropped`` dimensions keep one and go."""
    df, dims, gone = grid.df, dict(grid.dims), set(dropped)
    picks = {d: np.arange(grid.dims[d])[p] for d, p in picks.items()}
    for d, p in picks.items():
        col, n = index(d), len(p)
        steps = set(np.diff(p).tolist())
        dims[d] = n
        if n and (len(steps) < 2) and (n == 1 or 0 not in steps):
            step = steps.pop() if steps else 1
            low, high = int(min(p[0], p[-1])), int(max(p[0], p[-1]))
            if not (step == 1 and n == grid.dims[d]):
                df = df.where(F.col(col).between(low, high))
            if abs(step) > 1:
                df = df.where(F.pmod(F.col(col) - int(p[0]), F.lit(abs(step))) == 0)
            df = df.withColumn(col, ((F.col(col) - int(p[0])) / step).cast("int") if step != 1 else F.col(col) - int(p[0]))
        else:
            table = local_table(grid.spark, [(int(o), k) for k, o in enumerate(p)], f"`{col}` int, _new int")
            df = df.join(sized(table, n), col).drop(col).withColumnRenamed("_new", col)
    for d in gone:
        if dims.pop(d) != 1:
            raise GridError(f"{d} doesn't have one cell")
    df = df.select(*(index(d) for d in dims), "v")
    return replace(grid, df=df, dims=dims, coords=tuple(_taken(c, picks, gone) for c in grid.coords))


def take(grid: Grid, keys) -> Grid:
    """Orthogonal indexing: an integer drops its dimension; slices, lists, boolean arrays keep theirs."""
    keys = keys if isinstance(keys, tuple) else (keys,)
    if Ellipsis in [k for k in keys if k is Ellipsis]:
        at = next(i for i, k in enumerate(keys) if k is Ellipsis)
        keys = (*keys[:at], *[slice(None)] * (len(grid.dims) - len(keys) + 1), *keys[at + 1 :])
    if len(keys) > len(grid.dims):
        raise GridError("more indices than dimensions")
    picks, dropped = {}, []
    for d, k in zip(grid.dims, keys):
        if isinstance(k, (int, np.integer)):
            if not -grid.dims[d] <= k < grid.dims[d]:
                raise IndexError(f"{k} is out of range for {d}")
            picks[d] = np.array([k])
            dropped.append(d)
        elif not (isinstance(k, slice) and k == slice(None)):
            picks[d] = k if isinstance(k, slice) else np.asarray(k)
    return take_indices(grid, picks, dropped)


def reverse(grid: Grid, names: str | Iterable[str]) -> Grid:
    return take_indices(grid, {d: np.arange(grid.dims[d])[::-1] for d in grid.dims_of(names)})


# Constraints.


class Constraint:
    """A field's name, a test of the field, and tests of its coordinates' cells; ``&`` combines."""

    def __init__(self, name: str | None = None, cube_func: Callable[[Grid], bool] | None = None, coord_values: dict[str, Any] | None = None, **more):
        self.name, self.cube_func, self.tests = name, cube_func, {**(coord_values or {}), **more}

    def masks(self, grid: Grid) -> dict[str, np.ndarray] | None:
        """Kept cells of each dimension that is tested, or None where the field doesn't match."""
        if self.name is not None and not grid.matches(self.name) and grid.name() != self.name or self.cube_func and not self.cube_func(grid):
            return None
        out: dict[str, np.ndarray] = {}
        for name, test in self.tests.items():
            found = grid.find(name)
            if len(found) != 1:
                return None
            c = found[0]
            if len(c.dims) > 1:
                raise GridError(f"{name} spans several dimensions")
            hit = np.array([_passes(cell, test) for cell in _test_cells(c)], bool)
            if not c.dims:
                if not hit[0]:
                    return None
                continue
            d = c.dims[0]
            out[d] = out[d] & hit if d in out else hit
        return out

    def __and__(self, other: Constraint) -> Constraint:
        return _Both(self, other)


class _Both(Constraint):
    def __init__(self, a: Constraint, b: Constraint):
        self.a, self.b = a, b

    def masks(self, grid):
        x, y = self.a.masks(grid), self.b.masks(grid)
        if x is None or y is None:
            return None
        return {d: x[d] & y[d] if d in x and d in y else x.get(d, y.get(d)) for d in {*x, *y}}


class AttributeConstraint(Constraint):
    """All attributes equal their value or pass their test; a missing one fails."""

    def __init__(self, **attributes):
        super().__init__(cube_func=lambda g: all(k in g.attributes and (v(g.attributes[k]) if callable(v) else g.attributes[k] == v) for k, v in attributes.items()))


class NameConstraint(Constraint):
    """Names by kind: a value, a test, or None for unset."""

    def __init__(self, **names):
        if set(names) - {"standard_name", "long_name", "var_name", "STASH"}:
            raise GridError("names are standard_name, long_name, var_name and STASH")

        def check(g: Grid) -> bool:
            own = {"standard_name": g.standard_name, "long_name": g.long_name, "var_name": g.var_name, "STASH": g.attributes.get("STASH")}
            return all(v(own[k]) if callable(v) and own[k] is not None else own[k] == v for k, v in names.items())

        super().__init__(cube_func=check)


def _test_cells(c: Coord) -> list[Cell]:
    if " since " in c.units:
        base = datetime(1970, 1, 1)
        return [Cell(base + timedelta(seconds=int(s))) for s in np.atleast_1d(c.seconds())]
    return c.cells()


def _passes(cell: Cell, test) -> bool:
    if callable(test) and not isinstance(test, PartialDateTime):
        return bool(test(cell))
    if isinstance(test, (list, tuple, set, frozenset, np.ndarray)):
        return any(_passes(cell, t) for t in test)
    if isinstance(test, PartialDateTime):
        return test == cell.point
    if isinstance(test, Cell):
        return cell == test
    return cell.contains(test) if not isinstance(cell.point, str) else cell.point == test


@dataclass(frozen=True)
class PartialDateTime:
    """A date with parts left open; compares with dates over the parts that are given."""

    year: int | None = None
    month: int | None = None
    day: int | None = None
    hour: int | None = None
    minute: int | None = None
    second: int | None = None
    microsecond: int | None = None

    def _compare_parts(self, other):
        if isinstance(other, Cell):
            other = other.point
        if isinstance(other, PartialDateTime):
            raise TypeError("partial dates have no order among themselves")
        own = [(v, getattr(other, k)) for k, v in self.__dict__.items() if v is not None]
        return [a for a, _ in own], [b for _, b in own]

    def __eq__(self, other):
        if isinstance(other, PartialDateTime):
            return self.__dict__ == other.__dict__
        a, b = self._compare_parts(other)
        return a == b

    def __hash__(self):
        return hash(tuple(self.__dict__.values()))

    def __lt__(self, other):
        a, b = self._compare_parts(other)
        return a < b

    def __le__(self, other):
        a, b = self._compare_parts(other)
        return a <= b

    def __gt__(self, other):
        a, b = self._compare_parts(other)
        return a > b

    def __ge__(self, other):
        a, b = self._compare_parts(other)
        return a >= b


def between(low, high, low_inclusive: bool = True, high_inclusive: bool = True) -> Callable:
    """A test for cells in a range."""

    def check(cell) -> bool:
        x = cell.point if isinstance(cell, Cell) else cell
        return (low <= x if low_inclusive else low < x) and (x <= high if high_inclusive else x < high)

    return check


def extract(grid: Grid, constraint: Constraint | str | None) -> Grid | None:
    """The part of a field that a constraint keeps, or None; a single kept cell drops its dimension."""
    if constraint is None:
        return grid
    constraint = Constraint(constraint) if isinstance(constraint, str) else constraint
    masks = constraint.masks(grid)
    if masks is None or any(not m.any() for m in masks.values()):
        return None
    masks = {d: np.flatnonzero(m) for d, m in masks.items() if not m.all() or len(m) == 1}
    return take_indices(grid, masks, [d for d, m in masks.items() if len(m) == 1])


def extract_all(grids: Iterable[Grid], constraints) -> list[Grid]:
    """Every match of every constraint."""
    grids, constraints = list(grids), constraints if isinstance(constraints, (list, tuple)) else [constraints]
    return [g for c in constraints for g in (extract(x, c) for x in grids) if g is not None]


def extract_one(grids: Iterable[Grid], constraint) -> Grid:
    found = extract_all(grids, constraint)
    if len(found) != 1:
        raise GridError(f"{len(found)} fields match where one should")
    return found[0]


def extract_each(grids: Iterable[Grid], constraints: list) -> list[Grid]:
    """Exactly one match for each constraint."""
    grids = list(grids)
    return [extract_one(grids, c) for c in constraints]


def subset(grid: Grid, coord: Coord) -> Grid | None:
    """The cells that equal one of another coordinate's cells."""
    own = grid.coord(coord.name())
    keep = {(float(p), *(map(float, b) if b is not None else ())) for p, b in zip(np.atleast_1d(coord.points), coord.bounds if coord.bounds is not None else [None] * coord.points.size)}
    mine = [(float(p), *(map(float, b) if b is not None else ())) for p, b in zip(np.atleast_1d(own.points), own.bounds if own.bounds is not None else [None] * own.points.size)]
    hit = np.array([m in keep for m in mine])
    if not hit.any():
        return None
    if not own.dims:
        return grid
    return take_indices(grid, {own.dims[0]: np.flatnonzero(hit)})


def extract_overlapping(grids: list[Grid], names: str | list[str]) -> list[Grid]:
    """Each field cut to the cells of the named coordinates that all fields have."""
    names = [names] if isinstance(names, str) else names
    for name in names:
        shared = set.intersection(*(set(np.atleast_1d(g.coord(name).points).tolist()) for g in grids))
        grids = [take_indices(g, {g.coord(name).dims[0]: np.flatnonzero(np.isin(g.coord(name).points, sorted(shared)))}) for g in grids]
    return grids


@dataclass(frozen=True)
class Extent:
    """A range of a coordinate, as an argument of :func:`intersect_all`."""

    name: str
    minimum: float
    maximum: float
    min_inclusive: bool = True
    max_inclusive: bool = True


def intersect_all(grid: Grid, *extents: Extent, ignore_bounds: bool = False, threshold: float = 0.0) -> Grid:
    """The ranges of several modular coordinates, one after another."""
    for e in extents:
        grid = intersection(grid, e.name, e.minimum, e.maximum, e.min_inclusive, e.max_inclusive, ignore_bounds, threshold)
    return grid


#: Share of the period within which two places on a modular axis are one.
SEAM = 1e-9


def _turns(lo: np.ndarray, hi: np.ndarray, extent: Extent, period: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each interval [lo, hi] the number of whole periods that brings it into the range, and whether any does.

    An interval meets the range after k periods for at most two neighbouring
    k: with its upper part at the range's begin, or with its lower part at the
    end. Both are solved for; the first counts unless it has no more than the
    touching end in common and the second has more.
    """
    near = SEAM * period
    first = np.ceil((extent.minimum - hi) / period - SEAM)
    met, shared = [], []
    for turns in (first, first + 1):
        a, b = lo + turns * period, hi + turns * period
        begins = b >= extent.minimum - near if extent.min_inclusive else b > extent.minimum + near
        ends = a <= extent.maximum + near if extent.max_inclusive else a < extent.maximum - near
        common = np.minimum(b, extent.maximum) - np.maximum(a, extent.minimum)
        met.append(begins & ends & (common >= threshold * (hi - lo) - near))
        shared.append(common)
    later = met[1] & (~met[0] | ((shared[0] <= near) & (shared[1] > near)))
    return first + later, met[0] | met[1]


def intersection(grid: Grid, name: str, minimum: float, maximum: float, min_inclusive: bool = True, max_inclusive: bool = True, ignore_bounds: bool = False, threshold: float = 0.0) -> Grid:
    """The range [minimum, maximum] of a modular axis, wrapped and put in contiguous order.

    A point counts where it lies in the range after some whole number of
    periods; a cell with bounds counts where it shares ``threshold`` of its
    width at least with the range. A cell that the range's seam splits is
    placed at the lower end if it shares enough there.
    """
    c = grid.coord(name)
    period = c.modulus
    if period is None:
        raise GridError(f"{name} has no modulus")
    if maximum - minimum > period * (1 + SEAM):
        raise GridError("the range is wider than the modulus")
    p = c.points.astype(float)
    lo, hi = (p, p) if c.bounds is None or ignore_bounds else (c.bounds.min(axis=-1).astype(float), c.bounds.max(axis=-1).astype(float))
    whole = p if c.bounds is None else c.bounds
    if np.ptp(whole) > period * (1 + SEAM):
        raise GridError("the axis is wider than the modulus")
    turns, kept = _turns(lo, hi, Extent(name, minimum, maximum, min_inclusive, max_inclusive), period, threshold)
    if not kept.any():
        raise GridError("nothing lies in the range")
    moved = replace(c, points=p + turns * period, bounds=None if c.bounds is None else c.bounds + (turns * period)[:, None], is_dim=False, circular=False)
    picks = np.flatnonzero(kept)
    if c.is_dim:
        rising = 1 if len(p) < 2 or p[1] > p[0] else -1
        picks = picks[np.argsort(rising * moved.points[picks], kind="stable")]
    out = take_indices(replace(grid, coords=tuple(moved if x is c else x for x in grid.coords)), {c.dims[0]: picks})
    return replace(out, coords=tuple(replace(x, is_dim=c.is_dim and monotonic(x.points)) if x.name() == c.name() and x.dims == c.dims else x for x in out.coords))


# Masks.


def mask_where(grid: Grid, where: Grid | Coord | Callable) -> Grid:
    """Cells masked where a boolean field, a boolean coordinate or a predicate over ``v`` is true."""
    if isinstance(where, Grid):
        marks = where.df.withColumnRenamed("v", "_m")
        df = grid.df.join(sized(marks, where.size), where.keys(), "left")
        return grid.with_df(df.withColumn("v", F.when(F.coalesce(F.col("_m") == 0, F.lit(True)), F.col("v"))).drop("_m").select(*grid.df.columns))
    if isinstance(where, Coord):
        df = join_table(grid.df, grid, where, "_m")
        return grid.with_df(df.withColumn("v", F.when(~F.col("_m").cast("boolean"), F.col("v"))).select(*grid.df.columns))
    return grid.with_df(grid.df.withColumn("v", F.when(~where(F.col("v")), F.col("v"))))


def polygon_problem(polygon: list[tuple[float, float]]) -> str | None:
    """Why a ring of points is no simple polygon, or None."""
    p = [tuple(map(float, q)) for q in polygon]
    p = p[:-1] if len(p) > 1 and p[0] == p[-1] else p
    if len(set(p)) < 3 or len(set(p)) < len(p):
        return "it needs three points or more, all different"
    if not np.all(np.isfinite(p)):
        return "a point isn't finite"

    def side(a, b, c):
        return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    n = len(p)
    for i in range(n):
        a, b = p[i], p[(i + 1) % n]
        for j in range(i + 2, n if i else n - 1):
            c, d = p[j], p[(j + 1) % n]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                return f"edges {i} and {j} cross"
    area = sum(p[k - 1][0] * p[k][1] - p[k][0] * p[k - 1][1] for k in range(n))
    return "it has no area" if area == 0 else None


def polygon_weights(x: Coord, y: Coord, polygon: list[tuple[float, float]]) -> np.ndarray:
    """The share of each cell (y, x) that a polygon covers, by clipping it to the cell; the polygon may be concave."""
    bx, by = (c.bounds if c.bounds is not None else c.guess_bounds().bounds for c in (x, y))

    def clip(points, axis, limit, keep_less):
        out = []
        for k, a in enumerate(points):
            b = points[k - 1]
            ina, inb = (a[axis] <= limit, b[axis] <= limit) if keep_less else (a[axis] >= limit, b[axis] >= limit)
            if ina != inb:
                t = (limit - b[axis]) / (a[axis] - b[axis])
                out.append(tuple(b[i] + t * (a[i] - b[i]) for i in (0, 1)))
            if ina:
                out.append(a)
        return out

    def area(points):
        return abs(sum(points[k - 1][0] * p[1] - p[0] * points[k - 1][1] for k, p in enumerate(points))) / 2

    out = np.zeros((len(by), len(bx)))
    for j, (y0, y1) in enumerate(np.sort(by, axis=1)):
        strip = clip(clip(polygon, 1, y0, False), 1, y1, True)
        for i, (x0, x1) in enumerate(np.sort(bx, axis=1)):
            part = clip(clip(strip, 0, x0, False), 0, x1, True) if strip else []
            out[j, i] = area(part) / ((x1 - x0) * (y1 - y0)) if len(part) > 2 else 0.0
    return out


def geometry_area_weights(grid: Grid, polygon: list[tuple[float, float]], normalize: bool = False) -> Coord:
    """The area (or, normalised, the share) of each cell that a planar polygon covers, as a measure."""
    x, y = grid.coord(axis="x"), grid.coord(axis="y")
    share = polygon_weights(x, y, polygon)
    if not normalize:
        bx, by = (c.bounds if c.bounds is not None else c.guess_bounds().bounds for c in (x, y))
        share = share * np.abs(np.diff(by, axis=1)) * np.abs(np.diff(bx, axis=1)).T
    return Coord(long_name="geometry_area_weights", points=share, dims=(*y.dims, *x.dims), role="measure")


def mask_outside_shape(grid: Grid, polygon: list[tuple[float, float]], minimum_weight: float = 0.0, all_touched: bool = False, invert: bool = False) -> Grid:
    """Mask the cells outside a polygon: covered by less than ``minimum_weight``, or (at 0) whose centre is outside."""
    problem = polygon_problem(polygon)
    if problem:
        raise GridError(f"the shape is invalid: {problem}")
    x, y = grid.coord(axis="x"), grid.coord(axis="y")
    if minimum_weight or all_touched:
        share = polygon_weights(x, y, polygon)
        inside = share >= minimum_weight if minimum_weight else share > 0
    else:
        px, py = np.meshgrid(x.points.astype(float), y.points.astype(float))
        inside = np.zeros(px.shape, bool)
        for k, (x1, y1) in enumerate(polygon):
            x0, y0 = polygon[k - 1]
            if y0 != y1:
                inside ^= ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
    return mask_where(grid, Coord(long_name="outside", points=inside if invert else ~inside, dims=(*y.dims, *x.dims)))


def slices_over(grid: Grid, names: str | list[str]) -> list[Grid]:
    """One field for each index of the named dimensions; for whole-data work group by those indices instead."""
    out = [grid]
    for d in grid.dims_of(names):
        out = [take_indices(g, {d: np.array([k])}, [d]) for g in out for k in range(grid.dims[d])]
    return out


def slices(grid: Grid, names: str | list[str]) -> list[Grid]:
    """Fields that span just the named coordinates."""
    kept = grid.dims_of(names)
    return slices_over(grid, [d for d in grid.dims if d not in kept]) if len(kept) < len(grid.dims) else [grid]


def izip(*grids: Grid) -> DataFrame:
    """Matching cells of several fields: an equi-join on the dimensions they share."""
    out = None
    for k, g in enumerate(grids):
        own = g.df.withColumnRenamed("v", f"v{k}")
        out = own if out is None else out.join(sized(own, g.size), [c for c in g.keys() if c in out.columns])
    return out

"""Regridding onto another field's x and y axes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import BROADCAST_CELLS, Coord, Grid, GridError, index, local_table, monotonic, sized
from ..functions import projections
from ..functions.systems import CoordSystem, GeogCS, RotatedGeogCS
from .interpolate import Linear, Nearest, Weights, apply_weights

def _xy(grid: Grid) -> tuple[Coord, Coord]:
    return grid.coord(axis="x", is_dim=True), grid.coord(axis="y", is_dim=True)


def _moved(grid: Grid, df: DataFrame, sx: Coord, sy: Coord, tx: Coord, ty: Coord) -> Grid:
    dx, dy = sx.dims[0], sy.dims[0]
    sizes = {dx: len(tx.points), dy: len(ty.points)}
    coords = [c for c in grid.coords if not set(c.dims) & {dx, dy}]
    coords += [replace(tx, dims=(dx,)), replace(ty, dims=(dy,))]
    return replace(grid, df=df, dims={d: sizes.get(d, n) for d, n in grid.dims.items()}, coords=tuple(coords))


def rectilinear(grid: Grid, target: Grid, scheme: Linear | Nearest) -> Grid:
    """Linear or nearest samples at every target point."""
    (sx, sy), (tx, ty) = _xy(grid), _xy(target)
    axes = {sx.dims[0]: scheme.weights(sx, tx.with_units(sx.units).points), sy.dims[0]: scheme.weights(sy, ty.with_units(sy.units).points)}
    return _moved(grid, apply_weights(grid, axes), sx, sy, tx, ty)


def overlap_weights(source: np.ndarray, target: np.ndarray, spherical: bool = False, modulus: float | None = None) -> tuple[Weights, np.ndarray]:
    """The share of each target interval that each source interval covers; and whether sources cover a target wholly.

    ``spherical`` measures latitudes by their sines. A modulus lets sources
    repeat on both sides.
    """
    s, t = np.sort(np.asarray(source, float), axis=1), np.sort(np.asarray(target, float), axis=1)
    own = np.arange(len(s))
    if modulus:
        s, own = np.concatenate([s - modulus, s, s + modulus]), np.tile(own, 3)
    rank = np.argsort(s[:, 0], kind="stable")
    s, own = s[rank], own[rank]
    measure = (lambda x: np.sin(np.radians(np.clip(x, -90, 90)))) if spherical else (lambda x: x)
    first = np.searchsorted(np.maximum.accumulate(s[:, 1]), t[:, 0], side="right")
    last = np.searchsorted(s[:, 0], t[:, 1], side="left")
    rows: list[tuple[int, int, float]] = []
    covered = np.zeros(len(t))
    for k, (a, b) in enumerate(zip(first, last)):
        lo, hi = np.maximum(s[a:b, 0], t[k, 0]), np.minimum(s[a:b, 1], t[k, 1])
        share = (measure(hi) - measure(lo)) / (measure(t[k, 1]) - measure(t[k, 0]))
        for i, w in zip(own[a:b].tolist(), share.tolist()):
            if w > 0:
                rows.append((i, k, w))
                covered[k] += w
    src, tgt, w = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return Weights(src, tgt, w, len(t)), np.isclose(covered, 1.0, rtol=0, atol=1e-9)


@dataclass(frozen=True)
class AreaWeighted:
    """Conservative: the mean over the overlap of cells.

    A target cell is masked if more than ``mdtol`` of its area is missing, or
    if it doesn't lie wholly inside the source.
    """

    mdtol: float = 1.0

    def regrid(self, grid: Grid, target: Grid) -> Grid:
        (sx, sy), (tx, ty) = _xy(grid), _xy(target)
        for c in (sx, sy, tx, ty):
            if c.bounds is None:
                raise GridError(f"{c.name()} needs bounds")
        sphere = sy.name().endswith("latitude") and sy.units.startswith("degree")
        wx, inx = overlap_weights(sx.bounds, tx.with_units(sx.units).bounds, False, sx.modulus if sx.circular else None)
        wy, iny = overlap_weights(sy.bounds, ty.with_units(sy.units).bounds, sphere)
        dx, dy = sx.dims[0], sy.dims[0]
        wx, wy = (Weights(w.source[ok[w.target]], w.target[ok[w.target]], w.weight[ok[w.target]], w.targets) for w, ok in ((wx, inx), (wy, iny)))
        df = grid.df.join(wx.table(grid, dx, "x"), index(dx)).drop(index(dx)).withColumnRenamed("_t_x", index(dx))
        df = df.join(wy.table(grid, dy, "y"), index(dy)).drop(index(dy)).withColumnRenamed("_t_y", index(dy))
        w = F.col("_w_x") * F.col("_w_y")
        there = F.sum(F.when(F.col("v").isNotNull(), w))
        out = df.groupBy(*grid.keys()).agg(F.when(there > 1 - max(self.mdtol, 1e-8), F.sum(w * F.col("v")) / there).alias("v"))
        return _moved(grid, out, sx, sy, tx, ty)


def cell_number(x: Column, edges: np.ndarray) -> Column:
    """Which cell [edge k, edge k + 1) of ascending edges holds x; null outside. A balanced tree of comparisons, or arithmetic on even edges."""
    e = np.asarray(edges, float)
    n = len(e) - 1
    step = np.diff(e)
    inside = (x >= F.lit(float(e[0]))) & (x < F.lit(float(e[-1])))
    if n > 64 and np.allclose(step, step[0], rtol=1e-12, atol=0):
        return F.when(inside, F.least(F.lit(n - 1), F.floor((x - float(e[0])) / float(step[0])).cast("int")))

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(float(e[mid])), search(lo, mid)).otherwise(search(mid, hi))

    return F.when(inside, search(0, n))


def bin_points(points: DataFrame, x: str, y: str, value: str | Column, x_edges: np.ndarray, y_edges: np.ndarray, weight: Column | None = None) -> DataFrame:
    """A table of scattered points as (i_y, i_x, v): the weighted mean in each cell; empty cells have no row."""
    w = F.lit(1.0) if weight is None else weight
    v = F.col(value) if isinstance(value, str) else value
    own = points.select(cell_number(F.col(y).cast("double"), y_edges).alias("i_y"), cell_number(F.col(x).cast("double"), x_edges).alias("i_x"), v.cast("double").alias("v"), w.cast("double").alias("_w"))
    own = own.where("i_y is not null and i_x is not null and v is not null")
    return own.groupBy("i_y", "i_x").agg(F.try_divide(F.sum(F.col("_w") * F.col("v")), F.sum("_w")).alias("v"))


@dataclass(frozen=True)
class PointInCell:
    """The weighted mean of the source points that fall into each target cell; empty cells are masked.

    The source's x and y lie on one or two common dimensions. Ascending cells
    are [low, high), descending ones [upper, lower).
    """

    weights: np.ndarray | None = None

    def regrid(self, grid: Grid, target: Grid) -> Grid:
        tx, ty = _xy(target)
        sx = next(c for c in grid.find(axis="x") if not c.is_dim or len(grid.find(axis="x")) == 1)
        sy = next(c for c in grid.find(axis="y") if not c.is_dim or len(grid.find(axis="y")) == 1)
        if sx.dims != sy.dims:
            raise GridError("source x and y lie on different dimensions")
        tx = tx if tx.bounds is not None else tx.guess_bounds()
        ty = ty if ty.bounds is not None else ty.guess_bounds()
        x = sx.points.astype(float)
        if sx.modulus:
            low = tx.bounds.min()
            x = (x - low) % sx.modulus + low
        kx, ky = self._cells(x.ravel(), tx.bounds), self._cells(sy.points.astype(float).ravel(), ty.bounds)
        w = np.ones(x.size) if self.weights is None else np.asarray(self.weights, float).ravel()
        at = np.indices(sx.points.shape).reshape(len(sx.dims), -1)
        ok = (kx >= 0) & (ky >= 0)
        dx, dy = tx.dims[0], ty.dims[0]
        rows = list(zip(*(a[ok].tolist() for a in at), ky[ok].tolist(), kx[ok].tolist(), w[ok].tolist()))
        table = local_table(grid.spark, rows, ", ".join([*(f"`{index(d)}` int" for d in sx.dims), "_y int, _x int, _w double"]))
        left = {d: n for d, n in grid.dims.items() if d not in sx.dims}
        df = grid.df.join(sized(table, len(rows)), [index(d) for d in sx.dims]).where("v is not null")
        mean = F.try_divide(F.sum(F.col("_w") * F.col("v")), F.sum("_w"))
        out = df.groupBy(*(index(d) for d in left), F.col("_y").alias(index(dy)), F.col("_x").alias(index(dx))).agg(mean.alias("v"))
        coords = [c for c in grid.coords if not set(c.dims) & set(sx.dims)] + [ty, tx]
        return replace(grid, df=out, dims={**left, dy: len(ty.points), dx: len(tx.points)}, coords=tuple(coords))

    @staticmethod
    def _cells(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        down = bounds[0].mean() > bounds[-1].mean() if len(bounds) > 1 else bounds[0, 0] > bounds[0, 1]
        b = np.sort(bounds, axis=1)
        order = np.argsort(b[:, 0], kind="stable")
        side = "left" if down else "right"
        k = np.searchsorted(b[order, 0], x, side=side) - 1
        good = (k >= 0) & ((x <= b[order, 1][np.maximum(k, 0)]) if down else (x < b[order, 1][np.maximum(k, 0)]))
        return np.where(good, order[np.maximum(k, 0)], -1)


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=-1)


def _plane(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([x, y], axis=-1)


class Buckets:
    """Points in cubic buckets, for nearest points without comparing all pairs.

    A bucket is as wide as points are apart on average. Rings of buckets
    round a wanted place are looked through until the next ring is further
    away than the best point; ties go to the lowest index. Places that
    ``RINGS`` rings don't settle, far from all points, are compared with all.
    """

    RINGS = 4

    def __init__(self, points: np.ndarray):
        self.points = np.asarray(points, float)
        low, high = self.points.min(axis=0), self.points.max(axis=0)
        spread = np.maximum(high - low, 1e-12)
        self.width = float(max(spread.max() / max(1.0, np.sqrt(len(self.points))), 1e-9))
        self.low = low
        cells = self._cells(self.points)
        self.sizes = cells.max(axis=0) + 1
        keys = self._keys(cells)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.starts = np.unique(keys[self.order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(keys)]

    def _cells(self, x: np.ndarray) -> np.ndarray:
        return np.floor((x - self.low) / self.width).astype(np.int64)

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        out = cells[:, 0]
        for k in range(1, cells.shape[1]):
            out = out * self.sizes[k] + cells[:, k]
        return out

    def nearest(self, wanted: np.ndarray) -> np.ndarray:
        wanted = np.asarray(wanted, float)
        best, at = np.full(len(wanted), np.inf), np.full(len(wanted), len(self.points), np.int64)
        cells, left = self._cells(wanted), np.arange(len(wanted))
        for ring in range(self.RINGS + 1):
            sides = np.arange(-ring, ring + 1)
            offsets = np.stack(np.meshgrid(*[sides] * wanted.shape[1], indexing="ij"), axis=-1).reshape(-1, wanted.shape[1])
            for o in offsets[np.abs(offsets).max(axis=1) == ring]:
                near = cells[left] + o
                ok = ((near >= 0) & (near < self.sizes)).all(axis=1)
                own = left[ok]
                keys = self._keys(near[ok])
                place = np.searchsorted(self.keys, keys)
                hit = (place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == keys)
                self._compare(wanted, own[hit], self.starts[place[hit]], self.ends[place[hit]], best, at)
            left = left[~(np.sqrt(best[left]) <= ring * self.width)]
            if not len(left):
                return at
        step = max(1, 4_000_000 // len(self.points))
        for k in range(0, len(left), step):
            own = left[k : k + step]
            far = ((wanted[own, None, :] - self.points) ** 2).sum(axis=-1)
            at[own] = far.argmin(axis=1)
        return at

    def _compare(self, wanted, own, start, end, best, at) -> None:
        """Each wanted place with the points start..end of a bucket."""
        for k in range(int((end - start).max(initial=0))):
            there = start + k < end
            rows, point = own[there], self.order[start[there] + k]
            far = ((wanted[rows] - self.points[point]) ** 2).sum(axis=1)
            better = (far < best[rows]) | ((far == best[rows]) & (point < at[rows]))
            best[rows[better]], at[rows[better]] = far[better], point[better]


@dataclass(frozen=True)
class UnstructuredNearest:
    """The source point nearest to each target point, on the sphere or, ``planar``, in the plane of x and y.

    The source's x and y share one dimension.
    """

    planar: bool = False

    def regrid(self, grid: Grid, target: Grid) -> Grid:
        tx, ty = _xy(target)
        sx, sy = grid.coord(axis="x"), grid.coord(axis="y")
        if sx.dims != sy.dims or len(sx.dims) != 1:
            raise GridError("source x and y lie on one common dimension")
        (d,) = sx.dims
        place = _plane if self.planar else _unit
        points = place(sx.points.astype(float), sy.points.astype(float))
        x, y = tx.points.astype(float), ty.points.astype(float)
        dx, dy, cells = tx.dims[0], ty.dims[0], len(x) * len(y)
        schema = f"`{index(d)}` int, _y int, _x int"
        if len(points) > BROADCAST_CELLS:
            raise GridError(f"more than {BROADCAST_CELLS} source points")  # they are a coordinate, as long as an axis
        shared = grid.spark.sparkContext.broadcast((points, x, y))  # axes

        def find(batches: Iterator) -> Iterator:
            p, x, y = shared.value
            tree = Buckets(p)
            for batch in batches:
                at = batch.column(0).to_numpy()
                j, i = at // len(x), at % len(x)
                yield pa.RecordBatch.from_arrays([pa.array(tree.nearest(place(x[i], y[j])), pa.int32()), pa.array(j, pa.int32()), pa.array(i, pa.int32())], names=[index(d), "_y", "_x"])

        table = grid.spark.range(0, cells, 1, max(1, min(grid.spark.sparkContext.defaultParallelism * 4, cells // 4096))).mapInArrow(find, schema)
        left = {k: n for k, n in grid.dims.items() if k != d}
        out = grid.df.join(sized(table, cells), index(d)).select(*(index(k) for k in left), F.col("_y").alias(index(dy)), F.col("_x").alias(index(dx)), "v")
        coords = [c for c in grid.coords if d not in c.dims] + [ty, tx]
        return replace(grid, df=out, dims={**left, dy: len(ty.points), dx: len(tx.points)}, coords=tuple(coords))


def make_grid(spark, nx: int = 30, ny: int = 20, xlims: tuple[float, float] = (0.0, 360.0), ylims: tuple[float, float] = (-90.0, 90.0), x_points=None, y_points=None) -> Grid:
    """A regular latitude-longitude field of zeros, cells inside the limits."""

    def axis(n, lims, points, name, dim):
        if points is None:
            edges = np.linspace(*lims, n + 1)
            return Coord(standard_name=name, units="degrees", points=(edges[:-1] + edges[1:]) / 2, bounds=np.stack([edges[:-1], edges[1:]], axis=1), dims=(dim,), is_dim=True)
        c = Coord(standard_name=name, units="degrees", points=np.asarray(points, float), dims=(dim,), is_dim=True)
        return c.guess_bounds() if len(c.points) > 1 else c

    x, y = axis(nx, xlims, x_points, "longitude", "longitude"), axis(ny, ylims, y_points, "latitude", "latitude")
    nx, ny = len(x.points), len(y.points)
    df = spark.range(nx * ny).select((F.col("id") / nx).cast("int").alias("i_latitude"), (F.col("id") % nx).cast("int").alias("i_longitude"), F.lit(0.0).alias("v"))
    return Grid(df=df, dims={"latitude": ny, "longitude": nx}, coords=(y, x), long_name="grid_cube")


def _over_cells(spark, nx: int, ny: int, make, schema: str) -> DataFrame:
    """Rows that ``make(j, i)`` gives for the cells of a grid, in batches dealt out over tasks."""
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield make(at // nx, at % nx)

    return spark.range(0, nx * ny, 1, max(1, min(spark.sparkContext.defaultParallelism * 4, nx * ny // 65_536))).mapInArrow(run, schema)


def project(grid: Grid, system: CoordSystem, nx: int | None = None, ny: int | None = None) -> Grid:
    """Nearest samples of a field on a regular grid of another coordinate system that covers it.

    The grid spans the field's points in the new system and has the field's
    shape unless told otherwise; cells that come from outside the field, or
    that the system doesn't show, are masked. Source points and target cells
    are transformed by tasks; only the axes are on the driver.
    """
    sx, sy = _xy(grid)
    own = sx.coord_system or GeogCS(projections.RADIUS)
    x, y = sx.points.astype(float), sy.points.astype(float)
    nx, ny = nx or len(x), ny or len(y)

    def ends(j: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        a, b = projections.transformed(own, system, x[i], y[j])
        there = np.isfinite(a) & np.isfinite(b)
        found = [[f(v[there])] if there.any() else [None] for v in (a, b) for f in (np.min, np.max)]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.float64()) for v in found], names=["x0", "x1", "y0", "y1"])

    x0, x1, y0, y1 = _over_cells(grid.spark, len(x), len(y), ends, "x0 double, x1 double, y0 double, y1 double").agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).head()
    if x0 is None:
        raise GridError("the system shows no point of the field")
    gx, gy = np.linspace(x0, x1, nx), np.linspace(y0, y1, ny)
    ax, ay, low, period = _nearest_axis(sx), _nearest_axis(sy), x.min(), sx.modulus
    dx, dy = sx.dims[0], sy.dims[0]

    def sources(j: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        a, b = projections.transformed(system, own, gx[i], gy[j])
        there = np.isfinite(a) & np.isfinite(b)
        a, b, i, j = a[there], b[there], i[there], j[there]
        a = (a - low) % period + low if period else a
        p, q = ax(a), ay(b)
        ok = (p >= 0) & (q >= 0)
        return pa.RecordBatch.from_arrays([pa.array(v[ok], pa.int32()) for v in (q, p, j, i)], names=[index(dy), index(dx), "_y", "_x"])

    table = _over_cells(grid.spark, nx, ny, sources, f"`{index(dy)}` int, `{index(dx)}` int, _y int, _x int")
    df = grid.df.join(sized(table, nx * ny), [index(dy), index(dx)]).drop(index(dx), index(dy)).withColumnRenamed("_y", index(dy)).withColumnRenamed("_x", index(dx)).select(*grid.keys(), "v")
    names = {GeogCS: ("longitude", "latitude", "degrees"), RotatedGeogCS: ("grid_longitude", "grid_latitude", "degrees")}.get(type(system), ("projection_x_coordinate", "projection_y_coordinate", "m"))
    tx = Coord(standard_name=names[0], units=names[2], points=gx, dims=(dx,), is_dim=monotonic(gx), coord_system=system)
    ty = Coord(standard_name=names[1], units=names[2], points=gy, dims=(dy,), is_dim=monotonic(gy), coord_system=system)
    return _moved(grid, df, sx, sy, tx, ty)


def _nearest_axis(c: Coord):
    """A function from places to the nearest index of an axis, -1 beyond its ends; a circular axis closes."""
    order = np.argsort(c.points.astype(float), kind="stable")
    p = c.points.astype(float)[order]
    if c.circular and c.modulus:
        p, order = np.r_[p, p[0] + c.modulus], np.r_[order, order[0]]
    edges = (p[:-1] + p[1:]) / 2
    slack = 1e-9 * max(1.0, float(np.abs(p).max()))

    def find(x: np.ndarray) -> np.ndarray:
        return np.where((x >= p[0] - slack) & (x <= p[-1] + slack), order[np.searchsorted(edges, x, side="left")], -1)

    return find


def project_rotated(grid: Grid, pole_lon: float, pole_lat: float, nx: int, ny: int) -> Grid:
    """:func:`project` onto a rotated pole."""
    return project(grid, RotatedGeogCS(pole_lat, pole_lon), nx, ny)


def regrid_area_weighted(grid: Grid, target: Grid, mdtol: float = 0.0) -> Grid:
    """Functional form; here any missing part masks by default."""
    return AreaWeighted(mdtol).regrid(grid, target)


def regrid_weighted_points(grid: Grid, weights: np.ndarray, target: Grid) -> Grid:
    """Functional form of :class:`PointInCell` with weights."""
    return PointInCell(weights).regrid(grid, target)


def xy_grids(grid: Grid, corners: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two-axis arrays of x and y at the cells' points, or at the corners of contiguous cells."""
    from ..functions.axes import contiguous_edges

    x, y = _xy(grid)
    return tuple(np.meshgrid(contiguous_edges(x), contiguous_edges(y)) if corners else np.meshgrid(x.points, y.points))

"""Interpolation: small weight tables on the axes, one join each, one weighted sum.

An axis' table holds (source index, target index, weight). Joining the tables
multiplies the weights, and a target cell is masked if a source cell with a
weight is missing: the number of unmasked products must equal the number of
weights, which the tables know.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Coord, Grid, GridError, index, join_table, local_table, monotonic, sized
from ..units import Unit, days_from_civil, reference_seconds

MODES = ("linear", "extrapolate", "error", "nan", "mask", "nanmask")


@dataclass(frozen=True)
class Weights:
    """Sparse axis weights: source, target, weight, with the number of weights of each target."""

    source: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    targets: int

    def table(self, grid: Grid, dim: str, name: str) -> DataFrame:
        counts = np.bincount(self.target, minlength=self.targets)
        rows = list(zip(self.source.tolist(), self.target.tolist(), self.weight.tolist(), counts[self.target].tolist()))
        return sized(local_table(grid.spark, rows, f"`{index(dim)}` int, `_t_{name}` int, `_w_{name}` double, `_k_{name}` int"), len(rows))


def _wrapped(c: Coord, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending points with their indices, a circular axis closed at both ends; and the samples inside its range."""
    p = c.points.astype(float)
    order = np.argsort(p, kind="stable")
    p, at = p[order], order
    if c.circular and c.modulus:
        p, at = np.r_[p, p[0] + c.modulus], np.r_[at, at[0]]
        x = (x - p[0]) % c.modulus + p[0]
    return p, at, x


def _outside(p: np.ndarray, x: np.ndarray, mode: str) -> np.ndarray:
    out = (x < p[0]) | (x > p[-1])
    if mode == "error" and out.any():
        raise GridError("a sample point lies outside the axis")
    return out & (mode not in ("linear", "extrapolate", "error"))


def linear_weights(c: Coord, samples: Sequence[float], mode: str = "linear") -> Weights:
    x = np.asarray(samples, float)
    p, at, x = _wrapped(c, x)
    if len(p) < 2:
        raise GridError(f"{c.name()} has too few points to interpolate")
    out = _outside(p, x, mode)
    low = np.clip(np.searchsorted(p, x, side="right") - 1, 0, len(p) - 2)
    share = (x - p[low]) / (p[low + 1] - p[low])
    return _table(np.r_[at[low], at[low + 1]], np.tile(np.arange(len(x)), 2), np.r_[1 - share, share], out, mode, len(x))


def nearest_weights(c: Coord, samples: Sequence[float], mode: str = "extrapolate") -> Weights:
    """The nearest point; half-way goes to the lower index."""
    p, at, x = _wrapped(c, np.asarray(samples, float))
    out = _outside(p, x, mode)
    if len(p) == 1:
        pick = np.zeros(len(x), int)
    else:
        low = np.clip(np.searchsorted(p, x, side="right") - 1, 0, len(p) - 2)
        share = (x - p[low]) / (p[low + 1] - p[low])
        down = c.points[0] > c.points[-1]
        pick = low + ((share >= 0.5) if down else (share > 0.5))
    return _table(at[pick], np.arange(len(x)), np.ones(len(x)), out, mode, len(x))


def _table(source, target, weight, out: np.ndarray, mode: str, targets: int) -> Weights:
    keep = (weight != 0) & ~out[target]
    source, target, weight = source[keep], target[keep], weight[keep]
    if mode in ("nan", "nanmask") and out.any():  # a NaN weight makes the result NaN
        gone = np.flatnonzero(out)
        source, target, weight = np.r_[source, np.zeros(len(gone), int)], np.r_[target, gone], np.r_[weight, np.full(len(gone), np.nan)]
    return Weights(source.astype(int), target.astype(int), weight, targets)


def apply_weights(grid: Grid, axes: dict[str, Weights], names: dict[str, str] | None = None) -> DataFrame:
    """The weighted sums: one broadcast join for each axis, one aggregate."""
    names = names or {d: d for d in axes}
    df, product, count = grid.df, F.lit(1.0), F.lit(1)
    for k, (d, w) in enumerate(axes.items()):
        df = df.join(w.table(grid, d, str(k)), index(d)).drop(index(d)).withColumnRenamed(f"_t_{k}", index(names[d]))
        product, count = product * F.col(f"_w_{k}"), count * F.col(f"_k_{k}")
    keys = [index(names.get(d, d)) for d in grid.dims]
    value = F.when(F.count("v") == F.first(count), F.sum(product * F.col("v")))
    return df.groupBy(*keys).agg(value.alias("v"))


def _samples(c: Coord, points) -> np.ndarray:
    """Numbers, or dates converted by the coordinate's units."""
    flat = np.atleast_1d(np.asarray(points, dtype=object))
    if len(flat) and isinstance(flat[0], datetime):
        seconds = [days_from_civil(d.year, d.month, d.day, c.calendar) * 86_400.0 + d.hour * 3600 + d.minute * 60 + d.second for d in flat]
        return (np.array(seconds) - reference_seconds(c.units, c.calendar)) / Unit.parse(c.units).factor
    return flat.astype(float)


@dataclass(frozen=True)
class Linear:
    extrapolation_mode: str = "linear"

    def weights(self, c: Coord, samples) -> Weights:
        return linear_weights(c, samples, self.extrapolation_mode)

    def regrid(self, grid: Grid, target: Grid) -> Grid:
        from .regrid import rectilinear

        return rectilinear(grid, target, self)


@dataclass(frozen=True)
class Nearest:
    extrapolation_mode: str = "extrapolate"

    def weights(self, c: Coord, samples) -> Weights:
        return nearest_weights(c, samples, self.extrapolation_mode)

    def regrid(self, grid: Grid, target: Grid) -> Grid:
        from .regrid import rectilinear

        return rectilinear(grid, target, self)


def _resampled(c: Coord, dim: str, w: Weights, linear: bool) -> Coord | None:
    """Another coordinate on an interpolated dimension: numbers follow the weights, texts can only be picked."""
    axis = c.dims.index(dim)
    if c.points.dtype.kind not in "iuf" and linear:
        return None
    shape = list(c.points.shape)
    shape[axis] = w.targets
    if not linear:
        at = np.zeros(w.targets, int)
        at[w.target] = w.source
        return replace(c, points=c.points.take(at, axis=axis), bounds=None, is_dim=False)
    moved = np.moveaxis(c.points.astype(float), axis, 0)
    out = np.zeros((w.targets, *moved.shape[1:]))
    np.add.at(out, w.target, moved[w.source] * w.weight.reshape(-1, *[1] * (moved.ndim - 1)))
    return replace(c, points=np.moveaxis(out, 0, axis), bounds=None, is_dim=False)


def interpolate(grid: Grid, points: list[tuple[str, object]], scheme: Linear | Nearest, collapse_scalar: bool = True) -> Grid:
    """The field at sample points: an outer product over the named coordinates; single numbers drop their dimension."""
    axes, made, dropped = {}, {}, []
    for name, values in points:
        c = grid.coord(name)
        if len(c.dims) != 1:
            raise GridError(f"{name} isn't on one dimension")
        if not monotonic(c.points):
            raise GridError(f"{name} isn't monotonic")
        (d,) = c.dims
        x = _samples(c, values)
        axes[d], made[d] = scheme.weights(c, x), replace(c, points=x, bounds=None, is_dim=monotonic(x), circular=False)
        if np.ndim(values) == 0 and collapse_scalar:
            dropped.append(d)
    df = apply_weights(grid, axes)
    coords = []
    for c in grid.coords:
        hit = [d for d in c.dims if d in axes]
        if not hit:
            coords.append(c)
        elif c.name() == made[hit[0]].name():
            coords.append(made[hit[0]])
        elif len(hit) == 1:
            other = _resampled(c, hit[0], axes[hit[0]], isinstance(scheme, Linear))
            if other is not None:
                coords.append(other)
    out = replace(grid, df=df, dims={d: axes[d].targets if d in axes else n for d, n in grid.dims.items()}, coords=tuple(coords))
    if dropped:
        from .subset import take_indices

        out = take_indices(out, {d: np.array([0]) for d in dropped}, dropped)
    return out


def trajectory(waypoints: list[dict[str, float]], sample_count: int = 10) -> dict[str, np.ndarray]:
    """Evenly spaced samples along the line through the waypoints."""
    names = list(waypoints[0])
    p = np.array([[w[n] for n in names] for w in waypoints], float)
    steps = np.sqrt((np.diff(p, axis=0) ** 2).sum(axis=1))
    along = np.r_[0, np.cumsum(steps)]
    at = np.linspace(0, along[-1], sample_count)
    return {n: np.interp(at, along, p[:, k]) for k, n in enumerate(names)}


def along_trajectory(grid: Grid, samples: dict[str, Sequence[float]], method: str = "linear") -> Grid:
    """The field at each sample of several coordinates together; a new last dimension ``index`` runs over the samples."""
    n = len(next(iter(samples.values())))
    if any(len(v) != n for v in samples.values()):
        raise GridError("all coordinates need the same number of samples")
    joint: list[tuple[dict[str, int], int, float]] = [({}, k, 1.0) for k in range(n)]
    dims = []
    for name, values in samples.items():
        c = grid.coord(name)
        (d,) = c.dims
        dims.append(d)
        w = linear_weights(c, values) if method == "linear" else nearest_weights(c, values)
        by: dict[int, list[tuple[int, float]]] = {}
        for s, t, x in zip(w.source.tolist(), w.target.tolist(), w.weight.tolist()):
            by.setdefault(t, []).append((s, x))
        joint = [({**at, d: s}, k, x * y) for at, k, x in joint for s, y in by.get(k, [])]
    counts = np.bincount([k for _, k, _ in joint], minlength=n)
    rows = [(*(at[d] for d in dims), k, w, int(counts[k])) for at, k, w in joint]
    table = local_table(grid.spark, rows, ", ".join([*(f"`{index(d)}` int" for d in dims), "i_index int, _w double, _k int"]))
    left = {d: m for d, m in grid.dims.items() if d not in dims}
    df = grid.df.join(sized(table, len(rows)), [index(d) for d in dims]).groupBy(*(index(d) for d in left), "i_index").agg(F.when(F.count("v") == F.first("_k"), F.sum(F.col("_w") * F.col("v"))).alias("v"))
    coords = [c for c in grid.coords if not set(c.dims) & set(dims)]
    coords += [replace(grid.coord(name), points=np.asarray(v, float), bounds=None, dims=("index",), is_dim=False, circular=False) for name, v in samples.items()]
    return replace(grid, df=df, dims={**left, "index": n}, coords=tuple(coords))


def relevel(grid: Grid, levels: Coord | Grid | str, targets: Sequence[float], dim: str, across_gaps: bool = False) -> Grid:
    """Each column linearly interpolated from the field of its own levels to target levels.

    A target lies between two neighbouring levels that both have a value, a
    masked level and an absent one being the same; the first such pair
    counts, and a target without any is masked. Every cell goes to the pair
    above it and the pair below, so one partial aggregate joins them and no
    column has to meet in one task. Levels that vary over as many cells as
    the field come as a field themselves.

    ``across_gaps`` takes each level with a value and the next one that has
    a value for neighbours, however many are masked between; then a window
    brings a column together, which is as long as the dimension at most.
    """
    levels = grid.coord(levels) if isinstance(levels, str) else levels
    others, col = grid.keys([dim]), index(dim)
    cells = grid.df.where("v is not null")
    if isinstance(levels, Grid):
        cells = cells.join(sized(levels.df.where("v is not null").withColumnRenamed("v", "_z"), levels.size), levels.keys())
        levels = Coord(standard_name=levels.standard_name, long_name=levels.long_name, units=levels.units, points=np.zeros(0), dims=(dim,))
    else:
        cells = join_table(cells, grid, levels, "_z")
    df = cells.select(*others, col, F.struct(F.col("_z").cast("double").alias("z"), "v").alias("c"))
    if across_gaps:
        pairs = df.select(*others, F.col(col).alias("_k"), F.col("c").alias("low"), F.lead("c").over(Window.partitionBy(*others).orderBy(col)).alias("high")).where("high is not null")
    else:
        ends = F.explode(F.array(F.struct(F.col(col).alias("k"), F.col("c").alias("low"), F.lit(None).cast("struct<z:double,v:double>").alias("high")), F.struct((F.col(col) - 1).alias("k"), F.lit(None).cast("struct<z:double,v:double>").alias("low"), F.col("c").alias("high"))))
        pairs = df.select(*others, ends.alias("e")).groupBy(*others, F.col("e.k").alias("_k")).agg(F.max("e.low").alias("low"), F.max("e.high").alias("high")).where("low is not null and high is not null")
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(targets)])
    z0, z1 = F.col("low.z"), F.col("high.z")
    inside: Column = F.filter(wanted, lambda s: (s["t"] >= F.least(z0, z1)) & (s["t"] <= F.greatest(z0, z1)) & (z0 != z1))
    hits = pairs.withColumn("_s", F.explode(inside))
    value = F.col("low.v") + (F.col("high.v") - F.col("low.v")) * (F.col("_s.t") - z0) / (z1 - z0)
    out = hits.groupBy(*others, F.col("_s.k").alias(col)).agg(F.min_by(value, "_k").alias("v"))
    kept = [c for c in grid.coords if dim not in c.dims]
    axis = replace(levels, points=np.asarray(targets, float), bounds=None, dims=(dim,), is_dim=monotonic(np.asarray(targets, float)))
    return replace(grid, df=out.select(*grid.keys(), "v"), dims={**grid.dims, dim: len(targets)}, coords=(*kept, axis))

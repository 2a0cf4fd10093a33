"""Reductions: whole dimensions, groups of a dimension, rolling windows.

A reduction is one aggregate by the indices that stay. Missing-data tolerance
compares the unmasked count with the number of cells known from the
dimensions, so absent rows need not be made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..frame import CellMethod, Coord, Grid, GridError, index, local_table, monotonic, sized
from ..functions.aggregators import Aggregator
from ..units import Unit

#: Longest rolling window that is computed by spreading cells instead of by a window over sorted rows.
SPREAD_WINDOW = 64
RUN_BLOCK = 4096
#: Cells of a group from which exact percentiles are found by ranges, and the ranges of a group.
RANKED_CELLS, RANGES = 1_000_000, 64


def _tolerant(value: Column, total: Column, mdtol: float | None) -> Column:
    """Masked where more than ``mdtol`` of the cells are missing."""
    if mdtol is None or mdtol >= 1:
        return value
    return F.when((total - F.count("v")) / total <= mdtol, value)


def aggregate(df: DataFrame, keys: list[str], agg: Aggregator, total: Column, mdtol: float | None = None, weight: str | None = None, order: Column | None = None, cells: int = 0, **options) -> DataFrame:
    """``keys`` and ``v``; percentiles of several levels also ``i_percentile``. ``cells``: how many a group has at most, where that is known."""
    options = {**agg.defaults, **options}
    w = F.col(weight) if weight else None
    if agg.name == "MEDIAN" and cells > RANKED_CELLS:
        return ranked_percentiles(df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), keys, total, mdtol, [0.5], 1, 1).select(*keys, F.col("_p")[0].alias("v"))
    if agg.kind == "plain":
        return df.groupBy(*keys).agg(_tolerant(agg.expr(F.col("v"), w, **options), total, mdtol).alias("v"))
    if agg.kind == "run":
        return max_run(df, keys, order, total, mdtol, options["function"])
    if agg.kind == "percentile":
        return percentiles(df, keys, total, mdtol, cells=cells, **options)
    if agg.kind == "wpercentile":
        return weighted_percentiles(df, keys, w, total, mdtol, **options)
    if agg.kind == "peak":
        return peaks(df, keys, order, total, mdtol)
    raise GridError(f"unknown aggregator kind {agg.kind}")


def max_run(df: DataFrame, keys: list[str], order: Column, total: Column, mdtol: float | None, function) -> DataFrame:
    """The longest run of cells that pass; a masked or absent cell ends a run.

    Runs are summed up inside blocks of the index first (length of the run at
    the start and at the end, longest, whether it fills the block), then the
    blocks of a key are folded in order; so a single long series is shared
    out over many tasks.
    """
    at = order.cast("long")
    hit = F.coalesce(function(F.col("v")), F.lit(False))
    more = [c for c in ("_n",) if c in df.columns]
    own = df.select(*keys, *more, "v", (at / RUN_BLOCK).cast("long").alias("_b"), (at % RUN_BLOCK).cast("int").alias("_p"), hit.alias("_h"))
    blocks = own.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.when(F.col("_h"), F.col("_p")))).alias("_hits"), F.count("v").alias("_n"), total.alias("_total"))
    fold = "aggregate(_hits, struct(-2 as last, 0 as run, 0 as best, 0 as head), (a, p) -> struct(p as last, if(p = a.last + 1, a.run + 1, 1) as run, greatest(a.best, if(p = a.last + 1, a.run + 1, 1)) as best, if(p = a.head, a.head + 1, a.head) as head))"
    parts = blocks.select(*keys, "_b", "_n", "_total", F.expr(fold).alias("_f"))
    tail = f"if(_f.last = {RUN_BLOCK - 1}, _f.run, 0)"
    part = parts.selectExpr(*(f"`{k}`" for k in keys), "_n", "_total", f"struct(_b as b, cast(_f.head as long) as head, cast({tail} as long) as tail, cast(_f.best as long) as best) as s")
    joined = part.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("_s"), F.sum("_n").alias("_n"), F.max("_total").alias("_total"))
    run = (
        "aggregate(_s, struct(cast(-2 as long) as b, cast(0 as long) as open, cast(0 as long) as best), (a, x) -> struct(x.b as b, "
        f"if(x.head = {RUN_BLOCK}, if(x.b = a.b + 1, a.open, 0) + {RUN_BLOCK}, x.tail) as open, "
        "greatest(a.best, x.best, if(x.b = a.b + 1, a.open, 0) + x.head) as best), a -> a.best)"
    )
    value = F.when(F.col("_n") > 0, F.expr(run).cast("double"))
    tolerated = value if mdtol is None or mdtol >= 1 else F.when((F.col("_total") - F.col("_n")) / F.col("_total") <= mdtol, value)
    return joined.select(*keys, tolerated.alias("v"))


def percentiles(df: DataFrame, keys: list[str], total: Column, mdtol: float | None, percent, alphap: float = 1, betap: float = 1, fast_percentile_method: bool = False, cells: int = 0) -> DataFrame:
    """Percentiles by plotting positions; several levels give a trailing ``i_percentile``. Large groups are ranked by ranges."""
    levels = [float(p) / 100 for p in np.atleast_1d(percent)]
    if any(not 0 <= p <= 1 for p in levels):
        raise GridError("percentiles lie between 0 and 100")
    if cells > RANKED_CELLS:
        picked = ranked_percentiles(df, keys, total, mdtol, levels, alphap, betap)
    elif alphap == 1 and betap == 1:
        found = df.groupBy(*keys).agg(_tolerant(F.expr(f"percentile(v, array({', '.join(map(repr, levels))}))"), total, mdtol).alias("_p"))
        picked = found
    else:
        place = Window.partitionBy(*keys).orderBy("v")
        ranked = df.where("v is not null").withColumn("_r", F.row_number().over(place)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
        values = []
        for p in levels:
            pos = F.col("_n") * p + (alphap + p * (1 - alphap - betap))
            k = F.floor(F.greatest(F.lit(1), F.least(pos, F.col("_n") - 1)))
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), pos - k))
            values.append(F.sum(F.when(F.col("_r") == k, F.col("v") * F.when(F.col("_n") == 1, 1.0).otherwise(1 - share)).when(F.col("_r") == k + 1, F.col("v") * share)))
        picked = ranked.groupBy(*keys).agg(_tolerant(F.array(*values), total, mdtol).alias("_p"))
    if np.ndim(percent) == 0 or len(levels) == 1:
        return picked.select(*keys, F.col("_p")[0].alias("v"))
    return picked.select(*keys, F.posexplode(F.coalesce(F.col("_p"), F.array(*[F.lit(None).cast("double")] * len(levels)))).alias("i_percentile", "v"))


def ranked_percentiles(df: DataFrame, keys: list[str], total: Column, mdtol: float | None, levels: list[float], alphap: float, betap: float) -> DataFrame:
    """Exact percentiles of groups of any size, as ``_p``, without sorting a group in one task.

    A sketch of each group gives the edges of ``RANGES`` ranges of about equal
    counts; exact counts of the ranges tell which hold the ranks that are
    asked for; only their cells are ranked, each range by itself, and not even
    those where a range is one value.
    """
    own = df.where("v is not null").select(*keys, *([c for c in ("_n",) if c in df.columns]), "v")
    edges = own.groupBy(*keys).agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], F.lit(10_000)).alias("_e"), F.count("v").alias("_c"), _tolerant(F.lit(1), total, mdtol).alias("_ok"))
    joined = (lambda a, b, more=(): a.join(b, [*keys, *more])) if keys else (lambda a, b, more=(): a.join(b, list(more)) if more else a.crossJoin(F.broadcast(b)))  # without keys, one row
    placed = joined(own, edges.select(*keys, "_e")).withColumn("_b", F.expr("size(filter(_e, e -> e < v))")).select(*keys, "_b", "v")
    ranges = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_in"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    n = F.col("_c")
    asked = []
    for k, p in enumerate(levels):
        pos = n * p + (alphap + p * (1 - alphap - betap))
        rank = F.floor(F.greatest(F.lit(1), F.least(pos, n - 1))).cast("long")
        share = F.when(n == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pos - rank)))
        asked += [F.struct(F.lit(k).alias("k"), rank.alias("r"), (1 - share).alias("w")), F.struct(F.lit(k).alias("k"), F.least(rank + 1, n).alias("r"), share.alias("w"))]
    wanted = edges.select(*keys, "_ok", F.explode(F.array(*asked)).alias("_q")).select(*keys, "_ok", "_q.*")
    found = joined(ranges, wanted).where("_before < r and r <= _before + _in").withColumn("_r", F.col("r") - F.col("_before"))
    ranked = joined(placed, found.where("_lo < _hi").select(*keys, "_b").distinct(), ("_b",)).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("v")).cast("long"))
    inside = joined(found.where("_lo < _hi"), ranked, ("_b", "_r")).select(*keys, "_ok", "k", "w", "v")
    values = found.where("not (_lo < _hi)").select(*keys, "_ok", "k", "w", F.col("_lo").alias("v")).unionByName(inside)
    by_level = values.groupBy(*keys, "_ok", "k").agg(F.sum(F.when(F.col("w") > 0, F.col("w") * F.col("v"))).alias("v"))
    listed = by_level.groupBy(*keys, "_ok").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("_l"))
    return listed.select(*keys, F.when(F.col("_ok").isNotNull(), F.col("_l.v")).alias("_p"))


def weighted_percentiles(df: DataFrame, keys: list[str], w: Column, total: Column, mdtol: float | None, percent, kind: str = "linear", **_) -> DataFrame:
    """Values at (cumulated weight − half the own weight) / all weight, and between them by ``kind``: linear, nearest (the lower one half-way), previous (or zero) or next."""
    if kind not in ("linear", "slinear", "nearest", "previous", "zero", "next"):
        raise GridError(f"weighted percentiles aren't interpolated by {kind!r}")
    levels = [float(p) / 100 for p in np.atleast_1d(percent)]
    part = Window.partitionBy(*keys)
    place = part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    own = df.where("v is not null").select(*keys, "v", w.cast("double").alias("_w"))
    at = own.withColumn("_at", F.try_divide(F.sum("_w").over(place) - F.col("_w") / 2, F.sum("_w").over(part)))
    before = F.lag(F.struct("_at", "v")).over(part.orderBy("v"))
    steps = at.withColumn("_before", before)
    values = []
    for q in levels:
        inside = (F.col("_before._at") < q) & (q <= F.col("_at"))
        lerp = _between(kind, q)
        low, high = F.min(F.struct("_at", "v")), F.max(F.struct("_at", "v"))
        values.append(F.when(low["_at"] >= q, low["v"]).when(high["_at"] <= q, high["v"]).otherwise(F.max(F.when(inside, lerp))))
    out = steps.groupBy(*keys).agg(_tolerant(F.when(F.max("_at").isNotNull(), F.array(*values)), total, mdtol).alias("_p"))
    if np.ndim(percent) == 0 or len(levels) == 1:
        return out.select(*keys, F.col("_p")[0].alias("v"))
    return out.select(*keys, F.posexplode(F.coalesce(F.col("_p"), F.array(*[F.lit(None).cast("double")] * len(levels)))).alias("i_percentile", "v"))


def _between(kind: str, q: float) -> Column:
    """The value at ``q`` between a row and the one before it."""
    p0, p1, v0, v1 = F.col("_before._at"), F.col("_at"), F.col("_before.v"), F.col("v")
    if kind == "nearest":
        return F.when(q - p0 <= p1 - q, v0).otherwise(v1)
    if kind in ("previous", "zero"):
        return F.when(p1 == q, v1).otherwise(v0)
    if kind == "next":
        return v1
    return v0 + (v1 - v0) * (q - p0) / (p1 - p0)


def spline_peak(values: np.ndarray) -> float:
    """The highest of each gap-free stretch and of its interpolating spline at 100 samples a point."""
    v = np.asarray(values, float)
    good = ~np.isnan(v)
    if not good.any():
        return float("nan")
    if len(v) == 1 or np.all(v == v[0]):
        return float(v[0])
    best = -np.inf
    edges = np.flatnonzero(np.diff(np.r_[False, good, False].astype(int)))
    for a, b in zip(edges[::2], edges[1::2]):
        y = v[a:b]
        best = max(best, y.max())
        n = len(y)
        if n > 1:
            best = max(best, float(_spline(y, min(5, n - 1), np.linspace(0, n - 1, 100 * n)).max()))
    return best


def _spline(y: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """The interpolating B-spline of order k through (0, y0), (1, y1) …; knots at points (odd k) or between (even k).

    Only the k + 1 basis functions that aren't zero at a place are held, so
    time and memory grow with the length of the series.
    """
    n = len(y)
    x = np.arange(n, dtype=float)
    inner = n - k - 1
    knots = x[(k + 1) // 2 : (k + 1) // 2 + inner] if k % 2 else (x[k // 2 : k // 2 + inner] + x[k // 2 + 1 : k // 2 + 1 + inner]) / 2
    t = np.r_[[0.0] * (k + 1), knots, [n - 1.0] * (k + 1)]

    def basis(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First function that isn't zero at each place, and the values from there on."""
        span = np.clip(np.searchsorted(t, p, side="right") - 1, k, n - 1)
        values = np.zeros((len(p), k + 1))
        values[:, 0] = 1.0
        for degree in range(1, k + 1):
            carried = np.zeros(len(p))
            for r in range(degree):
                above, below = t[span + r + 1] - p, p - t[span + 1 - degree + r]
                part = values[:, r] / (above + below)
                values[:, r] = carried + above * part
                carried = below * part
            values[:, degree] = carried
        return span - k, values

    first, values = basis(x)
    weights = _banded(first, values, y, k)
    start, values = basis(at)
    return (values * weights[start[:, None] + np.arange(k + 1)]).sum(axis=1)


def _banded(first: np.ndarray, values: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Solve a system whose row i holds ``values`` from column ``first`` on, within k of the diagonal; collocation needs no pivoting."""
    n = len(y)
    band = np.zeros((n + k, 3 * k + 1))
    columns = first[:, None] + np.arange(k + 1) - np.arange(n)[:, None] + k
    band[np.arange(n)[:, None], columns] = values
    out = np.r_[np.asarray(y, float), np.zeros(k)]
    for i in range(n - 1):
        for r in range(1, min(k, n - 1 - i) + 1):
            factor = band[i + r, k - r] / band[i, k]
            if factor:
                band[i + r, k - r : 2 * k - r + 1] -= factor * band[i, k : 2 * k + 1]
                out[i + r] -= factor * out[i]
    for i in range(n - 1, -1, -1):
        out[i] = (out[i] - band[i, k + 1 : 2 * k + 1] @ out[i + 1 : i + k + 1]) / band[i, k]
    return out[:n]


def peaks(df: DataFrame, keys: list[str], order: Column, total: Column, mdtol: float | None) -> DataFrame:
    """Spline peaks; a key's cells are one series, so they meet in one task as arrays of its index and values."""
    @pandas_udf("double")
    def peak(place: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for k, x in zip(place, v):
            k = np.asarray(k)
            line = np.full(int(k[-1] - k[0]) + 1, np.nan)
            line[k - k[0]] = np.array([np.nan if z is None else z for z in x], float)
            out.append(spline_peak(line))
        return pd.Series(out, dtype="float64")

    gathered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.cast("int").alias("i"), F.col("v").alias("x")))).alias("_s"), _tolerant(F.when(F.count("v") > 0, 1), total, mdtol).alias("_ok"))
    value = peak(F.col("_s.i"), F.col("_s.x"))
    return gathered.withColumn("_v", value).select(*keys, F.when(F.col("_ok").isNotNull(), F.when(~F.isnan("_v"), F.col("_v"))).alias("v"))


# Coordinates.


def collapsed_coord(c: Coord, dims: set[str]) -> Coord:
    """Texts joined by bars; numbers become their range with its middle as the point."""
    axes = tuple(k for k, d in enumerate(c.dims) if d in dims)
    if not axes:
        return c
    left = tuple(d for d in c.dims if d not in dims)
    if c.points.dtype.kind in "US":
        moved = np.moveaxis(c.points, axes, range(-len(axes), 0)).reshape([c.points.shape[k] for k in range(c.points.ndim) if k not in axes] + [-1])
        points = np.array(["|".join(x) for x in moved.reshape(-1, moved.shape[-1])]).reshape(moved.shape[:-1])
        return replace(c, points=points, bounds=None, dims=left, is_dim=False)
    item = c.points if c.bounds is None else c.bounds
    over = axes if c.bounds is None else (*axes, item.ndim - 1)
    lo, hi = item.min(axis=over), item.max(axis=over)
    mid = (0.5 * (np.asarray(lo, float) + hi)).astype(c.points.dtype)
    return replace(c, points=mid, bounds=np.stack([lo, hi], axis=-1), dims=left, is_dim=False, circular=False)


def _weighted(grid: Grid, weights) -> tuple[DataFrame, str | None, Unit | None]:
    """The cells with a weight column, from a field, a coordinate or its name, or an array like the field."""
    if weights is None:
        return grid.df, None, None
    if isinstance(weights, np.ndarray):
        weights = Coord(long_name="weights", points=weights, dims=tuple(grid.dims))
    if isinstance(weights, str):
        weights = grid.coord(weights)
    if isinstance(weights, Coord):
        from ..frame import join_table

        return join_table(grid.df, grid, weights, "_w").withColumn("_w", F.col("_w").cast("double")), "_w", Unit.parse(weights.units)
    table = weights.df.withColumnRenamed("v", "_w")
    return grid.df.join(sized(table, weights.size), weights.keys(), "left"), "_w", Unit.parse(weights.units)


def _result_units(grid: Grid, agg: Aggregator, wu: Unit | None) -> str:
    own = Unit.parse(grid.units)
    try:
        out = agg.units(own, wu)
    except ValueError:
        return "unknown"
    return grid.units if out is own or out.same(own) else out.symbol()


def _method(grid: Grid, agg: Aggregator, names: Iterable[str]) -> tuple[CellMethod, ...]:
    return grid.cell_methods if agg.cell_method is None else (*grid.cell_methods, CellMethod(agg.cell_method, tuple(names)))


def _with_levels(grid: Grid, percent, names: list[str], df: DataFrame) -> Grid:
    """Percentile levels as a scalar coordinate or, for several, a leading-free last dimension."""
    label = "percentile_over_" + "_".join(names)
    levels = np.atleast_1d(np.asarray(percent, float))
    if "i_percentile" not in df.columns:
        return replace(grid, df=df, coords=(*grid.coords, Coord(long_name=label, points=np.asarray(levels[0]), dims=(), units="percent")))
    dims = {**grid.dims, "percentile": len(levels)}
    coord = Coord(long_name=label, points=levels, dims=("percentile",), units="percent", is_dim=monotonic(levels))
    return replace(grid, df=df.select(*(index(d) for d in dims), "v"), dims=dims, coords=(*grid.coords, coord))


def collapsed(grid: Grid, coords, agg: Aggregator, weights=None, mdtol: float | None = None, returned: bool = False, **options) -> Grid | tuple[Grid, Grid]:
    """All dimensions that ``coords`` span become one cell."""
    names = [coords] if isinstance(coords, (str, Coord)) else list(coords)
    names = [n.name() if isinstance(n, Coord) else n for n in names]
    gone = grid.dims_of(names)
    if agg.kind == "run" and len(gone) != 1:
        raise GridError("a run needs exactly one dimension")
    if agg.kind == "peak" and len(gone) > 1:
        for n in names:
            grid = collapsed(grid, n, agg, mdtol=mdtol)
        return grid
    if weights is not None and not agg.weighted:
        raise GridError(f"{agg.name} takes no weights")
    df, w, wu = _weighted(grid, weights)
    keys = grid.keys(gone)
    total = F.lit(int(np.prod([grid.dims[d] for d in gone], dtype=object)) if gone else 1)
    order = F.col(index(gone[0])) if len(gone) == 1 else None
    size = int(np.prod([grid.dims[d] for d in gone], dtype=object)) if gone else 1
    out = aggregate(df, keys, agg, total, mdtol, w, order, size, **options)
    dims = {d: n for d, n in grid.dims.items() if d not in gone}
    made = replace(
        grid, df=out, dims=dims, units=_result_units(grid, agg, wu), cell_methods=_method(grid, agg, names),
        coords=tuple(collapsed_coord(c, set(gone)) for c in grid.coords if c.role == "coord" or not set(c.dims) & set(gone)),
    )
    if agg.kind in ("percentile", "wpercentile"):
        made = _with_levels(made, options["percent"], names, out)
    if returned:
        sums = df.where("v is not null").groupBy(*keys).agg(F.sum(F.col(w) if w else F.lit(1.0)).alias("v"))
        return made, replace(made, df=sums, long_name="sum_of_weights", standard_name=None, units="1")
    return made


def groups_of(coords: list[Coord]) -> tuple[list[int], list[int]]:
    """Group number of each index, groups in order of first appearance; and the first index of each group."""
    seen: dict[tuple, int] = {}
    first, out = [], []
    for k, key in enumerate(zip(*(c.points.tolist() for c in coords))):
        if key not in seen:
            seen[key] = len(seen)
            first.append(k)
        out.append(seen[key])
    return out, first


def grouped_coord(c: Coord, dim: str, group: list[int], climatological: bool = False) -> Coord:
    """A coordinate that shares the grouped dimension, one cell for each group.

    Texts are joined by bars in index order. Numbers become the range that
    the group's cells cover, written in the direction of the axis, with its
    middle as the point. On a circular axis the first cell, one period on,
    closes the last group.
    """
    axis = c.dims.index(dim)
    owner = np.asarray(group)
    if c.points.dtype.kind in "US":
        if c.bounds is not None:
            raise GridError("bounded texts can't be grouped")
        lines = np.moveaxis(c.points, axis, 0)
        texts = [["|".join(column) for column in lines[owner == g].reshape(int((owner == g).sum()), -1).T] for g in range(owner.max() + 1)]
        return replace(c, points=np.moveaxis(np.array(texts).reshape(-1, *lines.shape[1:]), 0, axis), is_dim=False)
    cells = np.moveaxis(c.points[..., None] if c.bounds is None else c.bounds, axis, 0)
    low, high = cells.min(axis=-1), cells.max(axis=-1)
    falling = low.ndim == 1 and len(low) > 1 and monotonic(c.points) and c.points[0] > c.points[-1]
    if c.circular:
        closing = high[:1] - c.modulus if falling else low[:1] + c.modulus
        low, high, owner = np.concatenate([low, closing]), np.concatenate([high, closing]), np.r_[owner, owner[-1]]
    by_group = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[by_group], np.arange(owner.max() + 1))
    ends = [np.minimum.reduceat(low[by_group], begins), np.maximum.reduceat(high[by_group], begins)]
    bounds = np.moveaxis(np.stack(ends[::-1] if falling else ends, axis=-1), 0, axis)
    points = bounds[..., 0] if climatological else bounds.mean(axis=-1)
    return replace(c, points=points, bounds=bounds, is_dim=c.is_dim and points.ndim == 1 and monotonic(points), circular=False, climatological=climatological or c.climatological)


def aggregated_by(grid: Grid, coords, agg: Aggregator, weights=None, mdtol: float | None = None, climatological: bool = False, **options) -> Grid:
    """One cell for each distinct value of coordinates on one dimension, wherever its members lie."""
    names = [coords] if isinstance(coords, (str, Coord)) else list(coords)
    by = [grid.coord(n) for n in names]
    if any(len(c.dims) != 1 for c in by) or len({c.dims for c in by}) != 1:
        raise GridError("grouping coordinates lie on one and the same dimension")
    dim = by[0].dims[0]
    group, first = groups_of(by)
    counts = np.bincount(group)
    col = index(dim)
    table = local_table(grid.spark, [(k, g, int(counts[g])) for k, g in enumerate(group)], f"`{col}` int, _g int, _n int")
    df, w, wu = _weighted(grid, weights)
    order = F.col("_at")
    df = df.join(sized(table, len(group)), col).withColumn("_at", F.col(col)).drop(col).withColumnRenamed("_g", col)
    if agg.kind in ("run", "peak"):
        seen, ranks = Counter(), []
        for g in group:
            ranks.append(seen[g])
            seen[g] += 1
        place = local_table(grid.spark, list(enumerate(ranks)), "_at int, _rank int")
        df, order = df.join(sized(place, len(group)), "_at"), F.col("_rank")
    out = aggregate(df, grid.keys(), agg, F.max("_n"), mdtol, w, order, **options)
    made_coords = []
    for c in grid.coords:
        if dim not in c.dims:
            made_coords.append(c)
        elif any(c is b for b in by):
            made_coords.append(replace(c, points=c.points[first], bounds=None if c.bounds is None else c.bounds[first], is_dim=c.is_dim and monotonic(c.points[first]), circular=False))
        elif c.role == "coord":
            made_coords.append(grouped_coord(c, dim, group, climatological=climatological and " since " in c.units))
    made = replace(
        grid, df=out, dims={d: len(first) if d == dim else n for d, n in grid.dims.items()}, coords=tuple(made_coords),
        units=_result_units(grid, agg, wu), cell_methods=_method(grid, agg, [c.name() for c in by]),
    )
    if agg.kind in ("percentile", "wpercentile"):
        made = _with_levels(made, options["percent"], [c.name() for c in by], out)
    return made


def rolling_window(grid: Grid, coord, agg: Aggregator, window: int, weights=None, mdtol: float | None = None, step: int = 1, **options) -> Grid:
    """Every run of ``window`` neighbouring cells; the coordinate's cells span first to last.

    Short windows spread each cell to the windows it belongs to and aggregate
    with partial sums, which also shares out a single series. Long unweighted
    windows of plain aggregators are put together from the end of one block
    and the begin of the next, see :func:`_two_block_windows`.
    """
    c = grid.coord(coord)
    if len(c.dims) != 1:
        raise GridError("a rolling window needs a coordinate on one dimension")
    if c.circular:
        raise GridError("rolling windows on circular coordinates aren't defined")
    dim = c.dims[0]
    n = grid.dims[dim]
    if not 2 <= window <= n:
        raise GridError(f"a window has 2 to {n} cells")
    col, others = index(dim), grid.keys([dim])
    last = n - window
    if agg.kind == "plain" and agg.window_safe and weights is None and window > SPREAD_WINDOW:
        out = _two_block_windows(grid, dim, agg, window, mdtol, {**agg.defaults, **options}).where(F.col(col) <= last)
    else:
        spread = F.explode(F.sequence(F.greatest(F.lit(0), F.col(col) - window + 1), F.least(F.col(col), F.lit(last))))
        df = grid.df.where(F.greatest(F.lit(0), F.col(col) - window + 1) <= F.least(F.col(col), F.lit(last))).withColumn("_start", spread)
        w = None
        if weights is not None:
            own = F.array(*[F.lit(float(x)) for x in weights])
            if len(weights) != window:
                raise GridError("a window takes one weight a cell")
            df, w = df.withColumn("_w", F.get(own, F.col(col) - F.col("_start"))), "_w"
        df = df.withColumn("_at", F.col(col) - F.col("_start")).drop(col).withColumnRenamed("_start", col)
        if step > 1:
            df = df.where(F.pmod(F.col(col), F.lit(step)) == 0)
        out = aggregate(df, grid.keys(), agg, F.lit(window), mdtol, w, F.col("_at"), **options)
    if step > 1:
        out = out.where(F.pmod(F.col(col), F.lit(step)) == 0).withColumn(col, (F.col(col) / step).cast("int"))
    starts = np.arange(0, last + 1, step)
    made = []
    for x in grid.coords:
        if dim not in x.dims:
            made.append(x)
        elif x.points.ndim == 1 and x.role == "coord":
            if x.points.dtype.kind in "US":
                made.append(replace(x, points=np.array(["|".join(x.points[k : k + window]) for k in starts]), bounds=None))
                continue
            lo = (x.points if x.bounds is None else x.bounds[:, 0])[starts]
            hi = (x.points if x.bounds is None else x.bounds[:, 1])[starts + window - 1]
            points = (lo + hi) / 2.0
            made.append(replace(x, points=points, bounds=np.stack([lo, hi], axis=1), is_dim=x.is_dim and monotonic(points)))
    return replace(
        grid, df=out.select(*grid.keys(), "v"), dims={d: len(starts) if d == dim else k for d, k in grid.dims.items()}, coords=tuple(made),
        units=_result_units(grid, agg, None), cell_methods=_method(grid, agg, [c.name()]),
    )


def _two_block_windows(grid: Grid, dim: str, agg: Aggregator, window: int, mdtol: float | None, opts: dict) -> DataFrame:
    """Long windows in a constant number of steps a cell, one long series shared out over tasks.

    Blocks are as long as the window, so each window is the end of a block
    from its first cell on and the begin of the next up to its last cell.
    Running parts (counts, sums, extremes, squared deviations) from both ends
    of every block are joined by the window's start and merged.
    """
    col, others = index(dim), grid.keys([dim])
    v = F.col("v")
    term = {"RMS": v * v, "GMEAN": F.ln(v), "HMEAN": F.try_divide(F.lit(1.0), v)}.get(agg.name, v)
    if agg.name in ("COUNT", "PROPORTION"):
        term = F.when(v.isNotNull(), opts["function"](v).cast("double"))
    cells = grid.dense().df.withColumn("_block", F.expr(f"`{col}` div {window}")).withColumn("_x", term)
    wanted = {"n": lambda f: F.count("v").over(f), "k": lambda f: F.count("_x").over(f), "s": lambda f: F.sum("_x").over(f)}
    if agg.name in ("MIN", "MAX", "HMEAN"):
        wanted |= {"lo": lambda f: F.min("v").over(f), "hi": lambda f: F.max("v").over(f), "nan": lambda f: F.max(F.isnan("v")).over(f)}
    if agg.name in ("VARIANCE", "STD_DEV"):
        wanted |= {"m": lambda f: F.avg("v").over(f), "q": lambda f: (F.var_pop("v").over(f) * F.count("v").over(f))}
    block = Window.partitionBy(*others, "_block").orderBy(col)
    ends, begins = block.rowsBetween(0, Window.unboundedFollowing), block.rowsBetween(Window.unboundedPreceding, 0)
    both = cells.select(*others, F.col(col), *(f(ends).alias(f"_e_{k}") for k, f in wanted.items()), *(f(begins).alias(f"_b_{k}") for k, f in wanted.items()))
    end = both.select(*others, col, *(f"_e_{k}" for k in wanted))
    begin = both.select(*others, (F.col(col) - (window - 1)).alias(col), F.expr(f"`{col}` div {window}").alias("_in"), *(f"_b_{k}" for k in wanted)).where(F.expr(f"_in > `{col}` div {window}")).drop("_in")
    pair = end.join(begin, [*others, col], "left")  # a window that is a block has no second part
    a, b = (lambda k: F.col(f"_e_{k}")), (lambda k: F.col(f"_b_{k}"))
    total = lambda k: F.coalesce(a(k), F.lit(0)) + F.coalesce(b(k), F.lit(0))
    n, k, s = total("n"), total("k"), total("s")
    if agg.name in ("SUM", "COUNT"):
        value = F.when(n > 0, s.cast("double"))
    elif agg.name in ("MEAN", "PROPORTION"):
        value = F.try_divide(s, n)
    elif agg.name == "RMS":
        value = F.sqrt(F.try_divide(s, n))
    elif agg.name == "GMEAN":
        value = F.exp(F.try_divide(s, k))
    elif agg.name == "MAX":
        value = F.greatest(a("hi"), b("hi"))
    elif agg.name in ("MIN", "HMEAN"):
        low = F.least(a("lo"), b("lo"))
        has_nan = F.coalesce(a("nan"), F.lit(False)) | F.coalesce(b("nan"), F.lit(False))
        value = F.when(has_nan, F.lit(float("nan"))).otherwise(low) if agg.name == "MIN" else F.when(low > 0, F.try_divide(n, s))
    else:
        apart = F.coalesce(a("m") - b("m"), F.lit(0.0))
        square = total("q") + apart * apart * F.coalesce(F.try_divide(a("n") * b("n"), n), F.lit(0.0))
        value = F.when(n > opts["ddof"], square / (n - opts["ddof"]))
        value = value if agg.name == "VARIANCE" else F.sqrt(value)
    if mdtol is not None and mdtol < 1:
        value = F.when((F.lit(window) - n) / window <= mdtol, value)
    return pair.select(*others, col, value.alias("v"))

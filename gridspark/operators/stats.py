"""Correlation and calculus."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..frame import Coord, Grid, GridError, index, local_table, monotonic, sized
from ..units import Unit
from .maths import resolved


def pearsonr(a: Grid, b: Grid, coords: str | Iterable[str] | None = None, weights: Grid | Coord | str | None = None, mdtol: float = 1.0, common_mask: bool = False) -> Grid:
    """Weighted correlation over the dimensions of ``coords`` (all by default).

    Each field's mean and variance use its own unmasked cells unless
    ``common_mask``. Masked where more than ``mdtol`` of the pairs are missing.
    Moments are merged (unweighted) or taken about the fields' means, known
    from a first aggregate (weighted), so an offset common to all values
    costs no digits.
    """
    names = resolved(a, b)
    right = b.df.select(*(F.col(index(d)).alias(index(names[d])) for d in b.dims), F.col("v").alias("_b"))
    on = [index(names[d]) for d in b.dims]
    left = a.df
    if weights is not None:
        from .reduce import _weighted

        left, _, _ = _weighted(a, weights)
    else:
        left = left.withColumn("_w", F.lit(1.0))
    df = left.withColumnRenamed("v", "_a").join(sized(right, b.size) if len(b.dims) < len(a.dims) else right, on, "full" if len(b.dims) == len(a.dims) and not common_mask and weights is None else "inner")
    gone = list(a.dims) if coords is None else a.dims_of(coords)
    keys = a.keys(gone)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    if weights is None:
        df = df.withColumn("_w", F.lit(1.0))
    x, y, w = F.col("_a"), F.col("_b"), F.col("_w")
    total = int(np.prod([a.dims[d] for d in gone], dtype=object))
    missing = (F.lit(total) - F.count(F.when(both, 1))) / total
    in_a, in_b = (both, both) if common_mask else (x.isNotNull(), y.isNotNull())
    if weights is None:
        own_x, own_y, pair_x, pair_y = F.when(in_a, x), F.when(in_b, y), F.when(both, x), F.when(both, y)
        apart = (F.avg(pair_x) - F.avg(own_x)) * (F.avg(pair_y) - F.avg(own_y))
        cov = F.count(F.when(both, 1)) * (F.covar_pop(pair_x, pair_y) + apart)
        value = F.try_divide(cov, F.sqrt(F.var_pop(own_x) * F.count(own_x) * F.var_pop(own_y) * F.count(own_y)))
    else:
        centres = df.groupBy(*keys).agg(F.avg(F.when(in_a, x)).alias("_ca"), F.avg(F.when(in_b, y)).alias("_cb"))
        groups = int(np.prod([a.dims[d] for d in a.dims if d not in gone], dtype=object))
        df = df.join(sized(centres, groups), keys) if keys else df.crossJoin(F.broadcast(centres))  # one row
        dx, dy = x - F.col("_ca"), y - F.col("_cb")

        def s(column, where):
            return F.sum(F.when(where, column))

        wa, wb, wc = s(w, in_a), s(w, in_b), s(w, both)
        ma, mb = s(w * dx, in_a) / wa, s(w * dy, in_b) / wb
        va, vb = s(w * dx * dx, in_a) - wa * ma * ma, s(w * dy * dy, in_b) - wb * mb * mb
        cov = s(w * dx * dy, both) - ma * s(w * dy, both) - mb * s(w * dx, both) + ma * mb * wc
        value = F.try_divide(cov, F.sqrt(va * vb))
    out = df.groupBy(*keys).agg(F.when(missing <= mdtol, value).alias("v"))
    dims = {d: n for d, n in a.dims.items() if d not in gone}
    return Grid(df=out, dims=dims, coords=tuple(c for c in a.coords if set(c.dims) <= set(dims)), long_name="Pearson's r", units="1")


def coord_delta(c: Coord, circular: bool = False) -> np.ndarray:
    p = c.points.astype(float)
    d = np.diff(p)
    return np.r_[d, p[0] + (c.modulus if p[-1] >= p[0] else -c.modulus) - p[-1]] if circular and c.modulus else d


def _midpoints(c: Coord, dim: str, circular: bool) -> Coord:
    p = c.points
    if p.dtype.kind not in "iuf":
        return replace(c, points=np.array([f"{a}|{b}" for a, b in zip(p, p[1:])]), bounds=None)
    d = coord_delta(c, circular)
    mid = p[: len(d)] + d / 2
    return replace(c, points=mid, bounds=None, circular=circular, is_dim=c.is_dim and monotonic(mid))


def delta(grid: Grid, name: str) -> Grid:
    """Forward differences; a circular axis keeps its length.

    Each cell gives its value to its own difference with a minus and to the
    one before with a plus, so a single partial aggregate does it and no
    series has to meet in one task.
    """
    c = grid.coord(name)
    if len(c.dims) != 1:
        raise GridError("differences need a coordinate on one dimension")
    (d,) = c.dims
    n, col = grid.dims[d], index(d)
    if n < 2 and not c.circular:
        raise GridError("differences need two cells")
    before = F.col(col) - 1 if not c.circular else F.pmod(F.col(col) - 1, F.lit(n))
    both = F.explode(F.array(F.struct(F.col(col).alias("k"), (-F.col("v")).alias("x")), F.struct(before.alias("k"), F.col("v").alias("x"))))
    spread = grid.df.withColumn("_s", both).where((F.col("_s.k") >= 0) & (F.col("_s.k") < (n if c.circular else n - 1)))
    out = spread.groupBy(*grid.keys([d]), F.col("_s.k").cast("int").alias(col)).agg(F.when(F.count("_s.x") == 2, F.sum("_s.x")).alias("v"))
    coords = tuple(_midpoints(x, d, c.circular and x is c) if d in x.dims and x.points.ndim == 1 else x for x in grid.coords if d not in x.dims or x.points.ndim == 1)
    return replace(grid, df=out.select(*grid.keys(), "v"), dims={**grid.dims, d: n if c.circular else n - 1}, coords=coords, standard_name=None, long_name=f"change_in_{grid.name()}_wrt_{c.name()}")


def differentiate(grid: Grid, name: str) -> Grid:
    """Differences divided by the coordinate's own."""
    c = grid.coord(name)
    top = delta(grid, name)
    (d,) = c.dims
    steps = coord_delta(c, c.circular)
    table = local_table(grid.spark, [(k, float(x)) for k, x in enumerate(steps)], f"`{index(d)}` int, _d double")
    df = top.df.join(sized(table, len(steps)), index(d)).withColumn("v", F.try_divide(F.col("v"), F.col("_d"))).select(*top.df.columns)
    try:
        units = (Unit.parse(grid.units) / Unit.parse(c.units)).symbol()
    except ValueError:
        units = "unknown"
    return replace(top, df=df, units=units, long_name=f"derivative_of_{grid.name()}_wrt_{c.name()}")


def curl(u: Grid, v: Grid, x: str, y: str, spherical: bool = False, radius: float = 6_371_229.0) -> Grid:
    """The vertical component of the curl on the midpoints of both axes; on the sphere with the metric terms."""
    from .interpolate import Linear, interpolate

    def at_mid(g: Grid, name: str) -> Grid:
        p = g.coord(name).points.astype(float)
        return interpolate(g, [(name, (p[:-1] + p[1:]) / 2)], Linear())

    if not spherical:
        dv, du = at_mid(differentiate(v, x), y), at_mid(differentiate(u, y), x)
        left, right, scale = dv, du, None
    else:
        lat = u.coord(y)
        cos = Coord(long_name="_cos", points=np.cos(np.radians(lat.points.astype(float))), dims=lat.dims)
        from .maths import multiply

        ucos = multiply(u, cos)
        left, right = at_mid(differentiate(v, x), y), at_mid(differentiate(ucos, y), x)
        mid = lat.points.astype(float)
        scale = 1 / (radius * np.cos(np.radians((mid[:-1] + mid[1:]) / 2)) * np.pi / 180)
    df = left.df.withColumnRenamed("v", "_l").join(right.df.withColumnRenamed("v", "_r"), left.keys())
    out = df.withColumn("v", F.col("_l") - F.col("_r")).select(*left.keys(), "v")
    if scale is not None:
        (d,) = left.coord(y).dims
        table = local_table(u.spark, [(k, float(s)) for k, s in enumerate(scale)], f"`{index(d)}` int, _s double")
        out = out.join(sized(table, len(scale)), index(d)).withColumn("v", F.col("v") * F.col("_s")).select(*left.keys(), "v")
    return replace(left, df=out, long_name=f"k curl component of {_common_name(u, v)}")


def _common_name(u: Grid, v: Grid) -> str:
    try:
        return spatial_name(u.name(), v.name())
    except GridError:
        return f"{u.name()} and {v.name()}"


def curl3(u: Grid, v: Grid, w: Grid, x: str, y: str, z: str) -> tuple[Grid, Grid, Grid]:
    """The three components of the curl in plane coordinates; each lies on the midpoints of the two axes it is derived along."""
    i, j, k = curl(v, w, y, z), curl(w, u, z, x), curl(u, v, x, y)
    name = spatial_name(u.name(), v.name())
    return tuple(replace(g, long_name=f"{letter} curl component of {name}") for g, letter in ((i, "i"), (j, "j"), (k, "k")))


def spatial_name(u: str, v: str) -> str:
    """What two vector components have in common: names that differ in x and y, eastward and northward, u and v."""
    for a, b in (("x", "y"), ("eastward", "northward"), ("u", "v"), ("i", "j")):
        if u.replace(a, "", 1) == v.replace(b, "", 1) and a in u and b in v:
            return u.replace(a, "", 1).strip("_ ")
    raise GridError(f"{u} and {v} are no components of a vector")

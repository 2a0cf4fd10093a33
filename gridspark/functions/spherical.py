"""Weights and transforms on the sphere: column expressions and small-array versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Coord, Grid, GridError, coord_table, index, local_table, sized
from . import projections
from .systems import CoordSystem, GeogCS

#: Fixed value: the default radius of the Earth in metres.
EARTH_RADIUS = 6_367_470.0


def _degrees(c: Coord) -> Coord:
    return c if c.units.startswith("degree") else c.with_units("degrees")


def area_weights(grid: Grid, normalize: bool = False, radius: float = EARTH_RADIUS) -> Grid:
    """r² Δλ |sin φ₁ − sin φ₀| of every cell, from the bounds of its latitude and longitude."""
    lat, lon = grid.coord(axis="y"), grid.coord(axis="x")
    for c in (lat, lon):
        if c.bounds is None or c.points.ndim > 1:
            raise GridError(f"{c.name()} needs bounds on at most one axis")
    la, lo = np.radians(_degrees(lat).bounds.reshape(-1, 2)), np.radians(_degrees(lon).bounds.reshape(-1, 2))
    a, b = np.abs(np.sin(la[:, 1]) - np.sin(la[:, 0])), np.abs(lo[:, 1] - lo[:, 0])
    scale = 1 / (a.sum() * b.sum()) if normalize else radius**2
    return _outer(grid, lat, a * scale, lon, b, "area_weights", "1" if normalize else "m2")


def _outer(grid: Grid, y: Coord, a: np.ndarray, x: Coord, b: np.ndarray, name: str, units: str) -> Grid:
    """A grid over the dimensions of y and x that holds the outer product of a and b."""
    spark, dims, df = grid.spark, {}, None
    for c, values, col in ((y, a, "_a"), (x, b, "_b")):
        cols = [f"`{index(d)}` int" for d in c.dims]
        rows = [(*([k] if c.dims else []), float(v)) for k, v in enumerate(values)]
        table = local_table(spark, rows, ", ".join([*cols, f"{col} double"]))
        dims |= {d: grid.dims[d] for d in c.dims}
        df = table if df is None else df.crossJoin(F.broadcast(table)) if len(values) <= 1_000_000 else df.join(table)
    dims = {d: n for d, n in grid.dims.items() if d in dims}
    df = df.select(*(index(d) for d in dims), (F.col("_a") * F.col("_b")).alias("v"))
    return Grid(df=df, dims=dims, coords=tuple(c for c in grid.coords if set(c.dims) <= set(dims)), long_name=name, units=units)


def cosine_latitude_weights(grid: Grid) -> Grid:
    """cos φ between 0 and 1, over the dimensions of the latitude."""
    lat = _degrees(grid.coord(axis="y"))
    w = np.clip(np.cos(np.radians(lat.points.astype(float))), 0.0, 1.0)
    table = coord_table(grid, Coord(points=w, dims=lat.dims, long_name="w"), "v")
    return Grid(df=table, dims={d: grid.dims[d] for d in lat.dims}, coords=tuple(c for c in grid.coords if set(c.dims) <= set(lat.dims)), long_name="cosine_latitude_weights")


def with_weight(grid: Grid, weights: Grid, column: str = "_w"):
    """The cells with a weight column, joined on the weights' dimensions."""
    return grid.df.join(sized(weights.df.withColumnRenamed("v", column), weights.size), weights.keys(), "left")


def wrap_column(x: Column, base: float, period: float = 360.0) -> Column:
    """x moved by whole periods into [base, base + period)."""
    return F.pmod(x.cast("double") - base, F.lit(period)) + base


def wrap_lons(x, base: float, period: float = 360.0) -> np.ndarray:
    return (np.asarray(x, float) - base) % period + base


def unrotate_columns(rlon: Column, rlat: Column, pole_lon: float, pole_lat: float) -> tuple[Column, Column]:
    """Rotated-pole coordinates, in degrees, as true longitude and latitude."""
    a, b = F.radians(rlon), F.radians(rlat)
    tilt = F.lit(float(np.radians(90.0 - pole_lat)))
    # the rotated frame: x points along the meridian away from the pole's
    x, y, z = F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)
    u, w = F.cos(tilt) * x - F.sin(tilt) * z, F.sin(tilt) * x + F.cos(tilt) * z
    lon = F.degrees(F.atan2(y, u)) + F.lit(float(pole_lon) + 180.0)
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))))


def rotate_columns(lon: Column, lat: Column, pole_lon: float, pole_lat: float) -> tuple[Column, Column]:
    """True coordinates, in degrees, in a frame whose north pole lies at (pole_lon, pole_lat)."""
    a, b = F.radians(lon - F.lit(float(pole_lon) + 180.0)), F.radians(lat)
    tilt = F.lit(float(np.radians(90.0 - pole_lat)))
    x, y, z = F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)
    u, w = F.cos(tilt) * x + F.sin(tilt) * z, -F.sin(tilt) * x + F.cos(tilt) * z
    return F.degrees(F.atan2(y, u)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))))


def rotate_vectors(u: Grid, v: Grid, angles: Grid) -> tuple[Grid, Grid]:
    """(u, v) turned by an angle in degrees from east for each cell; masked where the angle is missing."""
    both = u.df.withColumnRenamed("v", "_u").join(v.df.withColumnRenamed("v", "_v"), u.keys())
    out = both.join(sized(angles.df.withColumnRenamed("v", "_a"), angles.size), angles.keys(), "left").withColumn("_a", F.when(~F.isnan("_a"), F.radians("_a")))
    east, north = F.col("_u") * F.cos("_a") - F.col("_v") * F.sin("_a"), F.col("_u") * F.sin("_a") + F.col("_v") * F.cos("_a")
    keys = u.keys()
    return u.with_df(out.select(*keys, east.alias("v")), long_name="transformed_" + u.name(), standard_name=None), v.with_df(out.select(*keys, north.alias("v")), long_name="transformed_" + v.name(), standard_name=None)


def rotate_winds(u: Grid, v: Grid, pole_lon: float, pole_lat: float) -> tuple[Grid, Grid]:
    """Vectors on true latitude and longitude axes, in the directions of a rotated pole's axes."""
    lat, lon = u.coord(axis="y"), u.coord(axis="x")
    la, lo = np.radians(lat.points.astype(float)), np.radians(lon.points.astype(float))
    la, lo = np.meshgrid(la, lo, indexing="ij")
    pl, pp = np.radians(pole_lon), np.radians(pole_lat)
    # bearing of the rotated pole from each cell, from north towards east
    bearing = np.arctan2(np.sin(pl - lo) * np.cos(pp), np.cos(la) * np.sin(pp) - np.sin(la) * np.cos(pp) * np.cos(pl - lo))
    dims = (*lat.dims, *lon.dims)
    table = coord_table(u, Coord(points=np.degrees(bearing), dims=dims, long_name="angle"), "v")
    return rotate_vectors(u, v, Grid(df=table, dims={d: u.dims[d] for d in dims}, long_name="angle", units="degrees"))


def turn_winds(u: Grid, v: Grid, target: CoordSystem) -> tuple[Grid, Grid]:
    """Vectors along the axes of their own system, in the directions of another system's axes."""
    lat, lon = u.coord(axis="y", is_dim=True), u.coord(axis="x", is_dim=True)
    y, x = np.meshgrid(lat.points.astype(float), lon.points.astype(float), indexing="ij")
    angle = np.degrees(projections.turning(lon.coord_system or GeogCS(projections.RADIUS), target, x, y))
    dims = (*lat.dims, *lon.dims)
    table = coord_table(u, Coord(points=angle, dims=dims, long_name="angle"), "v")
    return rotate_vectors(u, v, Grid(df=table, dims={d: u.dims[d] for d in dims}, long_name="angle", units="degrees"))


def gridcell_angles(lon: Coord, lat: Coord) -> np.ndarray:
    """Degrees from east of each cell's x direction: from the middle of its left to the middle of its right edge.

    Coordinates span two axes with four corners a cell, anticlockwise from the lower left.
    """
    a, b = np.radians(lon.bounds), np.radians(lat.bounds)
    p = np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)])
    left, right = p[..., 0] + p[..., 3], p[..., 1] + p[..., 2]
    mid = p.sum(axis=-1)
    mid = mid / np.linalg.norm(mid, axis=0)
    left, right = left / np.linalg.norm(left, axis=0), right / np.linalg.norm(right, axis=0)
    d = right - left
    flat = np.hypot(mid[0], mid[1])
    east = np.stack([-mid[1], mid[0], np.zeros_like(flat)]) / np.where(flat == 0, 1, flat)
    north = np.cross(mid, east, axis=0)
    return np.degrees(np.arctan2((d * north).sum(axis=0), (d * east).sum(axis=0)))

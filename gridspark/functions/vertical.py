"""Derived vertical coordinates: one expression over joined dependencies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Coord, Grid, GridError, join_table, sized


@dataclass(frozen=True)
class Derived:
    """A coordinate computed from others: ``needs`` names roles, ``formula`` maps role columns to the value."""

    name: str
    units: str
    roles: dict[str, str | float | Grid | None]
    formula: Callable


def derive(grid: Grid, factory: Derived, column: str = "derived") -> DataFrame:
    """The grid's cells with the derived value as a column; a missing optional dependency is 0.

    A dependency is a coordinate's name, a number, or a field of its own where
    it is as large as the data.
    """
    out, cols = grid.df, {}
    for role, name in factory.roles.items():
        if name is None:
            cols[role] = F.lit(0.0)
        elif isinstance(name, (int, float)):
            cols[role] = F.lit(float(name))
        elif isinstance(name, Grid):
            out = out.join(sized(name.df.withColumnRenamed("v", f"_{role}"), name.size), name.keys())
            cols[role] = F.col(f"_{role}")
        else:
            c = grid.coord(name)
            out = join_table(out, grid, c, f"_{role}")
            cols[role] = F.col(f"_{role}").cast("double")
    level = factory.roles.get("_level")
    value = factory.formula(**{k: v for k, v in cols.items() if k != "_level"})
    return out.withColumn(column, value).drop(*(f"_{r}" for r in factory.roles)) if level is None else out.withColumn(column, value)


def derived_points(grid: Grid, factory: Derived) -> Coord:
    """The derived coordinate over the union of its dependencies' dimensions, evaluated on their arrays."""
    needed = [grid.coord(n) for n in factory.roles.values() if isinstance(n, str)]
    dims = tuple(d for d in grid.dims if any(d in c.dims for c in needed))
    rows = grid.spark.range(1).select(F.lit(0).alias("_"))
    for d in dims:
        rows = rows.crossJoin(grid.spark.range(grid.dims[d]).select(F.col("id").cast("int").alias(f"i_{d}")))
    base = Grid(df=rows.drop("_").withColumn("v", F.lit(0.0)), dims={d: grid.dims[d] for d in dims}, coords=grid.coords)
    found = derive(base, factory, "_value").orderBy(*base.keys()).select("_value").collect()
    return Coord(long_name=factory.name, units=factory.units, points=np.array([r[0] for r in found]).reshape([grid.dims[d] for d in dims]), dims=dims)


def atmosphere_sigma(sigma: str, surface_pressure: str, top_pressure: str | float | None = None) -> Derived:
    return Derived("air_pressure", "Pa", {"top": top_pressure, "sigma": sigma, "surface": surface_pressure}, lambda top, sigma, surface: top + sigma * (surface - top))


def hybrid_height(delta: str | None, sigma: str | None, orography: str | None) -> Derived:
    return Derived("altitude", "m", {"delta": delta, "sigma": sigma, "orography": orography}, lambda delta, sigma, orography: delta + sigma * orography)


def hybrid_pressure(delta: str | None, sigma: str | None, surface_pressure: str | None) -> Derived:
    return Derived("air_pressure", "Pa", {"delta": delta, "sigma": sigma, "surface": surface_pressure}, lambda delta, sigma, surface: delta + sigma * surface)


def ocean_sigma_z(sigma: str, eta: str, depth: str, depth_c: str | float, nsigma: int, zlev: str, level_index: str) -> Derived:
    """Levels below ``nsigma`` follow sigma between surface and the lesser depth; the others are fixed."""
    if nsigma < 0:
        raise GridError("nsigma isn't negative")
    return Derived(
        "sea_surface_height_above_reference_ellipsoid", "m", {"sigma": sigma, "eta": eta, "depth": depth, "depth_c": depth_c, "zlev": zlev, "level": level_index},
        lambda sigma, eta, depth, depth_c, zlev, level: F.when(level < nsigma, eta + sigma * (F.least(depth_c, depth) + eta)).otherwise(zlev),
    )


def ocean_sigma(sigma: str, eta: str, depth: str) -> Derived:
    return Derived("sea_surface_height_above_reference_ellipsoid", "m", {"sigma": sigma, "eta": eta, "depth": depth}, lambda sigma, eta, depth: eta + sigma * (depth + eta))


def ocean_s_g1(s: str, c: str, eta: str, depth: str, depth_c: str | float) -> Derived:
    def formula(s, c, eta, depth, depth_c):
        stretched = depth_c * s + (depth - depth_c) * c
        return stretched + eta * (1 + F.try_divide(stretched, depth))

    return Derived("sea_surface_height_above_reference_ellipsoid", "m", {"s": s, "c": c, "eta": eta, "depth": depth, "depth_c": depth_c}, formula)


def ocean_s(s: str, eta: str, depth: str, a: float, b: float, depth_c: str | float) -> Derived:
    def formula(s, eta, depth, depth_c):
        c = (1 - b) * F.sinh(a * s) / float(np.sinh(a)) + b * (F.tanh(a * (s + 0.5)) / (2 * float(np.tanh(0.5 * a))) - 0.5)
        return eta * (1 + s) + depth_c * s + (depth - depth_c) * c

    return Derived("sea_surface_height_above_reference_ellipsoid", "m", {"s": s, "eta": eta, "depth": depth, "depth_c": depth_c}, formula)


def ocean_s_g2(s: str, c: str, eta: str, depth: str, depth_c: str | float) -> Derived:
    def formula(s, c, eta, depth, depth_c):
        stretched = F.try_divide(depth_c * s + depth * c, depth_c + depth)
        return eta + (eta + depth) * stretched

    return Derived("sea_surface_height_above_reference_ellipsoid", "m", {"s": s, "c": c, "eta": eta, "depth": depth, "depth_c": depth_c}, formula)

"""Changes of shape and role that touch no value."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..frame import Coord, Grid, GridError, index, monotonic
from ..functions.axes import demoted, promoted


def transpose(grid: Grid, order: Iterable[str | int] | None = None) -> Grid:
    """Dimensions in another order; reversed without one."""
    own = list(grid.dims)
    wanted = own[::-1] if order is None else [own[o] if isinstance(o, int) else o for o in order]
    if sorted(wanted) != sorted(own):
        raise GridError(f"{wanted} is no order of {own}")
    return replace(grid, dims={d: grid.dims[d] for d in wanted}, df=grid.df.select(*(index(d) for d in wanted), "v"))


def squeeze(grid: Grid) -> Grid:
    """Dimensions of one cell become scalar coordinates."""
    from .subset import take_indices

    ones = [d for d, n in grid.dims.items() if n == 1]
    return take_indices(grid, {d: np.array([0]) for d in ones}, ones)


def new_axis(grid: Grid, scalar: str | None = None, expand: Iterable[str] = ()) -> Grid:
    """A leading dimension of one cell, from a scalar coordinate if one is named; ``expand`` names more components to span it."""
    dim = scalar or f"dim{len(grid.dims)}"
    if dim in grid.dims:
        raise GridError(f"there is a dimension {dim} already")
    wide = {scalar, *expand} - {None}
    coords = []
    for c in grid.coords:
        if c.name() in wide:
            if c.name() == scalar and c.dims:
                raise GridError(f"{scalar} isn't scalar")
            points = c.points[None, ...]
            c = replace(c, points=points, bounds=None if c.bounds is None else c.bounds[None, ...], dims=(dim, *c.dims), is_dim=c.name() == scalar and points.dtype.kind in "iuf")
        coords.append(c)
    df = grid.df.select(F.lit(0).alias(index(dim)), *grid.keys(), "v")
    return replace(grid, df=df, dims={dim: 1, **grid.dims}, coords=tuple(coords))


def promote(grid: Grid, name: str) -> Grid:
    """A one-axis auxiliary coordinate becomes its dimension's axis; the old axis becomes auxiliary."""
    c = grid.coord(name)
    if c.is_dim:
        return grid
    if len(c.dims) != 1 or c.points.dtype.kind not in "iuf" or not monotonic(c.points):
        raise GridError(f"{name} can't be a dimension's axis")
    old = grid.dim_coord(c.dims[0])
    return replace(grid, coords=tuple(promoted(x) if x is c else demoted(x) if x is old else x for x in grid.coords))


def demote(grid: Grid, name: str) -> Grid:
    c = grid.coord(name)
    return replace(grid, coords=tuple(demoted(x) if x is c else x for x in grid.coords))


def broadcast_to(grid: Grid, dims: dict[str, int]) -> Grid:
    """Repeat the cells along dimensions the grid doesn't have."""
    df = grid.df
    for d, n in dims.items():
        if d not in grid.dims:
            df = df.withColumn(index(d), F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return replace(grid, df=df.select(*(index(d) for d in dims), "v"), dims=dict(dims))


def rename(grid: Grid, name: str) -> Grid:
    return grid.named(name)


def clear_identity(grid: Grid) -> Grid:
    """No names, no cell methods, no STASH attribute."""
    return replace(grid, standard_name=None, long_name=None, var_name=None, cell_methods=(), attributes={k: v for k, v in grid.attributes.items() if k != "STASH"})


def add_component(grid: Grid, coord: Coord) -> Grid:
    return grid.with_coord(coord)


def describe_diff(a: Grid, b: Grid) -> list[str]:
    """What differs in the metadata of two fields, one line each."""
    out = []
    for key, x in a.describe().items():
        y = b.describe()[key]
        if x != y:
            out.append(f"{key}: {x} / {y}")
    return out

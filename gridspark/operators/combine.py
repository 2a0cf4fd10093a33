"""Merging and concatenating fields. Rules run on the coordinates; the cells are a union with shifted indices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Coord, Grid, GridError, index, monotonic
from ..functions.axes import axis_of
from ..functions.calendar import unify_time_units

#: Coordinates preferred as a new dimension's axis, in this order.
HINTS = ("time", "forecast_reference_time", "forecast_period", "model_level_number")


class DuplicateDataError(GridError):
    """Two fields hold the same place of a merge."""


def _identity(g: Grid) -> tuple:
    return (g.standard_name, g.long_name, g.var_name, g.units, tuple(sorted((k, str(v)) for k, v in g.attributes.items())), g.cell_methods)


def _coord_key(c: Coord) -> tuple:
    return (c.name(), c.units, c.dims, c.role, c.is_dim, str(c.coord_system))


def _shape_signature(g: Grid) -> tuple:
    spans = tuple(sorted((*_coord_key(c), c.points.tobytes(), b"" if c.bounds is None else c.bounds.tobytes()) for c in g.coords if c.dims))
    return (_identity(g), tuple(g.dims.items()), spans, tuple(sorted((c.name(), c.units, c.role) for c in g.coords if not c.dims)))


def _value(c: Coord) -> tuple:
    return (c.points.item(), None if c.bounds is None else tuple(c.bounds.tolist()))


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows, joined pair by pair, so that no part is analysed more often than a logarithm of their number."""
    while len(parts) > 1:
        parts = [a.unionByName(*b) if b else a for a, *b in (parts[k : k + 2] for k in range(0, len(parts), 2))]
    return parts[0]


def _functions(columns: dict[str, list], of: tuple[str, ...], name: str) -> bool:
    """Whether the values of ``name`` are a function of the columns ``of``."""
    seen: dict[tuple, object] = {}
    return all(seen.setdefault(tuple(columns[o][k] for o in of), v) == v for k, v in enumerate(columns[name]))


def derived_space(columns: dict[str, list]) -> tuple[list[str], dict[str, tuple[str, ...]]] | None:
    """New axes whose product fills every place once, and what each other coordinate depends on; None if there are none.

    Candidates come in order of the hints, then numbers before texts, then by
    name; one that is a function of an earlier candidate is no axis.
    """
    rank = {n: k for k, n in enumerate(HINTS)}
    names = sorted(columns, key=lambda n: (rank.get(n, len(HINTS)), isinstance(columns[n][0][0], str), n))
    axes: list[str] = []
    for n in sorted(names, key=lambda n: (-len(set(columns[n])), names.index(n))):
        if not any(_functions(columns, (a,), n) for a in axes):
            axes.append(n)
    axes.sort(key=names.index)
    places = set(zip(*(columns[a] for a in axes)))
    size = int(np.prod([len(set(columns[a])) for a in axes], dtype=object)) if axes else 1
    total = len(next(iter(columns.values())))
    if len(places) != total or size != total:
        return None
    needs = {}
    for n in names:
        if n not in axes:
            one = next(((a,) for a in axes if _functions(columns, (a,), n)), None)
            needs[n] = one or tuple(axes)
    return axes, needs


def merge(grids: Iterable[Grid], unique: bool = True) -> list[Grid]:
    """Fields that differ only in scalar coordinates become one with new leading dimensions."""
    out = []
    keyed = [(repr(_shape_signature(g)), k, g) for k, g in enumerate(grids)]
    for _, members in groupby(sorted(keyed, key=lambda x: (x[0], x[1])), key=lambda x: x[0]):
        own = [(k, g) for _, k, g in members]
        out += [(own[0][0], m) for m in _merge_alike([g for _, g in own], unique)]
    return [m for _, m in sorted(out, key=lambda x: x[0])]


def _merge_alike(grids: list[Grid], unique: bool) -> list[Grid]:
    first = grids[0]
    if len(grids) == 1:
        return [first]
    scalars = {c.name(): [_value(g.coord(c.name())) for g in grids] for c in first.coords if not c.dims}
    varying = {n: v for n, v in scalars.items() if len(set(v)) > 1}
    places = list(zip(*varying.values())) if varying else [()] * len(grids)
    if len(set(places)) < len(grids):
        if unique:
            raise DuplicateDataError("fields hold the same scalar coordinates")
        return grids
    space = derived_space(varying)
    if space is None:  # one anonymous dimension, in the order given
        dim = "merged"
        parts = [g.df.select(F.lit(k).alias(index(dim)), *first.keys(), "v") for k, g in enumerate(grids)]
        coords = [_stacked(first.coord(n), v, (dim,), False) for n, v in varying.items()]
        kept = [c for c in first.coords if c.name() not in varying]
        return [replace(first, df=union(parts), dims={dim: len(grids), **first.dims}, coords=(*kept, *coords))]
    axes, needs = space
    axes.sort(key=lambda n: {None: 0, "t": 1, "z": 2, "y": 3, "x": 4}[axis_of(first.coord(n))])
    values = {a: sorted(set(varying[a])) if not isinstance(varying[a][0][0], str) else list(dict.fromkeys(varying[a])) for a in axes}
    at = {a: {v: k for k, v in enumerate(values[a])} for a in axes}
    parts = [g.df.select(*(F.lit(at[a][varying[a][k]]).alias(index(a)) for a in axes), *first.keys(), "v") for k, g in enumerate(grids)]
    coords = [_stacked(first.coord(a), values[a], (a,), True) for a in axes]
    for n, of in needs.items():
        shape = [len(values[a]) for a in of]
        flat: list = [None] * int(np.prod(shape))
        for k in range(len(grids)):
            flat[int(np.ravel_multi_index([at[a][varying[a][k]] for a in of], shape))] = varying[n][k]
        coords.append(_stacked(first.coord(n), flat, of, False, shape))
    kept = [c for c in first.coords if c.name() not in varying]
    return [replace(first, df=union(parts), dims={**{a: len(values[a]) for a in axes}, **first.dims}, coords=(*kept, *coords))]


def _stacked(c: Coord, values: list, dims: tuple[str, ...], axis: bool, shape: list[int] | None = None) -> Coord:
    points = np.array([v[0] for v in values]).reshape(shape or (len(values),))
    bounds = None if values[0][1] is None else np.array([v[1] for v in values]).reshape(*points.shape, -1)
    return replace(c, points=points, bounds=bounds, dims=dims, is_dim=axis and points.dtype.kind in "iuf" and monotonic(points))


def merge_one(grids: Iterable[Grid], unique: bool = True) -> Grid:
    found = merge(grids, unique)
    if len(found) != 1:
        raise GridError(f"merging leaves {len(found)} fields")
    return found[0]


def concatenate(grids: Iterable[Grid], check_aux_coords: bool = True, check_cell_measures: bool = True, check_ancils: bool = True) -> list[Grid]:
    """Fields that continue one another along one dimension are joined, until none do.

    Fields are told apart by a key that holds all but one dimension, so each
    pass sorts them once for each dimension; nothing is compared pair by pair.
    """
    roles = {"coord": check_aux_coords, "measure": check_cell_measures, "ancillary": check_ancils}
    left = list(grids)
    changed = True
    while changed:
        changed = False
        for dim in dict.fromkeys(d for g in left for d in g.dims):
            groups: dict[tuple, list[int]] = {}
            for k, g in enumerate(left):
                if dim in g.dims and g.dim_coord(dim) is not None:
                    groups.setdefault(_key_without(g, dim, roles), []).append(k)
            joined: dict[int, Grid | None] = {}
            for members in groups.values():
                for chain in _chains(left, members, dim):
                    if len(chain) > 1:
                        joined |= dict.fromkeys(chain)
                        joined[min(chain)] = _joined([left[k] for k in chain], dim)
            if joined:
                changed = True
                left = [joined.get(k, g) for k, g in enumerate(left)]
                left = [g for g in left if g is not None]
    return left


def _content(c: Coord) -> tuple:
    same = lambda a: a.astype(float) if a.dtype.kind in "iuf" else a
    return (c.points.shape, same(c.points).tobytes(), None if c.bounds is None else same(c.bounds).tobytes())


def _key_without(g: Grid, dim: str, roles: dict[str, bool]) -> tuple:
    """All that fields have in common that continue one another along ``dim``."""
    coords = sorted(((*_coord_key(c), *(() if dim in c.dims or not (roles[c.role] or c.is_dim) else _content(c))) for c in g.coords), key=repr)
    axis = g.dim_coord(dim).points
    way = 0 if len(axis) < 2 else int(np.sign(axis[-1] - axis[0]))
    return (repr(_identity(g)), tuple((d, None if d == dim else n) for d, n in g.dims.items()), tuple(coords), way if way < 0 else 0)


def _chains(grids: list[Grid], members: list[int], dim: str) -> list[list[int]]:
    """Members in axis order, dealt into chains in which each begins behind the end of the one before."""
    axes = {k: grids[k].dim_coord(dim) for k in members}
    down = any(len(c.points) > 1 and c.points[-1] < c.points[0] for c in axes.values())
    chains: list[list[int]] = []
    for k in sorted(members, key=lambda k: axes[k].points[0], reverse=down):
        fitting = next((c for c in chains if _follows(axes[c[-1]], axes[k], down)), None)
        if fitting is None:
            chains.append([k])
        else:
            fitting.append(k)
    return chains


def _follows(a: Coord, b: Coord, down: bool) -> bool:
    """Whether b's points and cells lie behind a's."""
    if (a.points[-1] <= b.points[0]) if down else (a.points[-1] >= b.points[0]):
        return False
    if a.bounds is None or b.bounds is None:
        return a.bounds is None and b.bounds is None
    end, begin = (a.bounds[-1].min(), b.bounds[0].max()) if down else (a.bounds[-1].max(), b.bounds[0].min())
    return bool((end >= begin if down else end <= begin) or np.isclose(end, begin))


def _joined(grids: list[Grid], dim: str) -> Grid:
    first, at, parts = grids[0], 0, []
    for g in grids:
        parts.append(g.df.withColumn(index(dim), F.col(index(dim)) + at).select(*first.df.columns))
        at += g.dims[dim]
    coords = []
    for c in first.coords:
        if dim in c.dims:
            axis = c.dims.index(dim)
            own = [next(x for x in g.coords if _coord_key(x) == _coord_key(c)) for g in grids]
            c = replace(c, points=np.concatenate([x.points for x in own], axis=axis), bounds=None if c.bounds is None else np.concatenate([x.bounds for x in own], axis=axis), circular=False)
        coords.append(c)
    return replace(first, df=union(parts), dims={**first.dims, dim: at}, coords=tuple(coords))


def concatenate_one(grids: Iterable[Grid], **checks) -> Grid:
    found = concatenate(grids, **checks)
    if len(found) != 1:
        raise GridError(f"concatenating leaves {len(found)} fields")
    return found[0]


def equalise_attributes(grids: list[Grid]) -> tuple[list[Grid], list[dict]]:
    """Fields with only the attributes that all share, and what was taken from each."""
    common = {k: v for k, v in grids[0].attributes.items() if all(k in g.attributes and g.attributes[k] == v for g in grids)}
    return [replace(g, attributes=dict(common)) for g in grids], [{k: v for k, v in g.attributes.items() if k not in common} for g in grids]


def equalise(grids: list[Grid], normalise_names: bool = False, attributes: bool = False, time_units: bool = False) -> list[Grid]:
    """Make fields of one phenomenon fit: one name, common attributes, one epoch."""
    out = list(grids)
    if normalise_names:
        out = [replace(g, long_name=g.long_name if not g.standard_name else None, var_name=None if g.standard_name or g.long_name else g.var_name) for g in out]
    if attributes:
        by: dict[str, list[int]] = {}
        for k, g in enumerate(out):
            by.setdefault(g.name(), []).append(k)
        for members in by.values():
            for k, g in zip(members, equalise_attributes([out[k] for k in members])[0]):
                out[k] = g
    return unify_time_units(out) if time_units else out


#: Policies: whether to equalise first, the steps (m: merge, c: concatenate), and whether to repeat until nothing changes.
POLICIES = {"legacy": (False, "m", False), "default": (False, "m", False), "recommended": (False, "mc", False), "comprehensive": (True, "mc", True)}


def combine(grids: Iterable[Grid], policy: str = "default", steps: str | None = None, repeat: bool | None = None, equalised: bool | None = None) -> list[Grid]:
    first, order, again = POLICIES[policy]
    first, order, again = (first if equalised is None else equalised), steps or order, (again if repeat is None else repeat)
    now = list(grids)
    if first:
        now = equalise(now, normalise_names=True, attributes=True, time_units=True)
    while True:
        count = len(now)
        for s in order:
            now = merge(now, unique=False) if s == "m" else concatenate(now)
        if not again or len(now) == count:
            return now


def co_realise(grids: list[Grid]) -> list[Grid]:
    """Mark several fields for one shared materialisation; :func:`forget` gives the memory back."""
    return [g.with_df(g.df.cache()) for g in grids]


def forget(grids: Iterable[Grid]) -> None:
    """Undo :func:`co_realise`."""
    for g in grids:
        g.df.unpersist()


@contextmanager
def realised(grids: list[Grid]) -> Iterator[list[Grid]]:
    """The fields kept in memory and on disk inside the block."""
    own = co_realise(grids)
    try:
        yield own
    finally:
        forget(own)

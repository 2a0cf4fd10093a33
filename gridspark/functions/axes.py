"""Functions of one coordinate: axis, bounds, contiguity, regularity, nearest index."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from ..frame import Coord, GridError, monotonic
from ..units import UnitError, Unit, civil_from_days, days_from_civil, reference_seconds

# Coordinate names that tell the axis.
X_NAMES = ("longitude", "grid_longitude", "projection_x_coordinate", "x")
Y_NAMES = ("latitude", "grid_latitude", "projection_y_coordinate", "y")
Z_NAMES = ("height", "altitude", "air_pressure", "depth", "model_level_number", "level_height", "z")


def axis_of(c: Coord) -> str | None:
    """x, y, z or t, guessed from name and units."""
    names = {n for n in (c.standard_name, c.long_name, c.var_name) if n}
    for axis, own in (("x", X_NAMES), ("y", Y_NAMES), ("z", Z_NAMES)):
        if names & set(own):
            return axis
    try:
        unit = Unit.parse(c.units)
    except UnitError:
        return None
    if unit.is_time_reference:
        return "t"
    return "z" if dict(unit.powers) == dict(Unit.parse("Pa").powers) else None


def guessed_bounds(c: Coord, position: float = 0.5, monthly: bool = False, yearly: bool = False) -> np.ndarray:
    """Bounds between neighbouring points; whole months or years of a time axis; latitudes stay within ±90.

    The points run one way; months (or years) follow one another, each with one point.
    """
    if c.bounds is not None:
        raise GridError(f"{c.name()} has bounds already")
    if monthly and yearly:
        raise GridError("monthly and yearly exclude each other")
    if monthly or yearly:
        unit = Unit.parse(c.units)
        y, m, _ = civil_from_days(np.floor_divide(c.seconds(), 86_400), c.calendar)
        m = m if monthly else np.ones_like(m)
        y2, m2 = (y + m // 12, m % 12 + 1) if monthly else (y + 1, m)
        if len(set(zip(y.tolist(), m.tolist()))) < y.size:
            raise GridError(f"{c.name()} has two points in one {'month' if monthly else 'year'}")
        ends = [days_from_civil(a, b, 1, c.calendar) * 86_400.0 - reference_seconds(c.units, c.calendar) for a, b in ((y, m), (y2, m2))]
        if not np.array_equal(ends[0][1:], ends[1][:-1]):
            raise GridError(f"{c.name()} leaves {'months' if monthly else 'years'} out")
        return np.stack(ends, axis=1) / unit.factor
    p = c.points.astype(float)
    if p.ndim != 1 or len(p) < 2:
        raise GridError("bounds are guessed for one axis of two points or more")
    if not monotonic(p):
        raise GridError(f"the points of {c.name()} aren't strictly monotonic")
    if c.circular and c.modulus:
        way = np.sign(p[-1] - p[0]) * c.modulus
        d = np.diff(np.r_[p[-1] - way, p, p[0] + way])
    else:
        d = np.diff(p)
        d = np.r_[d[0], d, d[-1]]
    out = np.stack([p - d[:-1] * position, p + d[1:] * (1 - position)], axis=1)
    if c.name() in ("latitude", "grid_latitude") and c.units.startswith("degree") and np.all(np.abs(p) <= 90):
        out = np.clip(out, -90, 90)
    return out


def is_contiguous(c: Coord, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    """Whether each cell begins where the one before ends; a circular axis also closes."""
    if c.bounds is None:
        return False
    if c.points.ndim == 2:
        return not discontiguities(c, rtol, atol).any()
    ok = np.allclose(c.bounds[1:, 0], c.bounds[:-1, 1], rtol=rtol, atol=atol)
    return bool(ok and (not c.circular or np.isclose(abs(c.bounds[-1, 1] - c.bounds[0, 0]), c.modulus)))


def discontiguities(c: Coord, rtol: float = 1e-5, atol: float = 1e-8) -> np.ndarray:
    """Per cell of a one- or two-axis coordinate: whether its bounds differ from its next neighbours'."""
    b, shape = c.bounds, c.points.shape
    out = np.zeros(shape, bool)
    if c.points.ndim == 1:
        out[:-1] = ~np.isclose(b[1:, 0], b[:-1, 1], rtol=rtol, atol=atol)
        return out
    along = ~(np.isclose(b[:, :-1, 1], b[:, 1:, 0], rtol=rtol, atol=atol) & np.isclose(b[:, :-1, 2], b[:, 1:, 3], rtol=rtol, atol=atol))
    across = ~(np.isclose(b[:-1, :, 3], b[1:, :, 0], rtol=rtol, atol=atol) & np.isclose(b[:-1, :, 2], b[1:, :, 1], rtol=rtol, atol=atol))
    out[:, :-1] |= along
    out[:-1, :] |= across
    return out


def contiguous_edges(c: Coord) -> np.ndarray:
    """n + 1 edges of n contiguous cells."""
    if c.bounds is None:
        c = c.guess_bounds()
    if not is_contiguous(replace(c, circular=False)):
        raise GridError(f"the cells of {c.name()} aren't contiguous")
    return np.r_[c.bounds[:, 0], c.bounds[-1, 1]]


def is_regular(c: Coord) -> bool:
    try:
        regular_step(c)
    except GridError:
        return False
    return True


def regular_step(c: Coord, tolerance: float = 1e-4) -> float:
    d = np.diff(c.points.astype(float))
    if c.points.ndim != 1 or not len(d) or np.any(np.abs(d - d.mean()) > tolerance * np.abs(d.mean())):
        raise GridError(f"{c.name()} isn't regular")
    return float(d.mean())


def nearest_index(c: Coord, x: float) -> int:
    """The cell that holds x (gaps split half-way), else the nearest point; ties go to the lower index; a circular axis wraps."""
    p = c.points.astype(float)
    if c.circular and c.modulus:
        low = p.min() if c.bounds is None else float(c.bounds.min())
        x = (x - low) % c.modulus + low
        p, own = np.r_[p, p + c.modulus, p - c.modulus], len(p)
    else:
        own = len(p)
    if c.bounds is not None and monotonic(c.points):
        lo, hi = c.bounds.min(axis=1), c.bounds.max(axis=1)
        inside = np.flatnonzero((lo <= x) & (x <= hi))
        if len(inside):
            return int(inside[0])
        gap = np.minimum(np.abs(lo - x), np.abs(hi - x))
        return int(np.argmin(gap))
    d = np.abs(p - x)
    return int(np.flatnonzero(d == d.min())[0] % own)


def approx_equal(a: float, b: float, absolute: float = 1e-10, relative: float = 1e-10) -> bool:
    return abs(a - b) <= max(absolute, relative * max(abs(a), abs(b)))


def demoted(c: Coord) -> Coord:
    return replace(c, is_dim=False)


def promoted(c: Coord) -> Coord:
    return replace(c, is_dim=True)

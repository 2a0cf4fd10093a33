"""Categories of a time coordinate: calendar parts and seasons, as new coordinates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Coord, Grid, GridError
from ..units import civil_from_days, days_from_civil

# Names of months and days, and the initials that spell seasons.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SEASONS = ("djf", "mam", "jja", "son")
INITIALS = "jfmamjjasond"


def season_months(season: str) -> list[int]:
    """Month numbers of a run of month initials; it may cross the year's end."""
    text = season.lower()
    at = (INITIALS * 2).find(text)
    if at < 0 or not text:
        raise GridError(f"{season!r} is no run of months")
    return [(at + k) % 12 + 1 for k in range(len(text))]


def _checked(seasons) -> dict[int, int]:
    """Month → season number; each month belongs to one season."""
    out: dict[int, int] = {}
    for k, s in enumerate(seasons):
        for m in season_months(s):
            if m in out:
                raise GridError(f"month {m} is in two seasons")
            out[m] = k
    if len(out) != 12:
        raise GridError("the seasons don't cover every month")
    return out


def parts(c: Coord) -> dict[str, np.ndarray]:
    seconds = c.seconds()
    days = np.floor_divide(seconds, 86_400)
    y, m, d = civil_from_days(days, c.calendar)
    return {"year": y, "month": m, "day": d, "hour": np.mod(seconds, 86_400) // 3600, "doy": days - days_from_civil(y, 1, 1, c.calendar) + 1, "weekday": np.mod(days + 3, 7)}


def categorised(grid: Grid, name: str, source: str | Coord, category: Callable, units: str = "1") -> Grid:
    """A coordinate ``name`` with ``category(coordinate, point)`` for each point; texts are cut at 64 characters."""
    c = grid.coord(source)
    values = [category(c, p) for p in c.points.ravel().tolist()]
    points = np.array([v[:64] for v in values] if values and isinstance(values[0], str) else values).reshape(c.points.shape)
    return grid.with_coord(Coord(long_name=name, units=units, points=points, dims=c.dims, attributes=dict(c.attributes)))


def _add(grid: Grid, source: str, name: str, values: np.ndarray) -> Grid:
    c = grid.coord(source)
    return grid.with_coord(Coord(long_name=name, points=np.asarray(values), dims=c.dims))


def _part(key: str, default: str):
    def add(grid: Grid, source: str, name: str = default) -> Grid:
        return _add(grid, source, name, parts(grid.coord(source))[key])

    add.__doc__ = f"The {default} of each time point."
    return add


def _label(key: str, names: tuple[str, ...], base: int, cut: int | None, default: str):
    def add(grid: Grid, source: str, name: str = default) -> Grid:
        return _add(grid, source, name, np.array([n[:cut] for n in names])[parts(grid.coord(source))[key] - base])

    add.__doc__ = f"The {default} of each time point, as text."
    return add


add_year = _part("year", "year")
add_month_number = _part("month", "month_number")
add_day_of_month = _part("day", "day_of_month")
add_day_of_year = _part("doy", "day_of_year")
add_weekday_number = _part("weekday", "weekday_number")
add_hour = _part("hour", "hour")
add_month = _label("month", MONTHS, 1, 3, "month")
add_month_fullname = _label("month", MONTHS, 1, None, "month_fullname")
add_weekday = _label("weekday", DAYS, 0, 3, "weekday")
add_weekday_fullname = _label("weekday", DAYS, 0, None, "weekday_fullname")


def add_season(grid: Grid, source: str, name: str = "season", seasons=SEASONS) -> Grid:
    of = _checked(seasons)
    return _add(grid, source, name, np.array([seasons[of[m]] for m in parts(grid.coord(source))["month"].tolist()]))


def add_season_number(grid: Grid, source: str, name: str = "season_number", seasons=SEASONS) -> Grid:
    of = _checked(seasons)
    return _add(grid, source, name, np.array([of[m] for m in parts(grid.coord(source))["month"].tolist()]))


def add_season_year(grid: Grid, source: str, name: str = "season_year", seasons=SEASONS, at_start: bool = False) -> Grid:
    """The year a season belongs to: the one it ends in, or with ``at_start`` the one it begins in."""
    _checked(seasons)
    shift = {}
    for s in seasons:
        months = season_months(s)
        for k, m in enumerate(months):
            crossed = m < months[0]
            crosses = months[-1] < months[0]
            shift[m] = (-1 if crossed else 0) if at_start else (1 if crosses and not crossed else 0)
    p = parts(grid.coord(source))
    return _add(grid, source, name, p["year"] + np.array([shift[m] for m in p["month"].tolist()]))


def add_season_membership(grid: Grid, source: str, season: str, name: str = "season_membership") -> Grid:
    return _add(grid, source, name, np.isin(parts(grid.coord(source))["month"], season_months(season)))


def season_column(month: Column, seasons=SEASONS) -> Column:
    """The season of a month-number column, for tables that aren't grids yet."""
    out = None
    for s in seasons:
        hit = month.isin(season_months(s))
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out


def unify_time_units(grids: list[Grid]) -> list[Grid]:
    """Every time coordinate of a calendar in the units of the first met, as doubles."""
    epoch: dict[str, str] = {}
    out = []
    for g in grids:
        for c in g.coords:
            if " since " in c.units:
                units = epoch.setdefault(c.calendar, c.units)
                g = g.replace_coord(replace(c.with_units(units), points=c.with_units(units).points.astype(float)))
        out.append(g)
    return out

"""A small algebra of units: products of powers with a factor and an offset, and time references."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

# Base dimensions and named units as (factor, offset, dimensions).
_BASE = {b: (1.0, 0.0, {b: 1}) for b in ("m", "s", "kg", "K", "A", "mol", "cd")}
_NAMED = {
    **_BASE, "1": (1.0, 0.0, {}), "radian": (1.0, 0.0, {}), "degree": (math.pi / 180, 0.0, {}), "percent": (0.01, 0.0, {}), "g": (1e-3, 0.0, {"kg": 1}),
    "celsius": (1.0, 273.15, {"K": 1}), "fahrenheit": (5 / 9, 459.67 * 5 / 9, {"K": 1}), "minute": (60.0, 0.0, {"s": 1}), "hour": (3600.0, 0.0, {"s": 1}), "day": (86400.0, 0.0, {"s": 1}),
    "N": (1.0, 0.0, {"kg": 1, "m": 1, "s": -2}), "Pa": (1.0, 0.0, {"kg": 1, "m": -1, "s": -2}), "J": (1.0, 0.0, {"kg": 1, "m": 2, "s": -2}), "W": (1.0, 0.0, {"kg": 1, "m": 2, "s": -3}),
    "bar": (1e5, 0.0, {"kg": 1, "m": -1, "s": -2}), "l": (1e-3, 0.0, {"m": 3}), "knot": (1852 / 3600, 0.0, {"m": 1, "s": -1}), "foot": (0.3048, 0.0, {"m": 1}), "Hz": (1.0, 0.0, {"s": -1}),
    "Bq": (1.0, 0.0, {"s": -1}), "Sv": (1.0, 0.0, {"m": 2, "s": -2}), "Gy": (1.0, 0.0, {"m": 2, "s": -2}), "V": (1.0, 0.0, {"kg": 1, "m": 2, "s": -3, "A": -1}), "C": (1.0, 0.0, {"A": 1, "s": 1}), "sr": (1.0, 0.0, {}),
    "ppm": (1e-6, 0.0, {}), "ppb": (1e-9, 0.0, {}), "mb": (100.0, 0.0, {"kg": 1, "m": -1, "s": -2}), "week": (604800.0, 0.0, {"s": 1}), "tonne": (1e3, 0.0, {"kg": 1}), "mile": (1609.344, 0.0, {"m": 1}), "nautical_mile": (1852.0, 0.0, {"m": 1}),
}
_ALIAS = {
    "degrees": "degree", "deg": "degree", "degrees_north": "degree", "degrees_east": "degree", "degree_north": "degree", "degree_east": "degree", "radians": "radian", "rad": "radian", "%": "percent",
    "metre": "m", "meter": "m", "metres": "m", "meters": "m", "second": "s", "seconds": "s", "sec": "s", "minutes": "minute", "min": "minute", "hours": "hour", "h": "hour", "hr": "hour", "days": "day", "d": "day",
    "kelvin": "K", "degC": "celsius", "Celsius": "celsius", "degF": "fahrenheit", "pascal": "Pa", "watt": "W", "newton": "N", "joule": "J", "feet": "foot", "ft": "foot", "knots": "knot", "litre": "l", "millibar": "mb", "millibars": "mb", "weeks": "week", "becquerel": "Bq", "miles": "mile", "no_unit": "1", "dimensionless": "1",
}
_PREFIX = {"G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9}
_TERM = re.compile(r"([A-Za-z_%]+|\d+(?:\.\d+)?(?:e[+-]?\d+)?)(?:\^|\*\*)?([+-]?\d+)?")
_SINCE = re.compile(r"^\s*(\w+)\s+since\s+(-?\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+(?:\.\d+)?))?)?", re.I)


class UnitError(ValueError):
    """Units that can't be parsed, converted or combined."""


@dataclass(frozen=True)
class Unit:
    """``value * factor + offset`` in base units; ``reference`` marks a logarithmic result."""

    factor: float = 1.0
    offset: float = 0.0
    powers: tuple[tuple[str, Fraction], ...] = ()
    text: str = "1"

    @staticmethod
    def parse(text: str | Unit | None) -> Unit:
        if isinstance(text, Unit):
            return text
        if text is None or text.strip() in ("", "1", "unknown"):
            return Unit(text=(text or "1").strip() or "1")
        if _SINCE.match(text):
            step = Unit.parse(_SINCE.match(text)[1])
            return Unit(step.factor, 0.0, (("since", Fraction(1)),), text)
        if text.startswith("lg(") or text.startswith("ln(") or text.startswith("lb("):
            return Unit(1.0, 0.0, ((text, Fraction(1)),), text)
        factor, offset, powers, terms = 1.0, 0.0, {}, 0
        sign = 1
        for piece in re.split(r"([./*\s]+)", text.strip()):
            if not piece.strip(". */"):
                if "/" in piece:
                    sign = -1
                continue
            for name, power in _TERM.findall(piece):
                p = (int(power) if power else 1) * sign
                f, o, own = Unit._atom(name)
                factor *= f**p
                offset = o if p == 1 else 0.0
                terms += 1
                for k, n in own.items():
                    powers[k] = powers.get(k, Fraction(0)) + n * p
            sign = 1
        return Unit(factor, offset if terms == 1 else 0.0, tuple(sorted((k, Fraction(n)) for k, n in powers.items() if n)), text)

    @staticmethod
    def _atom(name: str) -> tuple[float, float, dict]:
        name = _ALIAS.get(name, name)
        if name in _NAMED:
            return _NAMED[name]
        if name[0].isdigit():
            return float(name), 0.0, {}
        if name[0] in _PREFIX and _ALIAS.get(name[1:], name[1:]) in _NAMED:
            f, _, d = _NAMED[_ALIAS.get(name[1:], name[1:])]
            return f * _PREFIX[name[0]], 0.0, d
        raise UnitError(f"unknown unit {name!r}")

    def same(self, other: Unit) -> bool:
        return (self.factor, self.offset, self.powers) == (other.factor, other.offset, other.powers)

    def linear(self, other: Unit) -> tuple[float, float]:
        """(scale, shift) such that value * scale + shift is in ``other``."""
        if self.powers != other.powers:
            raise UnitError(f"can't convert {self.text!r} to {other.text!r}")
        if self.is_time_reference:
            return self.factor / other.factor, (reference_seconds(self.text) - reference_seconds(other.text)) / other.factor
        return self.factor / other.factor, (self.offset - other.offset) / other.factor

    @property
    def is_time_reference(self) -> bool:
        return any(k == "since" for k, _ in self.powers)

    def _combined(self, other: Unit, sign: int) -> Unit:
        if self.is_time_reference or other.is_time_reference:
            raise UnitError("time references can't be multiplied")
        powers = dict(self.powers)
        for k, n in other.powers:
            powers[k] = powers.get(k, Fraction(0)) + sign * n
        out = Unit(self.factor * other.factor**sign, 0.0, tuple(sorted((k, n) for k, n in powers.items() if n)))
        return Unit(out.factor, 0.0, out.powers, out.symbol())

    def __mul__(self, other: Unit) -> Unit:
        return self._combined(other, 1)

    def __truediv__(self, other: Unit) -> Unit:
        return self._combined(other, -1)

    def __pow__(self, power: float) -> Unit:
        p = Fraction(power).limit_denominator(1000)
        powers = tuple((k, n * p) for k, n in self.powers)
        if any(n.denominator != 1 for _, n in powers):
            raise UnitError(f"{self.text!r} to the power {power} has no whole powers")
        out = Unit(self.factor ** float(p), 0.0, powers)
        return Unit(out.factor, 0.0, out.powers, out.symbol())

    def symbol(self) -> str:
        parts = [k if n == 1 else f"{k}{n}" for k, n in self.powers]
        lead = [] if abs(self.factor - 1) < 1e-15 else [f"{self.factor:.12g}"]
        return " ".join(lead + parts) or "1"


# Calendars: all arithmetic is on whole days and seconds.

CALENDARS = {"standard": None, "gregorian": None, "proleptic_gregorian": None, "360_day": 360, "noleap": 365, "365_day": 365, "all_leap": 366, "366_day": 366}
_MONTHS = {365: (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 366: (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)}


def days_from_civil(y, m, d, calendar: str = "standard"):
    """Days since 1970-01-01 of the calendar."""
    length = CALENDARS[calendar]
    y, m, d = np.asarray(y, np.int64), np.asarray(m, np.int64), np.asarray(d, np.int64)
    if length == 360:
        return (y - 1970) * 360 + (m - 1) * 30 + d - 1
    if length:
        ends = np.r_[0, np.cumsum(_MONTHS[length])]
        return (y - 1970) * length + ends[m - 1] + d - 1
    y = y - (m <= 2)
    era, yoe = np.floor_divide(y, 400), np.mod(y, 400)
    doe = yoe * 365 + yoe // 4 - yoe // 100 + (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + doe - 719_468


def civil_from_days(z, calendar: str = "standard"):
    """(year, month, day) of days since 1970-01-01."""
    length, z = CALENDARS[calendar], np.asarray(z, np.int64)
    if length == 360:
        return 1970 + z // 360, z % 360 // 30 + 1, z % 30 + 1
    if length:
        ends = np.r_[0, np.cumsum(_MONTHS[length])]
        y, doy = 1970 + z // length, z % length
        m = np.searchsorted(ends, doy, side="right")
        return y, m, doy - ends[m - 1] + 1
    z = z + 719_468
    era, doe = np.floor_divide(z, 146_097), np.mod(z, 146_097)
    yoe = (doe - doe // 1460 + doe // 36_524 - doe // 146_096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    m = np.where(mp < 10, mp + 3, mp - 9)
    return yoe + era * 400 + (m <= 2), m, doy - (153 * mp + 2) // 5 + 1


def reference_seconds(text: str, calendar: str = "standard") -> float:
    found = _SINCE.match(text)
    if not found:
        raise UnitError(f"{text!r} is no time reference")
    y, mo, d, h, mi, s = found.groups()[1:]
    return float(days_from_civil(int(y), int(mo), int(d), calendar)) * 86_400 + int(h or 0) * 3600 + int(mi or 0) * 60 + float(s or 0)


def to_seconds(points, units: str, calendar: str = "standard") -> np.ndarray:
    """Whole seconds since 1970 of time points, rounded half away from the lower second."""
    unit = Unit.parse(units)
    if not unit.is_time_reference:
        raise UnitError(f"{units!r} is no time reference")
    return np.floor(np.asarray(points, float) * unit.factor + reference_seconds(units, calendar) + 0.5).astype(np.int64)

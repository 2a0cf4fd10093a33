"""A list of fields with the verbs of many, metadata search, and text forms."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import Any
from xml.sax.saxutils import quoteattr

import xxhash
from pyspark.sql import functions as F

from ..frame import CellMethod, Coord, Grid, GridError
from . import combine as _combine
from . import subset as _subset


class GridList(list):
    """An ordered list that only takes fields."""

    def __init__(self, grids: Iterable[Grid] = ()):
        super().__init__(self._checked(g) for g in grids)

    @staticmethod
    def _checked(g: Grid) -> Grid:
        if not isinstance(g, Grid):
            raise TypeError(f"{type(g).__name__} is no field")
        return g

    def append(self, g: Grid) -> None:
        super().append(self._checked(g))

    def extend(self, grids: Iterable[Grid]) -> None:
        super().extend(self._checked(g) for g in grids)

    def insert(self, at: int, g: Grid) -> None:
        super().insert(at, self._checked(g))

    def __setitem__(self, at, g):
        super().__setitem__(at, GridList(g) if isinstance(at, slice) else self._checked(g))

    def __getitem__(self, at):
        found = super().__getitem__(at)
        return GridList(found) if isinstance(at, slice) else found

    def __add__(self, other):
        return GridList([*self, *other])

    def copy(self) -> GridList:
        return GridList(self)

    def extract(self, constraints) -> GridList:
        return GridList(_subset.extract_all(self, constraints))

    def extract_one(self, constraint) -> Grid:
        return _subset.extract_one(self, constraint)

    def extract_each(self, constraints: list) -> GridList:
        return GridList(_subset.extract_each(self, constraints))

    def extract_overlapping(self, names) -> GridList:
        return GridList(_subset.extract_overlapping(list(self), names))

    def merge(self, unique: bool = True) -> GridList:
        return GridList(_combine.merge(self, unique))

    def merge_one(self, unique: bool = True) -> Grid:
        return _combine.merge_one(self, unique)

    def concatenate(self, **checks) -> GridList:
        return GridList(_combine.concatenate(self, **checks))

    def concatenate_one(self, **checks) -> Grid:
        return _combine.concatenate_one(self, **checks)

    def combine(self, policy: str = "default", **how) -> GridList:
        return GridList(_combine.combine(self, policy, **how))

    def realise(self) -> GridList:
        return GridList(_combine.co_realise(list(self)))

    def xml(self, checksum: bool = False) -> str:
        return "<grids>\n" + "\n".join(xml(g, checksum) for g in self) + "\n</grids>"

    def __repr__(self) -> str:
        return "\n".join(f"{k}: {g.summary()}" for k, g in enumerate(self)) or "< no fields >"


def xml(grid: Grid, checksum: bool = False) -> str:
    """A canonical text of a field; with ``checksum`` also the cells' fingerprint, one aggregate."""
    own = grid.describe()
    head = f"<grid name={quoteattr(own['name'])} units={quoteattr(own['units'])} shape={quoteattr(str(grid.shape))}"
    if checksum:
        n, mark = grid.fingerprint()
        head += f' cells="{n}" checksum="{mark:016x}"'
    out = [head + ">"]
    out += [f"  <attribute name={quoteattr(k)} value={quoteattr(v)}/>" for k, v in own["attributes"].items()]
    for c in sorted(own["coords"], key=lambda c: (c["role"], c["name"])):
        out.append("  <coord " + " ".join(f"{k}={quoteattr(str(v))}" for k, v in c.items()) + "/>")
    out += [f"  <cellMethod text={quoteattr(m)}/>" for m in own["cell_methods"]]
    return "\n".join([*out, "</grid>"])


def dot(grid: Grid) -> str:
    """The structure of a field as a graph in the DOT language."""
    lines = ["digraph grid {", f"  field [shape=box label={json.dumps(grid.summary())}];"]
    for d, n in grid.dims.items():
        lines.append(f"  dim_{d} [label={json.dumps(f'{d}: {n}')}]; field -> dim_{d};")
    for k, c in enumerate(grid.coords):
        lines.append(f"  coord_{k} [shape=ellipse label={json.dumps(f'{c.name()} ({c.units})')}];")
        lines += [f"  coord_{k} -> dim_{d};" for d in c.dims] or [f"  field -> coord_{k};"]
    return "\n".join([*lines, "}"])


def find_metadata(items: Iterable[Grid | Coord], name: str | None = None, attributes: dict[str, Any] | None = None, axis: str | None = None, test: Callable | None = None) -> list:
    """Items by any of their names, attributes, axis or a test."""
    from ..functions.axes import axis_of

    out = []
    for x in items:
        if name is not None and not x.matches(name) and x.name() != name:
            continue
        if attributes and any(x.attributes.get(k) != v for k, v in attributes.items()):
            continue
        if axis is not None and (not isinstance(x, Coord) or axis_of(x) != axis):
            continue
        if test is None or test(x):
            out.append(x)
    return out


def hexdigest(x: Any) -> str:
    """A stable 64-bit digest of a value: arrays by their bytes, others by their text."""
    raw = x.tobytes() + str(x.dtype).encode() + str(x.shape).encode() if hasattr(x, "tobytes") else repr(x).encode()
    return xxhash.xxh64_hexdigest(raw)


#: Attributes that name a field's own parts and so can't be set.
FORBIDDEN = frozenset("standard_name long_name units bounds axis calendar leap_month leap_year month_lengths coordinates grid_mapping climatology cell_methods formula_terms compress add_offset scale_factor _FillValue".split())
#: Attributes that describe a whole file.
FILE_WIDE = frozenset("conventions featureType history title".split())


def checked_attributes(items: dict[str, Any]) -> dict[str, Any]:
    bad = FORBIDDEN & set(items)
    if bad:
        raise GridError(f"{sorted(bad)} are no attributes")
    return dict(items)


def split_attributes(items: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
    """(of the field, of the file)."""
    return {k: v for k, v in items.items() if k not in FILE_WIDE}, {k: v for k, v in items.items() if k in FILE_WIDE}


def combine_metadata(a: Grid, b: Grid, lenient: bool = True) -> Grid:
    """a with what both agree on. Lenient: a name or attribute only one has is kept; strict: it goes."""

    def one(x, y):
        return x if x == y else (x or y) if lenient and (x is None or y is None) else None

    both = set(a.attributes) | set(b.attributes)
    keep = {k: a.attributes.get(k, b.attributes.get(k)) for k in both if (k in a.attributes and k in b.attributes and a.attributes[k] == b.attributes[k]) or (lenient and (k in a.attributes) != (k in b.attributes))}
    return replace(a, standard_name=one(a.standard_name, b.standard_name), long_name=one(a.long_name, b.long_name), var_name=one(a.var_name, b.var_name), units=a.units if a.units == b.units else "unknown", attributes=keep, cell_methods=a.cell_methods if a.cell_methods == b.cell_methods else ())


def metadata_difference(a: Grid, b: Grid) -> dict[str, tuple]:
    return {k: (x, y) for k, x, y in ((k, getattr(a, k), getattr(b, k)) for k in ("standard_name", "long_name", "var_name", "units", "attributes", "cell_methods")) if x != y}


def is_masked(grid: Grid) -> bool:
    """Whether any cell is masked, explicitly or by absence."""
    return grid.df.agg(F.count("v")).head()[0] < grid.size


def clip_string(text: str, length: int = 70, rider: str = "...") -> str:
    """At most ``length`` characters, cut at a word's end where there is one, then the rider."""
    if len(text) <= length or not text:
        return text
    at = text.find(" ", length)
    return (text[:length] if at < 0 or at > length + 15 else text[:at]) + rider


# Helpers for rules that read or write files.


def scalar_coord(grid: Grid, name: str) -> Coord | None:
    """The coordinate of that name, if it lies on no dimension."""
    return next((c for c in grid.find(name) if not c.dims), None)


def vector_coord(grid: Grid, name: str) -> Coord | None:
    """The coordinate of that name, if it lies on one dimension."""
    return next((c for c in grid.find(name) if len(c.dims) == 1), None)


def cell_method_of(grid: Grid, method: str, coord: str) -> CellMethod | None:
    """The cell method of that kind over just that coordinate."""
    return next((m for m in grid.cell_methods if m.method == method and m.coords == (coord,)), None)

"""Reading and writing fields.

The native store is a folder: the cells as Parquet and ``_field.json`` with
names, coordinates and provenance. The registry picks a reader by a file's
name or first bytes and a writer by the target's name; others can be added.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import CellMethod, Coord, Grid, GridError, index
from ..functions.systems import from_dict, to_dict
from ..operators.combine import combine
from ..operators.subset import Constraint, NameConstraint, extract


def _array(a: np.ndarray | None):
    if a is None:
        return None
    return {"kind": a.dtype.kind, "dtype": a.dtype.str, "shape": list(a.shape), "values": a.ravel().tolist()}


def _unarray(x):
    return None if x is None else np.array(x["values"], dtype=x["dtype"]).reshape(x["shape"])


def metadata_json(grid: Grid) -> str:
    def one(c: Coord) -> dict:
        own = {k: getattr(c, k) for k in ("standard_name", "long_name", "var_name", "units", "is_dim", "circular", "climatological", "calendar", "role")}
        return own | {"coord_system": to_dict(c.coord_system), "attributes": c.attributes, "dims": list(c.dims), "points": _array(c.points), "bounds": _array(c.bounds)}

    return json.dumps({
        "standard_name": grid.standard_name, "long_name": grid.long_name, "var_name": grid.var_name, "units": grid.units, "attributes": grid.attributes, "dims": list(grid.dims.items()),
        "cell_methods": [[m.method, list(m.coords), list(m.intervals), list(m.comments)] for m in grid.cell_methods], "coords": [one(c) for c in grid.coords],
    })


def from_metadata(text: str, df: DataFrame) -> Grid:
    m = json.loads(text)
    coords = tuple(Coord(**{**{k: v for k, v in c.items() if k not in ("points", "bounds", "dims", "coord_system")}, "coord_system": from_dict(c.get("coord_system")), "points": _unarray(c["points"]), "bounds": _unarray(c["bounds"]), "dims": tuple(c["dims"])}) for c in m["coords"])
    methods = tuple(CellMethod(a, tuple(b), tuple(c), tuple(d)) for a, b, c, d in m["cell_methods"])
    return Grid(df=df, dims=dict(m["dims"]), coords=coords, cell_methods=methods, **{k: m[k] for k in ("standard_name", "long_name", "var_name", "units", "attributes")})


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def save_field(grid: Grid, path: str, mode: str = "error", compression: str = "zstd", packing: tuple[float, float] | None = None, partition_by: str | None = None) -> None:
    """Write one field. ``packing`` (scale, offset) stores 32-bit integers that stand for value = stored × scale + offset."""
    df = grid.df
    options = {}
    if packing:
        scale, offset = packing
        df = df.withColumn("v", F.round((F.col("v") - offset) / scale).cast("int"))
        options = {"scale_factor": scale, "add_offset": offset}
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(index(partition_by)) if partition_by else writer).parquet(f"{path}/cells")
    spark = grid.spark
    text = json.dumps({"field": json.loads(metadata_json(grid)), "packing": options})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_field.json")


def load_field(spark: SparkSession, path: str) -> Grid:
    m = json.loads(_read_text(spark, f"{path}/_field.json"))
    df = spark.read.parquet(f"{path}/cells")
    if m["packing"]:
        df = df.withColumn("v", F.col("v") * m["packing"]["scale_factor"] + m["packing"]["add_offset"])
    grid = from_metadata(json.dumps(m["field"]), df)
    return grid.with_df(df.select(*(F.col(k).cast("int") for k in grid.keys()), F.col("v").cast("double")))


# Formats.


@dataclass(order=True)
class Format:
    """How to tell a format and read it. ``wants_constraints``: the reader skips fields that can't match."""

    priority: int
    name: str = field(compare=False)
    matches: Callable[[str, bytes], bool] = field(compare=False)
    reader: Callable[..., Iterable[Grid]] = field(compare=False)
    wants_constraints: bool = field(default=False, compare=False)


FORMATS: list[Format] = []
WRITERS: dict[str, Callable] = {}


def add_format(spec: Format) -> None:
    FORMATS.append(spec)
    FORMATS.sort(reverse=True)


def add_writer(extension: str, writer: Callable) -> None:
    if extension in WRITERS:
        raise GridError(f"there is a writer for {extension} already")
    WRITERS[extension] = writer


@contextmanager
def chunks(spark: SparkSession, size: int) -> Iterator[None]:
    """Inside, files are read in splits of about ``size`` bytes; plans keep what held when they ran."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def find_writer(path: str) -> Callable:
    for extension, writer in WRITERS.items():
        if path.endswith("." + extension):
            return writer
    raise GridError(f"no writer for {path}")


def find_format(path: str, first: bytes) -> Format:
    for spec in FORMATS:
        if spec.matches(path, first):
            return spec
    raise GridError(f"no reader for {path}")


def decode_uri(uri: str, default: str = "file") -> tuple[str, str]:
    """(scheme, rest); a single letter before a colon is a drive."""
    head, colon, rest = uri.partition(":")
    return (head, rest) if colon and len(head) > 1 and head.isalnum() else (default, uri)


def expand(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """Paths that patterns name, sorted for each; a pattern that names none is an error."""
    out = []
    for p in patterns:
        fs, at = _filesystem(spark, p)
        found = fs.globStatus(at)
        names = sorted(str(s.getPath().toString()) for s in found) if found else []
        if not names:
            raise GridError(f"{p} names no file")
        out += names
    return out


def _first_bytes(spark: SparkSession, path: str) -> bytes:
    fs, at = _filesystem(spark, path)
    if fs.getFileStatus(at).isDirectory():
        return b""
    stream = fs.open(at)
    try:
        return bytes(b & 255 for b in (stream.read() for _ in range(8)) if b >= 0)
    finally:
        stream.close()


class IgnoreField(Exception):
    """Raised by a load callback to leave a field out."""


@dataclass(frozen=True)
class LoadProblem:
    """What couldn't be loaded: the file, the part of it, the error and where it arose."""

    path: str
    part: str
    error: Exception
    trace: str


#: Problems met while loading, oldest first.
LOAD_PROBLEMS: list[LoadProblem] = []


@contextmanager
def problem(path: str, part: str) -> Iterator[None]:
    """Errors of one part of a file are noted, and the rest of the file is loaded."""
    try:
        yield
    except (ValueError, KeyError) as error:
        LOAD_PROBLEMS.append(LoadProblem(path, part, error, traceback.format_exc()))


@contextmanager
def captured_problems() -> Iterator[list[LoadProblem]]:
    """A list that holds, after the block, what went wrong inside it."""
    before, found = len(LOAD_PROBLEMS), []
    try:
        yield found
    finally:
        found += LOAD_PROBLEMS[before:]
        del LOAD_PROBLEMS[before:]


def load_raw(spark: SparkSession, paths: str | Iterable[str], constraints=None, callback: Callable[[Grid, str], Grid | None] | None = None) -> list[Grid]:
    """The fields of all files as they are stored, each cut by each constraint that it matches."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    wanted = [Constraint(c) if isinstance(c, str) else c for c in ([] if constraints is None else constraints if isinstance(constraints, (list, tuple)) else [constraints])]
    out = []
    for path in expand(spark, paths):
        spec = find_format(path, _first_bytes(spark, path))
        fields: list[Grid] = []
        with problem(path, "whole file"):
            fields = list(spec.reader(spark, path, wanted) if spec.wants_constraints else spec.reader(spark, path))
        for g in fields:
            if callback:
                try:
                    g = callback(g, path) or g
                except IgnoreField:
                    continue
            out += [g] if not wanted else [x for c in wanted if (x := extract(g, c)) is not None]
    return out


def load(spark: SparkSession, paths, constraints=None, callback=None, policy: str = "default") -> list[Grid]:
    return combine(load_raw(spark, paths, constraints, callback), policy)


def load_one(spark: SparkSession, paths, constraint=None, callback=None) -> Grid:
    found = load(spark, paths, constraint, callback)
    if len(found) != 1:
        raise GridError(f"{len(found)} fields where one should be")
    return found[0]


def load_each(spark: SparkSession, paths, constraints: list, callback=None) -> list[Grid]:
    """Exactly one field for each constraint."""
    return [load_one(spark, paths, c, callback) for c in constraints]


def save(grids: Grid | list[Grid], path: str, writer: Callable | None = None, **options) -> None:
    """Write one field, or several below one folder."""
    writer = writer or find_writer(path)
    if isinstance(grids, Grid):
        writer(grids, path, **options)
        return
    for k, g in enumerate(grids):
        writer(g, f"{path}/{k:05d}", **options)


def _native(spark: SparkSession, path: str, constraints: list | None = None) -> list[Grid]:
    fs, at = _filesystem(spark, path)
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path + "/_field.json"))
    if marks:
        return [load_field(spark, path)]
    parts = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path + "/*/_field.json")) or []
    return [load_field(spark, str(s.getPath().getParent().toString())) for s in parts]


add_format(Format(5, "field folder", lambda p, b: p.rstrip("/").endswith(".grid"), _native))
add_writer("grid", save_field)


# Tables.


def as_table(grid: Grid, aux: bool = False, measures: bool = False, ancillaries: bool = False) -> DataFrame:
    """Long form: dimension labels, the value, and further coordinates, measures and ancillaries where asked."""
    from ..frame import join_table

    df, names = grid.df, []
    for d in grid.dims:
        c = grid.dim_coord(d)
        if c is None:
            names.append(index(d))
        else:
            df = join_table(df, grid, c, c.name())
            names.append(f"`{c.name()}`")
    for c in grid.coords:
        want = {"coord": aux and not c.is_dim, "measure": measures, "ancillary": ancillaries}[c.role]
        if want and c.points.dtype.kind != "O":
            df = join_table(df, grid, c, c.name())
            names.append(f"`{c.name()}`")
    return df.select(*names, F.col("v").alias(grid.name()))


def from_pandas(spark: SparkSession, frame, aux: Iterable[str] = (), measures: Iterable[str] = (), ancillaries: Iterable[str] = ()) -> list[Grid]:
    """Fields from a pandas frame or series whose index levels are the dimensions; other columns may be labels of some of them."""
    import pandas as pd

    frame = frame.to_frame(name=frame.name or "unknown") if isinstance(frame, pd.Series) else frame
    if frame.index.has_duplicates:
        raise GridError("the index repeats itself")
    levels = [n or f"dim{k}" for k, n in enumerate(frame.index.names)]
    flat = frame.copy()
    flat.index.names = levels
    axes = {n: np.array(sorted(set(flat.index.get_level_values(n)))) for n in levels}
    if int(np.prod([len(a) for a in axes.values()])) != len(flat):
        raise GridError("the index isn't a full product of its levels")
    extra = {**dict.fromkeys(aux, "coord"), **dict.fromkeys(measures, "measure"), **dict.fromkeys(ancillaries, "ancillary")}
    ordered = flat.reset_index().sort_values(levels, ignore_index=True)
    shape = [len(a) for a in axes.values()]
    labels = []
    for name, role in extra.items():
        values = ordered[name].to_numpy().reshape(shape)
        dims = []
        for k, d in enumerate(levels):
            axis = len(dims)
            if np.all(values == values.take([0], axis=axis)):
                values = values.take(0, axis=axis)
            else:
                dims.append(d)
        labels.append(Coord(long_name=name, points=values.astype(str) if values.dtype == object else values, dims=tuple(dims), role=role))
    table = spark.createDataFrame(ordered[[*levels, *(c for c in frame.columns if c not in extra)]])
    return [Grid.from_table(table, axes, name, long_name=str(name)) for name in frame.columns if name not in extra] if not labels else [
        Grid(**{**Grid.from_table(table, axes, name, long_name=str(name)).__dict__, "coords": (*Grid.from_table(table, axes, name).coords, *labels)}) for name in frame.columns if name not in extra
    ]


__all__ = ["Format", "NameConstraint", "add_format", "add_writer", "as_table", "from_pandas", "load", "load_each", "load_field", "load_one", "load_raw", "save", "save_field"]

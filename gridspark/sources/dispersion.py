"""Column text of dispersion models: gridded fields and time series, parsed by the text reader's tasks.

Only the heading lines come to the driver. Data lines are told from headings
by their shape, split and cast in the JVM, so one file is read in parallel.
"""

from __future__ import annotations

import re
from datetime import datetime

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import CellMethod, Coord, Grid, GridError, local_table
from ..units import Unit, days_from_civil
from .store import Format, add_format

# The heading rows of the two layouts, in order, and the most lines a heading takes.
FIELD_ROWS = ("Species Category", "Name", "Quantity", "Species", "Units", "Sources", "Ensemble Av", "Time Av or Int", "Horizontal Av or Int", "Vertical Av or Int", "Prob Perc", "Prob Perc Ens", "Prob Perc Time", "Time", "Z", "D")
SERIES_ROWS = ("Species Category", "Name", "Quantity", "Species", "Units", "Sources", "Ens Av", "Time Av or Int", "Horizontal Av or Int", "Vertical Av or Int", "Prob Perc", "Prob Perc Ens", "Prob Perc Time", "Location", "X", "Y", "Z", "D")
HEADING_LINES = 80
TIME = "%d/%m/%Y  %H:%M %Z"


def _hours(text: str) -> float:
    t = datetime.strptime(text, TIME)
    return float(days_from_civil(t.year, t.month, t.day)) * 24 + t.hour + t.minute / 60


def _heading(spark: SparkSession, path: str) -> tuple[dict[str, str], dict[str, list[str]], str, int]:
    lines = [r[0] for r in spark.read.text(path).head(HEADING_LINES)]
    header: dict[str, str] = {"version": lines[0].strip()}
    at = 1
    while at < len(lines) and ":" in lines[at]:
        key, value = lines[at].split(":", 1)
        if not value.strip() and key.strip() in ("Fields", "Series"):
            break
        header[key.strip()] = value.strip()
        at += 1
    while at < len(lines) and lines[at].strip() not in ("Fields:", "Series:"):
        at += 1
    kind = "series" if "Number of series" in header or "Series:" in (lines[at].strip() if at < len(lines) else "") else "fields"
    skip = 1 if kind == "series" else 4
    rows = {}
    for k, name in enumerate(SERIES_ROWS if kind == "series" else FIELD_ROWS):
        rows[name] = [x.strip() for x in lines[at + 1 + k].split(",")][skip:-1]
    return header, rows, kind, skip


def _units(text: str) -> str:
    """The units of a column, or ``unknown`` where they have no meaning here."""
    try:
        Unit.parse(text)
    except ValueError:
        return "unknown"
    return text or "1"


def _names(rows: dict[str, list[str]], k: int) -> dict:
    quantity, species = rows["Quantity"][k], rows["Species"][k]
    method = rows["Time Av or Int"][k].lower()
    methods = (CellMethod("mean", ("time",)),) if "average" in method else (CellMethod("sum", ("time",)),) if "integral" in method else ()
    keep = {n: rows[n][k] for n in ("Species Category", "Name", "Quantity", "Species", "Sources") if rows[n][k]}
    return {"long_name": f"{species} {quantity}".strip().upper().replace(" ", "_"), "units": _units(rows["Units"][k]), "attributes": keep, "cell_methods": methods}


PERIOD = re.compile(r"(\d+)\s*(day|hr|min|sec)", re.I)
#: Hours of the units of a period, and what a vertical reference is called.
HOURS = {"day": 24.0, "hr": 1.0, "min": 1 / 60, "sec": 1 / 3600}
REFERENCES = {"agl": ("height", "height above ground level"), "asl": ("altitude", "altitude above sea level")}
HEIGHT = re.compile(r"Z\s*=\s*([-+.\d]+)\s*m\s*(agl|asl)", re.I)
LAYER = re.compile(r"From\s*([-+.\d]+)\s*-\s*([-+.\d]+)\s*m\s*(agl|asl)", re.I)
FLIGHT = re.compile(r"From\s*FL(\d+)\s*-\s*FL(\d+)", re.I)


def _time(text: str, average: str) -> Coord:
    """The time of a column; an average or integral covers its period up to then."""
    at = _hours(text)
    period = sum(int(n) * HOURS[u.lower()] for n, u in PERIOD.findall(average))
    return Coord(standard_name="time", units="hours since 1970-01-01", points=np.array(at), bounds=np.array([at - period, at]) if period else None, dims=())


def _vertical(text: str) -> Coord:
    """Heights, layers and flight levels as numbers; anything else as a text."""
    if m := HEIGHT.search(text):
        name, label = REFERENCES[m[2].lower()]
        return Coord(standard_name=name, long_name=label, units="m", points=np.array(float(m[1])), dims=())
    if m := LAYER.search(text):
        name, label = REFERENCES[m[3].lower()]
        lo, hi = float(m[1]), float(m[2])
        return Coord(standard_name=name, long_name=label, units="m", points=np.array((lo + hi) / 2), bounds=np.array([lo, hi]), dims=())
    if m := FLIGHT.search(text):
        lo, hi = float(m[1]), float(m[2])
        return Coord(long_name="flight_level", points=np.array((lo + hi) / 2), bounds=np.array([lo, hi]), dims=())
    return Coord(long_name="z", points=np.array(text), dims=())


def load_dispersion(spark: SparkSession, path: str) -> list[Grid]:
    """One field for each data column."""
    header, rows, kind, skip = _heading(spark, path)
    n = len(rows["Species"])
    cells = spark.read.text(path).select(F.split("value", ",").alias("c"))
    at = lambda k: F.trim(F.get("c", F.lit(k)))
    out = []
    if kind == "fields":
        nx, ny = int(header["X grid size"]), int(header["Y grid size"])
        x = float(header["X grid origin"]) + float(header["X grid resolution"]) * np.arange(nx)
        y = float(header["Y grid origin"]) + float(header["Y grid resolution"]) * np.arange(ny)
        data = cells.where(F.expr("try_cast(trim(get(c, 0)) as double) is not null and try_cast(trim(get(c, 1)) as double) is not null") & (F.size("c") >= skip + n))
        for k in range(n):
            df = data.select((F.expr("cast(trim(get(c, 1)) as double)").cast("int") - 1).alias("i_latitude"), (F.expr("cast(trim(get(c, 0)) as double)").cast("int") - 1).alias("i_longitude"), at(skip + k).try_cast("double").alias("v"))
            coords = [Coord(standard_name="latitude", units="degrees", points=y, dims=("latitude",), is_dim=True), Coord(standard_name="longitude", units="degrees", points=x, dims=("longitude",), is_dim=True)]
            if rows["Time"][k]:
                coords.append(_time(rows["Time"][k], rows["Time Av or Int"][k]))
            if rows["Z"][k]:
                coords.append(_vertical(rows["Z"][k]))
            out.append(Grid(df=df, dims={"latitude": ny, "longitude": nx}, coords=tuple(coords), **_names(rows, k)))
        return out
    stamp = "try_cast(regexp_replace(trim(get(c, 0)), '^(\\\\d\\\\d)/(\\\\d\\\\d)/(\\\\d{4}) +(\\\\d\\\\d:\\\\d\\\\d).*$', '$3-$2-$1 $4:00') as timestamp_ntz)"
    timed = cells.select(F.expr(f"timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', {stamp}) / 60D").alias("h"), "c").where("h is not null")
    hours = sorted(r[0] for r in timed.select("h").distinct().limit(1_000_001).collect())
    if len(hours) > 1_000_000:
        raise GridError("a series has more than a million times")
    axis = Coord(standard_name="time", units="hours since 1970-01-01", points=np.array(hours), dims=("time",), is_dim=True)
    table = local_table(spark, [(h, k) for k, h in enumerate(hours)], "h double, i_time int")
    placed = timed.join(F.broadcast(table), "h")
    for k in range(n):
        coords = [axis]
        for name, row in (("longitude", "X"), ("latitude", "Y")):
            number = rows[row][k].replace("Lat-Long", "").split("=")[-1].strip().split(" ")[0]
            coords.append(Coord(standard_name=name, units="degrees", points=np.array(float(number)), dims=()))
        if rows["Location"][k]:
            coords.append(Coord(long_name="location", points=np.array(rows["Location"][k]), dims=()))
        if rows["Z"][k]:
            coords.append(_vertical(rows["Z"][k]))
        out.append(Grid(df=placed.select("i_time", at(skip + k).try_cast("double").alias("v")), dims={"time": len(hours)}, coords=tuple(coords), **_names(rows, k)))
    return out


add_format(Format(4, "dispersion text", lambda p, b: b[:4].upper() == b"NAME", load_dispersion))

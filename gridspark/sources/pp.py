"""PP files and fieldsfiles: two-dimensional records with a fixed header, read structured and written back.

Headers are read by a task that seeks from record to record (PP) or reads the
lookup table (fieldsfile); they alone come to the driver, 512 bytes a record.
Records of one phenomenon and grid are collated into time and level
dimensions before any cell is read. Cells are read by byte ranges, dealt out
over tasks, so a file of any size is read in parallel and each field reads
its own records only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..frame import CellMethod, Coord, Grid, GridError, index, monotonic
from ..functions.axes import axis_of
from ..functions.systems import GeogCS, RotatedGeogCS
from ..units import civil_from_days, days_from_civil
from . import packing
from .bytesio import created, slabs, with_file, with_spans
from .store import Format, add_format, add_writer, problem

# Places of header words (from 0) and codes.
WORDS = {"lbyr": 0, "lbyrd": 6, "lbtim": 12, "lbft": 13, "lblrec": 14, "lbcode": 15, "lbhem": 16, "lbrow": 17, "lbnpt": 18, "lbext": 19, "lbpack": 20, "lbrel": 21, "lbfc": 22, "lbproc": 24, "lbvc": 25, "lbegin": 28, "lbnrec": 29, "lblev": 32, "lbuser1": 38, "lbuser4": 41, "lbuser5": 42, "lbuser7": 44}
REALS = {"brsvd1": 45, "brsvd2": 46, "blev": 51, "brlev": 52, "bhlev": 53, "bhrlev": 54, "bplat": 55, "bplon": 56, "bzy": 58, "bdy": 59, "bzx": 60, "bdx": 61, "bmdi": 62, "bmks": 63}
CALENDARS = {1: "standard", 2: "360_day", 4: "365_day"}
PROCESSES = {128: "mean", 4096: "minimum", 8192: "maximum"}
LEVELS = {1: ("height", "m"), 8: ("air_pressure", "hPa"), 65: ("model_level_number", "1"), 9: ("model_level_number", "1"), 6: ("soil_model_level_number", "1")}
EARTH = 6_371_229.0
LAND_MASK = (1, 30)
FIELDS_HEADER, LOOKUP, INTEGERS, END = 256, 64, 45, -99
REAL_CONSTANTS, LOOKUP_TABLE = 104, 149
SECTOR_WORDS = 512

# Standard names and units of common codes (section, item).
NAMES = {
    (0, 2): ("x_wind", "m s-1"), (0, 3): ("y_wind", "m s-1"), (0, 4): ("air_potential_temperature", "K"), (0, 10): ("specific_humidity", "kg kg-1"), (0, 24): ("surface_temperature", "K"), (0, 30): ("land_binary_mask", "1"), (0, 33): ("surface_altitude", "m"), (0, 150): ("upward_air_velocity", "m s-1"),
    (0, 408): ("air_pressure", "Pa"), (0, 409): ("surface_air_pressure", "Pa"), (3, 225): ("x_wind", "m s-1"), (3, 226): ("y_wind", "m s-1"), (3, 236): ("air_temperature", "K"), (3, 237): ("specific_humidity", "kg kg-1"), (3, 245): ("relative_humidity", "percent"), (5, 216): ("precipitation_flux", "kg m-2 s-1"),
    (16, 4): ("air_temperature", "K"), (16, 202): ("geopotential_height", "m"), (16, 203): ("air_temperature", "K"), (16, 222): ("air_pressure_at_sea_level", "Pa"),
}


@dataclass(frozen=True)
class Stash:
    """A phenomenon's code: model, section, item."""

    model: int
    section: int
    item: int

    def __str__(self) -> str:
        return f"m{self.model:02d}s{self.section:02d}i{self.item:03d}"


@dataclass(frozen=True)
class Record:
    """A record's header words, and where its data lie: byte order, word width, begin and size in bytes."""

    ints: tuple[int, ...]
    reals: tuple[float, ...]
    order: str
    word: int
    begin: int
    size: int

    def __getattr__(self, name: str):
        if name in WORDS:
            return self.ints[WORDS[name]]
        if name in REALS:
            return self.reals[REALS[name] - INTEGERS]
        raise AttributeError(name)

    @property
    def stash(self) -> Stash:
        return Stash(self.lbuser7, self.lbuser4 // 1000, self.lbuser4 % 1000)

    def values(self, raw: bytes, land: np.ndarray | None = None) -> np.ndarray:
        return packing.unpacked(raw, self.lbpack, self.order, self.word, self.lbrow, self.lbnpt, abs(self.lbuser1) in (2, 3), self.bmdi, land)


#: How records travel from the task that reads them.
RECORD = "i array<long>, r array<double>, o string, w int, b long, s long"


def _batch(found: list[Record]) -> pa.RecordBatch:
    columns = [pa.array([list(x.ints) for x in found], pa.list_(pa.int64())), pa.array([list(x.reals) for x in found], pa.list_(pa.float64())), pa.array([x.order for x in found], pa.string())]
    columns += [pa.array([x.word for x in found], pa.int32()), pa.array([x.begin for x in found], pa.int64()), pa.array([x.size for x in found], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["i", "r", "o", "w", "b", "s"])


def _header(raw: bytes, order: str, word: int) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """45 integers and 19 reals of a header of 64 words."""
    ints, reals = np.frombuffer(raw, f"{order}i{word}", INTEGERS), np.frombuffer(raw, f"{order}f{word}", LOOKUP - INTEGERS, INTEGERS * word)
    return tuple(ints.tolist()), tuple(reals.astype(float).tolist())


def pp_records(read, size: int) -> Iterator[Record]:
    """The records of a PP file: a header and data, each between its length in bytes."""
    first = read(0, 4)
    order = next((o for o in "><" if len(first) == 4 and struct.unpack(o + "i", first)[0] == 4 * LOOKUP), None)
    if order is None:
        raise GridError("no PP file")
    at = 0
    while at + 268 <= size:
        raw = read(at, 268)
        if struct.unpack_from(order + "i", raw)[0] != 4 * LOOKUP:
            raise GridError("broken PP record")
        ints, reals = _header(raw[4:], order, 4)
        (own,) = struct.unpack_from(order + "i", raw, 264)
        yield Record(ints, reals, order, 4, at + 268, own - 4 * ints[WORDS["lbext"]])
        at += 268 + own + 4


def fieldsfile_records(read, size: int) -> Iterator[Record]:
    """The records of a fieldsfile, in words of 64 or 32 bits, from its lookup table; unused entries are passed over."""
    first = read(0, 8)
    word = 8 if first[:4] == bytes(4) else 4
    fixed = np.frombuffer(read(0, FIELDS_HEADER * word), f">i{word}")
    begin, width, count = (int(x) for x in fixed[LOOKUP_TABLE : LOOKUP_TABLE + 3])
    where, many = (int(x) for x in fixed[REAL_CONSTANTS : REAL_CONSTANTS + 2])
    constants = np.frombuffer(read((where - 1) * word, many * word), f">f{word}").astype(float) if where > 0 and many > 5 else None
    step = 4096
    for k in range(0, count, step):
        n = min(step, count - k)
        table = read((begin - 1 + k * width) * word, n * width * word)
        for j in range(n):
            ints, reals = _header(table[j * width * word : (j * width + LOOKUP) * word], ">", word)
            if ints[0] == END:
                return
            if ints[WORDS["lbrow"]] <= 0 or ints[WORDS["lbnpt"]] <= 0 or ints[WORDS["lbegin"]] <= 0:
                continue
            if constants is not None and reals[REALS["bzx"] - INTEGERS] in (0.0, reals[REALS["bmdi"] - INTEGERS]) and reals[REALS["bdx"] - INTEGERS] in (0.0, reals[REALS["bmdi"] - INTEGERS]):
                reals = _file_grid(reals, constants)
            kind = ints[WORDS["lbpack"]] % 10
            own = ints[WORDS["lbnrec"]] * 8 if kind == 1 else (ints[WORDS["lblrec"]] - ints[WORDS["lbext"]]) * (4 if kind == 2 else word)
            yield Record(ints, reals, ">", word, ints[WORDS["lbegin"]] * word, own)


def _file_grid(reals: tuple[float, ...], constants: np.ndarray) -> tuple[float, ...]:
    """A record without a grid of its own takes the file's: spacings, first point, pole."""
    dx, dy, lat, lon, pole_lat, pole_lon = constants[:6].tolist()
    out = list(reals)
    for name, x in (("bdx", dx), ("bdy", dy), ("bzx", lon - dx), ("bzy", lat - dy), ("bplat", pole_lat), ("bplon", pole_lon)):
        out[REALS[name] - INTEGERS] = x
    return tuple(out)


def _records(spark: SparkSession, path: str, reader) -> list[Record]:
    def rows(read, size):
        found = []
        for x in reader(read, size):
            found.append(x)
            if len(found) == 4096:
                yield _batch(found)
                found = []
        if found:
            yield _batch(found)

    return [Record(tuple(x.i), tuple(x.r), x.o, x.w, x.b, x.s) for x in with_file(spark, path, rows, RECORD).collect()]  # headers only


def field_table(spark: SparkSession, path: str, reader=pp_records) -> DataFrame:
    """One row a record: file, number, the named header words as columns; lazily, a task a file."""
    names = [*WORDS, *REALS]

    def rows(read, size):
        found = [(path, k, *(x.ints[w] for w in WORDS.values()), *(x.reals[w - INTEGERS] for w in REALS.values())) for k, x in enumerate(reader(read, size))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["path", "record", *names])

    return with_file(spark, path, rows, ", ".join(["path string", "record long", *(f"{n} long" for n in WORDS), *(f"{n} double" for n in REALS)]))


def _times(own: list[Record], at: int, calendar: str) -> list[float]:
    """Hours since 1970 of the dates from header word ``at`` on."""
    y, m, d, h, mi = np.array([x.ints[at : at + 5] for x in own]).T
    return (days_from_civil(y, m, d, calendar) * 24.0 + h + mi / 60).tolist()


def _same_field(x: Record) -> tuple:
    """What records of one field have in common."""
    grid = tuple(getattr(x, n) for n in ("lbrow", "lbnpt", "lbcode", "bplat", "bplon", "bzy", "bdy", "bzx", "bdx"))
    return (*grid, x.lbuser4, x.lbuser7, x.lbuser5, x.lbproc, x.lbvc, x.lbtim, x.lbuser1)


def load_records(spark: SparkSession, path: str, reader, constraints: list | None = None) -> list[Grid]:
    """One field for each phenomenon, grid and processing; records fill time and level dimensions where they make a full product."""
    found = _records(spark, path, reader)
    groups: dict[tuple, list[int]] = {}
    for k, x in enumerate(found):
        groups.setdefault(_same_field(x), []).append(k)
    masks = [x for x in found if (x.stash.section, x.stash.item) == (0, LAND_MASK[1]) and x.lbpack // 10 % 10 == 0]
    named = [c.name for c in constraints or [] if c.name is not None]
    out = []
    for members in groups.values():
        own = [found[k] for k in members]
        name, units = NAMES.get((own[0].stash.section, own[0].stash.item), (None, "1"))
        if constraints and len(named) == len(constraints) and not set(named) & {name, str(own[0].stash)}:
            continue
        with problem(path, str(own[0].stash)):
            out.append(_collated(spark, path, own, members, name, units, masks))
    return out


def _collated(spark: SparkSession, path: str, own: list[Record], members: list[int], name: str | None, units: str, masks: list[Record]) -> Grid:
    x = own[0]
    odd = {r.lbpack for r in own if r.lbpack % 10 not in (0, 1, 2, 4)}
    if odd:
        raise GridError(f"records of packing {sorted(odd)} aren't read")
    calendar, kind = CALENDARS.get(x.lbtim % 10, "standard"), x.lbtim // 10 % 10
    first, second = _times(own, WORDS["lbyr"], calendar), _times(own, WORDS["lbyrd"], calendar)
    times = [((a + b) / 2, a, b) if kind in (2, 3) else (a, a, a) for a, b in zip(first, second)]
    levels = [(float(r.lblev) if x.lbvc in (9, 65, 6) else r.blev, r.blev, r.bhlev, r.brlev, r.bhrlev) for r in own]
    at_time, at_level = ({v: n for n, v in enumerate(sorted(set(values)))} for values in (times, levels))
    product = len(set(zip(times, levels))) == len(own) == len(at_time) * len(at_level)
    place = [(at_time[t], at_level[z]) if product else (n, 0) for n, (t, z) in enumerate(zip(times, levels))]
    lead = {"time": len(at_time), "level": len(at_level)} if product else {"record": len(own)}
    dims = {**{d: n for d, n in lead.items() if n > 1}, "y": x.lbrow, "x": x.lbnpt}
    t_dims, z_dims = ((("time",) if len(at_time) > 1 else ()), (("level",) if len(at_level) > 1 else ())) if product else (("record",), ("record",))
    if not product and len(own) == 1:
        t_dims = z_dims = ()

    def coord(values: list, on: tuple, bounds: list | None = None, axis: bool = False, **names) -> Coord:
        points = np.array(values if on else values[0])
        ends = None if bounds is None else np.array(bounds if on else bounds[0])
        return Coord(points=points, bounds=ends, dims=on, is_dim=axis and product and bool(on) and monotonic(points), **names)

    ordered = sorted(at_time) if product else times
    coords = [coord([t[0] for t in ordered], t_dims, [t[1:] for t in ordered] if kind in (2, 3) else None, True, standard_name="time", units="hours since 1970-01-01", calendar=calendar)]
    coords += _forecast(own, place, product, kind, first, second, coord, t_dims, calendar)
    heights = sorted(at_level) if product else levels
    if x.lbvc in LEVELS:
        label, own_units = LEVELS[x.lbvc]
        coords.append(coord([z[0] for z in heights], z_dims, None, True, standard_name=label, units=own_units))
    if x.lbvc in (65, 9) and any(z[1] or z[2] for z in heights):
        wide, narrow = (1, 3), (2, 4)
        parts = (("level_height", "m", wide), ("sigma", "1", narrow)) if x.lbvc == 65 else (("level_pressure", "Pa", narrow), ("sigma", "1", wide))
        coords += [coord([z[p] for z in heights], z_dims, None, long_name=label, units=u) for label, u, (p, _) in parts]
    if x.lbuser5:
        coords.append(Coord(long_name="pseudo_level", points=np.array(x.lbuser5), dims=()))
    coords += _horizontal(x)
    method = PROCESSES.get(x.lbproc)
    cells = _cells(spark, path, dict(zip(members, zip(own, place))), list(dims), masks)
    return Grid(df=cells, dims=dims, coords=tuple(coords), standard_name=name, long_name=None if name else str(x.stash), attributes={"STASH": str(x.stash)}, units=units, cell_methods=(CellMethod(method, ("time",)),) if method else ())


def _forecast(own, place, product, kind, first, second, coord, dims, calendar) -> list[Coord]:
    """Forecast period and reference time, where the records have them and they follow the times."""
    if kind == 1:
        period, reference = [a - b for a, b in zip(first, second)], second
    elif kind == 2:
        period, reference = [r.lbft - (b - a) / 2 for r, a, b in zip(own, first, second)], [b - r.lbft for r, b in zip(own, second)]
    else:
        return []
    by_place: dict[int, set] = {}
    for (t, _), p, r in zip(place, period, reference):
        by_place.setdefault(t, set()).add((p, r))
    if any(len(v) > 1 for v in by_place.values()):
        return []
    rows = [next(iter(by_place[t])) for t in sorted(by_place)]
    one = len({r for _, r in rows}) == 1
    return [
        coord([p for p, _ in rows], dims, standard_name="forecast_period", units="hours"),
        coord([r for _, r in rows], () if one else dims, standard_name="forecast_reference_time", units="hours since 1970-01-01", calendar=calendar),
    ]


def _horizontal(x: Record) -> list[Coord]:
    rotated = x.lbcode // 100 == 1
    system = RotatedGeogCS(x.bplat, x.bplon, ellipsoid=GeogCS(EARTH)) if rotated else GeogCS(EARTH)
    out = []
    for dim, name, zero, step, n in (("y", "latitude", x.bzy, x.bdy, x.lbrow), ("x", "longitude", x.bzx, x.bdx, x.lbnpt)):
        points = zero + step * np.arange(1, n + 1)
        whole = name == "longitude" and not rotated and np.isclose(abs(step) * n, 360)
        out.append(Coord(standard_name=("grid_" if rotated else "") + name, units="degrees", points=points, dims=(dim,), is_dim=step != 0, circular=bool(whole), coord_system=system))
    return out


def load_pp(spark: SparkSession, path: str, constraints: list | None = None) -> list[Grid]:
    return load_records(spark, path, pp_records, constraints)


def load_fieldsfile(spark: SparkSession, path: str, constraints: list | None = None) -> list[Grid]:
    return load_records(spark, path, fieldsfile_records, constraints)


def _cells(spark: SparkSession, path: str, place: dict[int, tuple[Record, tuple[int, int]]], dims: list[str], masks: list[Record]) -> DataFrame:
    """The cells of a field's records. A record of land or sea points is read together with the land mask."""
    lead = [d for d in dims if d not in ("y", "x")]
    names = [*(index(d) for d in dims), "v"]
    masked = {(m.lbrow, m.lbnpt): m for m in masks} if any(x.lbpack // 10 % 10 == 2 for x, _ in place.values()) else {}
    spans = [(k, x.begin, x.size) for k, (x, _) in place.items()]
    land = {}
    for shape, m in masked.items():
        (row,) = with_spans(spark, path, [(0, m.begin, m.size)], lambda k, raw: [pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["b"])], "b binary").collect()  # one record
        land[shape] = m.values(bytes(row.b))

    def rows(k: int, raw: bytes):
        x, (t, z) = place[k]
        v = x.values(raw, land.get((x.lbrow, x.lbnpt))).ravel()
        y, at = np.divmod(np.arange(v.size), x.lbnpt)
        own = {"time": t, "level": z, "record": t}
        columns = [pa.array(np.full(v.size, own[d]), pa.int32()) for d in lead]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(v, mask=np.isclose(v, x.bmdi, rtol=1e-6, atol=0))], names=names)

    return with_spans(spark, path, spans, rows, ", ".join([*(f"`{index(d)}` int" for d in dims), "v double"]))


# Writing.


def _heads(grid: Grid) -> tuple[list[str], list[tuple[list[int], list[float]]]]:
    """The leading dimensions, and the header words of each record in their order."""
    x, y = grid.coord(axis="x"), grid.coord(axis="y")
    lead = [d for d in grid.dims if d not in (*x.dims, *y.dims)]
    time = next((c for c in grid.coords if axis_of(c) == "t" and c.name() != "forecast_reference_time"), None)
    level = next((c for c in grid.coords if axis_of(c) == "z" or c.name() == "model_level_number"), None)
    code = next((k for k, (n, _) in LEVELS.items() if level is not None and n == level.name()), 129)
    stash = str(grid.attributes.get("STASH", "m01s00i000"))
    hours = time.with_units("hours since 1970-01-01") if time is not None else None
    out = []
    for at in np.ndindex(*(grid.dims[d] for d in lead)):
        pick = dict(zip(lead, at))
        ints, reals = [0] * INTEGERS, [0.0] * (LOOKUP - INTEGERS)

        def of(c, values):
            return values[tuple(pick[d] for d in c.dims)]

        def put(**words):
            for k, v in words.items():
                if k in WORDS:
                    ints[WORDS[k]] = int(v)
                else:
                    reals[REALS[k] - INTEGERS] = float(v)

        if hours is not None:
            ends = of(hours, hours.bounds) if hours.bounds is not None else (of(hours, hours.points),) * 2
            for base, h in zip((0, 6), ends):
                minutes = int(round(float(h) * 60))
                ints[base : base + 3] = [int(v) for v in civil_from_days(minutes // 1440, time.calendar)]
                ints[base + 3 : base + 5] = minutes % 1440 // 60, minutes % 60
            put(lbtim=(20 if time.bounds is not None else 0) + next((k for k, v in CALENDARS.items() if v == time.calendar), 1))
        put(lbvc=code, lbrow=len(y.points), lbnpt=len(x.points), lbrel=3, lbuser1=1, lbcode=101 if x.name().startswith("grid_") else 1)
        if level is not None:
            put(lblev=of(level, level.points), blev=of(level, level.points))
        put(lbuser7=stash[1:3], lbuser4=int(stash[4:6]) * 1000 + int(stash[7:]), lbproc=next((k for m in grid.cell_methods for k, v in PROCESSES.items() if v == m.method), 0))
        for zero, step, c in (("bzy", "bdy", y), ("bzx", "bdx", x)):
            d = float(c.points[1] - c.points[0]) if len(c.points) > 1 else 1.0
            put(**{step: d, zero: float(c.points[0]) - d})
        if isinstance(x.coord_system, RotatedGeogCS):
            put(bplat=x.coord_system.grid_north_pole_latitude, bplon=x.coord_system.grid_north_pole_longitude)
        else:
            put(bplat=90.0)
        put(bmdi=-1e30, bmks=1.0)
        out.append((ints, reals))
    return lead, out


def _bodies(grid: Grid, lead: list[str], accuracy: int | None) -> Iterator[bytes]:
    """The data of each record, big-endian: plain 32-bit floats, or packed to ``2 ** accuracy``."""
    x, y = grid.coord(axis="x"), grid.coord(axis="y")
    rows, cols = len(y.points), len(x.points)
    for raw in slabs(grid, [*lead, *y.dims, *x.dims], ">f4" if accuracy is None else ">f8", -1e30, rows * cols):
        yield raw if accuracy is None else packing.pack_rows(np.frombuffer(raw, ">f8").reshape(rows, cols), accuracy, -1e30)


def _encoded(ints: list[int], reals: list[float], order: str, word: int) -> bytes:
    return np.array(ints, f"{order}i{word}").tobytes() + np.array(reals, f"{order}f{word}").tobytes()


def pieces(grid: Grid, order: str = ">", accuracy: int | None = None) -> Iterator[bytes]:
    """The bytes of a PP file, a record at a time."""
    lead, heads = _heads(grid)
    for (ints, reals), body in zip(heads, _bodies(grid, lead, accuracy)):
        ints[WORDS["lblrec"]], ints[WORDS["lbpack"]] = len(body) // 4, 0 if accuracy is None else 1
        body = np.frombuffer(body, ">f4").astype(order + "f4").tobytes() if accuracy is None and order == "<" else body
        mark, size = struct.pack(order + "i", 4 * LOOKUP), struct.pack(order + "i", len(body))
        yield mark + _encoded(ints, reals, order, 4) + mark + size + body + size


def to_bytes(grid: Grid, order: str = ">") -> bytes:
    return b"".join(pieces(grid, order))


def save_pp(grid: Grid, path: str, accuracy: int | None = None, **_) -> None:
    """Write records one after another; ``accuracy`` packs them to multiples of ``2 ** accuracy``."""
    with created(grid.spark, path) as stream:
        for piece in pieces(grid, accuracy=accuracy):
            stream.write(piece)


def save_fieldsfile(grids: Grid | list[Grid], path: str, accuracy: int | None = None, **_) -> None:
    """Write fields as a fieldsfile of 64-bit words: fixed header, lookup table, data on sector boundaries."""
    grids = [grids] if isinstance(grids, Grid) else list(grids)
    heads = [(g, *_heads(g)) for g in grids]
    count = sum(len(h) for _, _, h in heads)
    start = -(-(FIELDS_HEADER + count * LOOKUP) // SECTOR_WORDS) * SECTOR_WORDS
    fixed = np.full(FIELDS_HEADER, -32768, ">i8")
    fixed[[0, 1, 3, 4, 8]] = 20, 1, 0, 3, 3
    fixed[LOOKUP_TABLE : LOOKUP_TABLE + 3] = FIELDS_HEADER + 1, LOOKUP, count
    fixed[159] = start + 1
    entries, at = [], start
    with created(grids[0].spark, path + ".data") as stream:
        for g, lead, own in heads:
            for (ints, reals), body in zip(own, _bodies(g, lead, accuracy)):
                body = np.frombuffer(body, ">f4").astype(">f8").tobytes() if accuracy is None else body + bytes(-len(body) % 8)
                words = len(body) // 8
                sectors = -(-words // SECTOR_WORDS) * SECTOR_WORDS
                for k, v in (("lblrec", words), ("lbpack", 0 if accuracy is None else 1), ("lbegin", at), ("lbnrec", words if accuracy is not None else sectors)):
                    ints[WORDS[k]] = v
                entries.append(_encoded(ints, reals, ">", 8))
                stream.write(body + bytes((sectors - words) * 8))
                at += sectors
    _joined_files(grids[0].spark, path, fixed.tobytes() + b"".join(entries) + bytes((start - FIELDS_HEADER - count * LOOKUP) * 8), path + ".data")


def _joined_files(spark: SparkSession, path: str, head: bytes, rest: str) -> None:
    """``head`` and then another file, which is removed, as one file; copied inside the JVM."""
    from .store import _filesystem

    fs, at = _filesystem(spark, rest)
    with created(spark, path) as stream:
        stream.write(head)
        source = fs.open(at)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
        source.close()
    fs.delete(at, False)


add_format(Format(6, "PP", lambda p, b: b[:4] in (b"\0\0\1\0", b"\0\1\0\0"), load_pp, wants_constraints=True))
add_format(Format(6, "fieldsfile", lambda p, b: b in (b"\0" * 7 + b"\x0f", b"\0" * 7 + b"\x14") or b[:4] in (b"\0\0\0\x0f", b"\0\0\0\x14"), load_fieldsfile, wants_constraints=True))
add_writer("pp", save_pp)
add_writer("ff", save_fieldsfile)

"""Queries of single operators beside the headline families, each over whole tables, with the SQL of the same rows.

Files that a query writes lie in a folder of their own below the shared one.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .frame import Cell, Coord, Grid, equal_points, index, join_table, local_table
from .functions import aggregators as A
from .functions import axes, projections
from .functions import calendar as C
from .functions import spherical as S
from .functions import systems as T
from .functions import vertical as V
from .operators import collection, combine, interpolate, maths, mesh, reduce, regrid, shape, stats, subset
from .queries import ORACLES, QUERIES, r, rows, query
from .sources import bytesio, dispersion, mesh_files, netcdf3, nimrod, pp, raster, shapefile, store
from .streaming import events


def _at(spark: SparkSession, name: str) -> str:
    return f"{events.scratch_dir(spark)}/{uuid.uuid4().hex}/{name}"


def _places(grid: Grid, digits: int = 6) -> DataFrame:
    """The unmasked cells with their indices as bigints."""
    return grid.df.where("v is not null").select(*(F.col(index(d)).cast("bigint").alias(d) for d in grid.dims), (F.round("v", digits) + F.lit(0.0)).alias("v"))


# Files: written whole, read back, compared with the table they came from.

_SALES_ROWS = f"WITH {X.SALES} SELECT month, supp, {r('v')} FROM sa"
_WORLD_ROWS = f"WITH {X.WORLD} SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, {r('v')} FROM wo"
_WORLD_SINGLE = f"WITH {X.WORLD} SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, {r('CAST(CAST(v AS FLOAT) AS DOUBLE)')} FROM wo"


@query("load_raw_folders", _SALES_ROWS)
def load_raw_folders(spark, d):
    """Three fields below one folder, read as they are stored."""
    g, at = X.sales(spark, d), _at(spark, "parts.grid")
    store.save([g[:20], g[20:50], g[50:]], at)
    parts = store.load_raw(spark, at)
    return rows(combine.concatenate_one(parts), month="month", supp="supp")


@query("load_constraint_callback", f"WITH {X.SALES}, {X.QUANTITY} SELECT 'read' AS mark, month, supp, {r('v')} FROM qu WHERE supp % 2 = 0")
def load_constraint_callback(spark, d):
    """Two fields in two files found by a pattern; a callback marks each and leaves one out; a constraint cuts the other."""
    at = _at(spark, "")
    for g, name in ((X.sales(spark, d), "a"), (X.quantity(spark, d), "b")):
        store.save(g, f"{at}{name}.grid")

    def callback(g, path):
        if g.name() == "sales":
            raise store.IgnoreField
        return replace(g, attributes={"mark": "read"})

    (g,) = store.load(spark, f"{at}*.grid", subset.Constraint(supp=lambda c: c.point % 2 == 0), callback)
    return rows(g, month="month", supp="supp").select(F.lit(g.attributes["mark"]).alias("mark"), "month", "supp", "v")


@query("load_one_of_many", f"WITH {X.QUANTITY} SELECT month, supp, {r('v')} FROM qu")
def load_one_of_many(spark, d):
    at = _at(spark, "both.grid")
    store.save([X.sales(spark, d), X.quantity(spark, d)], at)
    return rows(store.load_one(spark, at, "quantity"), month="month", supp="supp")


@query("load_each_constraint", f"WITH {X.SALES}, {X.QUANTITY} SELECT 'sales' AS name, {r('sum(v)', 2)} FROM sa UNION ALL SELECT 'quantity', {r('sum(v)', 2)} FROM qu")
def load_each_constraint(spark, d):
    at = _at(spark, "both.grid")
    store.save([X.quantity(spark, d), X.sales(spark, d)], at)
    out = None
    for g in store.load_each(spark, at, ["sales", "quantity"]):
        own = rows(g.collapsed(["month", "supp"], A.SUM), 2).select(F.lit(g.name()).alias("name"), "v")
        out = own if out is None else out.unionByName(own)
    return out


@query("save_packed", f"WITH {X.WORLD} SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, {r('round((v - 20) / 0.001) * 0.001 + 20', 3)} FROM wo")
def save_packed(spark, d):
    """Cells stored as integers with a scale and an offset."""
    g, at = X.world(spark, d), _at(spark, "packed.grid")
    store.save_field(g, at, packing=(0.001, 20.0))
    return rows(store.load_field(spark, at), 3, latitude="latitude", longitude="longitude")


@query("netcdf_round_trip", _SALES_ROWS)
def netcdf_round_trip(spark, d):
    at = _at(spark, "sales.nc")
    store.save(X.sales(spark, d), at)
    with store.chunks(spark, 1 << 20):
        g = store.load_one(spark, at, "sales")
        return rows(g, month="month", supp="supp")


@query("netcdf_coordinates", "SELECT name, n, units FROM (VALUES ('latitude', CAST(18 AS BIGINT), 'degrees'), ('longitude', 36, 'degrees')) t(name, n, units)")
def netcdf_coordinates(spark, d):
    at = _at(spark, "world.nc")
    store.save(X.world(spark, d), at)
    g = store.load_one(spark, at)
    own = [(c.name(), len(c.points), c.units) for c in g.coords if c.is_dim and c.bounds is not None and axes.is_contiguous(c)]
    return local_table(spark, own, "name string, n long, units string")


@query("netcdf_header", "SELECT name, kind, n FROM (VALUES ('latitude', '>f8', CAST(18 AS BIGINT)), ('longitude', '>f8', 36), ('latitude_bnds', '>f8', 36), ('longitude_bnds', '>f8', 72), ('quantity', '>f8', 648)) t(name, kind, n)")
def netcdf_header(spark, d):
    at = _at(spark, "world.nc")
    store.save(X.world(spark, d), at)
    return netcdf3.header_facts(spark, at).select("name", "kind", F.expr("aggregate(shape, 1L, (a, x) -> a * x)").alias("n"))


def _as_pp(g: Grid) -> Grid:
    return replace(g, attributes={"STASH": "m01s03i236"})


@query("pp_round_trip", _WORLD_SINGLE)
def pp_round_trip(spark, d):
    """32-bit records with a header of the grid."""
    at = _at(spark, "world.pp")
    store.save(_as_pp(X.world(spark, d)), at)
    return rows(store.load_one(spark, at), latitude="latitude", longitude="longitude")


@query("pp_records", "SELECT CAST(3236 AS BIGINT) AS lbuser4, CAST(18 AS BIGINT) AS lbrow, CAST(36 AS BIGINT) AS lbnpt, CAST(10 AS DOUBLE) AS bdx, CAST(1 AS BIGINT) AS n")
def pp_records(spark, d):
    """The headers of a file as a table."""
    at = _at(spark, "world.pp")
    store.save(_as_pp(X.world(spark, d)), at)
    return pp.field_table(spark, at).groupBy("lbuser4", "lbrow", "lbnpt", "bdx").agg(F.count("*").alias("n"))


@query("pp_time_levels", f"""WITH {X.WORLD}, k AS (SELECT unnest(range(0, 3)) AS t), z AS (SELECT unnest(range(0, 2)) AS z)
    SELECT CAST(t * 6 AS DOUBLE) AS time, CAST(500 + 350 * z AS DOUBLE) AS level, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, {r('CAST(CAST(v + (t * 8 + z * 64) AS FLOAT) AS DOUBLE)')} FROM wo, k, z""")  # fmt: skip
def pp_time_levels(spark, d):
    """Records of three times and two levels, written one by one, collated by their headers into two dimensions."""
    g, folder = X.world(spark, d), _at(spark, "")
    for t in range(3):
        for z in range(2):
            own = _as_pp(g + float(t * 8 + z * 64))
            own = replace(own, coords=(*g.coords, Coord(standard_name="time", units="hours since 1970-01-01", points=np.array(t * 6.0), dims=()), Coord(standard_name="air_pressure", units="hPa", points=np.array(500.0 + 350 * z), dims=())))
            store.save(replace(own, attributes={"STASH": "m01s03i236"}), f"{folder}{t}{z}.pp")
    made = store.load_one(spark, f"{folder}*.pp")
    return rows(made, time="time", level="air_pressure", latitude="latitude", longitude="longitude")


_MONTH_ROWS = f"WITH {X.MONTHS} SELECT CAST(month * 720 AS DOUBLE) AS time, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, {r('v')} FROM wm"


@query("fieldsfile_load", _MONTH_ROWS)
def fieldsfile_load(spark, d):
    """A record a month in a file of 64-bit words, collated into a time dimension and read by ranges."""
    at = _at(spark, "months.ff")
    store.save(X.world_months(spark, d), at)
    return rows(store.load_one(spark, at, "precipitation_flux"), time="time", latitude="latitude", longitude="longitude")


@query("fieldsfile_packed", _MONTH_ROWS)
def fieldsfile_packed(spark, d):
    """Whole numbers packed row by row to the nearest one."""
    at = _at(spark, "packed.ff")
    store.save(X.world_months(spark, d), at, accuracy=0)
    return rows(store.load_one(spark, at), time="time", latitude="latitude", longitude="longitude")


@query("pp_packed", _MONTH_ROWS)
def pp_packed(spark, d):
    at = _at(spark, "packed.pp")
    store.save(X.world_months(spark, d), at, accuracy=0)
    return rows(store.load_one(spark, at), time="time", latitude="latitude", longitude="longitude")


@query("pp_to_netcdf", _MONTH_ROWS)
def pp_to_netcdf(spark, d):
    """Loaded from records, saved as netCDF, loaded again."""
    at = _at(spark, "")
    store.save(X.world_months(spark, d), f"{at}months.pp")
    store.save(store.load_one(spark, f"{at}months.pp"), f"{at}months.nc")
    return rows(store.load_one(spark, f"{at}months.nc"), time="time", latitude="latitude", longitude="longitude")


@query("raster_round_trip", _WORLD_SINGLE)
def raster_round_trip(spark, d):
    at = _at(spark, "world.tif")
    store.save(X.world(spark, d), at)
    return rows(raster.load_raster(spark, at), latitude="latitude", longitude="longitude")


@query("dispersion_read", f"WITH {X.WORLD} SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, 'g/m3' AS units, {r('v * 2', 4)} FROM wo")
def dispersion_read(spark, d):
    """A text file of two columns; the second is read."""
    g, at = X.world(spark, d), _at(spark, "field.txt")
    heads = {"Species Category": "TRACER", "Name": "n", "Quantity": "Air Concentration", "Species": "S", "Units": "g/m3", "Time": "01/01/2020  00:00 UTC"}
    lines = ["NAME III (version 6.3)", "Run time: 01/01/2020", "X grid origin: 5.0", "Y grid origin: -85.0", "X grid size: 36", "Y grid size: 18", "X grid resolution: 10.0", "Y grid resolution: 10.0", "Number of preliminary cols: 4", "Number of field cols: 2", "", "Fields:"]
    lines += [", , , , " + ", ".join([heads.get(k, "")] * 2) + "," for k in dispersion.FIELD_ROWS]
    lines += [f"{x + 1}.5, {y + 1}.5, {5 + 10 * x}.0, {-85 + 10 * y}.0, {v!r}, {2 * v!r}," for y, x, v in ((c.i_latitude, c.i_longitude, c.v) for c in g.df.collect())]
    fs, target = store._filesystem(spark, at)
    stream = fs.create(target, True)
    stream.write(("\n".join(lines) + "\n").encode())
    stream.close()
    made = store.load_raw(spark, at)[1]
    return rows(made, 4, latitude="latitude", longitude="longitude").select("latitude", "longitude", F.lit(made.units).alias("units"), "v")


@query("nimrod_round_trip", _WORLD_SINGLE)
def nimrod_round_trip(spark, d):
    at = _at(spark, "world.nimrod")
    store.save(X.world(spark, d), at)
    return rows(store.load_one(spark, at), latitude="latitude", longitude="longitude")


@query("load_problems", f"WITH {X.WORLD} SELECT 'record 1' AS part, count(*) AS loaded FROM wo")
def load_problems(spark, d):
    """Of two records the second has values of an unknown kind: it is noted, the first is loaded."""
    at, both = _at(spark, "one.nimrod"), _at(spark, "two.nimrod")
    store.save(X.world(spark, d), at)
    first = bytes(spark.read.format("binaryFile").load(at).head().content)
    second = bytearray(first)
    second[4 + 2 * nimrod.KIND : 6 + 2 * nimrod.KIND] = b"\0\x09"
    with bytesio.created(spark, both) as stream:
        stream.write(first + bytes(second))
    with store.captured_problems() as found:
        (g,) = store.load_raw(spark, both)
    return g.df.agg(F.count("v").alias("loaded")).select(F.lit(found[0].part).alias("part"), "loaded")


@query("shapefile_mask", f"WITH {X.WORLD} SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, {r('v')} FROM wo WHERE longitude BETWEEN 30 AND 120 AND latitude BETWEEN -40 AND 30 AND NOT (longitude BETWEEN 60 AND 80 AND latitude BETWEEN -10 AND 10)")
def shapefile_mask(spark, d):
    """A polygon with a hole, read from a file."""
    at = _at(spark, "area.shp")
    outer, hole = [(30, -40), (30, 30), (120, 30), (120, -40), (30, -40)], [(60, -10), (80, -10), (80, 10), (60, 10), (60, -10)]
    with bytesio.created(spark, at) as stream:
        stream.write(shapefile.polygon_file([[outer, hole]]))
    return rows(shapefile.mask_outside_shapefile(X.world(spark, d), at, 0.5), latitude="latitude", longitude="longitude")


@query("mesh_file_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS loc, CAST((1.0 + n_nationkey % 3) * (2.0 + n_nationkey % 2) AS DOUBLE) AS area FROM nation")
def mesh_file_round_trip(spark, d):
    at = _at(spark, "mesh.nc")
    mesh_files.save_mesh(_nation_mesh(spark, d), at)
    return mesh_files.load_mesh(spark, at).face_areas().select(F.col("loc").cast("bigint"), (F.round("area", 6) + F.lit(0.0)).alias("area"))


@query("from_pandas", f"WITH {X.PLANE} SELECT x, y, {r('v')} FROM pl")
def from_pandas(spark, d):
    frame = X.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("x"), F.col("l_quantity").cast("bigint").alias("y")).agg(F.avg("l_extendedprice").alias("price")).toPandas()
    (g,) = store.from_pandas(spark, frame.set_index(["y", "x"])["price"])
    return rows(g, x="x", y="y")


@query("as_data_frame", f"WITH {X.PRICE} SELECT size, size * 10.0::DOUBLE AS height, round(v, 6) + 0.0 AS price FROM ps WHERE v IS NOT NULL")
def as_data_frame(spark, d):
    g = X.price_size(spark, d)
    g = g.with_coord(Coord(long_name="height", points=g.coord("size").points * 10.0, dims=("size",)))
    return store.as_table(g, aux=True).where("price is not null").select("size", "height", (F.round("price", 6) + F.lit(0.0)).alias("price"))


@query("xml_text", f"WITH {X.SALES} SELECT 'sales' AS name, count(*) AS cells, count(DISTINCT month) AS months, count(DISTINCT supp) AS supps FROM sa")
def xml_text(spark, d):
    """Name, shape and the count of cells, read back from the canonical text."""
    import xml.etree.ElementTree as E

    root = E.fromstring(collection.xml(X.sales(spark, d), checksum=True))
    months, supps = (int(x) for x in root.get("shape").strip("()").split(","))
    return local_table(spark, [(root.get("name"), int(root.get("cells")), months, supps)], "name string, cells long, months long, supps long")


@query("dot_text", "SELECT 'dim_month' AS node UNION ALL SELECT 'dim_supp' UNION ALL SELECT 'coord_0' UNION ALL SELECT 'coord_1'")
def dot_text(spark, d):
    import re

    return local_table(spark, [(n,) for n in sorted(set(re.findall(r"\b(?:dim_\w+|coord_\d+)\b", collection.dot(X.sales(spark, d)))))], "node string")


@query("summary_text", f"WITH {X.SALES} SELECT 'sales / (kg)  (month: ' || count(DISTINCT month) || '; supp: ' || count(DISTINCT supp) || ')' AS text FROM sa")
def summary_text(spark, d):
    return local_table(spark, [(X.sales(spark, d).summary(),)], "text string")


@query("field_digest", f"""WITH {X.SALES}, m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i FROM (SELECT DISTINCT month FROM sa)), s AS (SELECT supp, row_number() OVER (ORDER BY supp) - 1 AS j FROM (SELECT DISTINCT supp FROM sa))
    SELECT md5(string_agg(i || ',' || j || ',' || CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY i, j)) AS digest, count(*) AS n FROM sa JOIN m USING (month) JOIN s USING (supp)""")  # fmt: skip
def field_digest(spark, d):
    """A digest of all cells in order that SQL can compute as well."""
    cells = X.sales(spark, d).df.where("v is not null")
    text = F.concat_ws(",", F.col("i_month").cast("string"), F.col("i_supp").cast("string"), F.round(F.col("v") * 100).cast("bigint").cast("string"))
    ordered = cells.agg(F.array_sort(F.collect_list(F.struct("i_month", "i_supp", text.alias("t")))).alias("a"), F.count("*").alias("n"))
    return ordered.select(F.md5(F.array_join(F.col("a.t"), ";")).alias("digest"), "n")


@query("fingerprint_equality", f"WITH {X.SALES} SELECT count(*) AS n, true AS equal, false AS changed_equal FROM sa")
def fingerprint_equality(spark, d):
    """The checksum doesn't depend on the order of rows and does on every value.

    The cells are written once and read for each checksum: a sum of doubles
    differs in its last digits when it is computed again from parts that
    arrive in another order. The changed cell is the first that there is.
    """
    at = _at(spark, "cells.grid")
    store.save(X.sales(spark, d), at)
    g = store.load_one(spark, at)
    n, mark = g.fingerprint()
    same = g.with_df(g.df.repartition(7, "i_supp")).fingerprint() == (n, mark)
    cell = g.df.where("v is not null").agg(F.min(F.struct("i_month", "i_supp"))).head()[0]
    other = False
    if cell:
        here = (F.col("i_month") == cell.i_month) & (F.col("i_supp") == cell.i_supp)
        more = F.col("v") + F.greatest(F.lit(1e-6), F.abs("v") * 1e-12)
        other = g.with_df(g.df.withColumn("v", F.when(here, more).otherwise(F.col("v")))).fingerprint()[1] == mark
    return local_table(spark, [(n, same, other)], "n long, equal boolean, changed_equal boolean")


# Constraints, lists, slices.


@query("constraint_and", f"WITH {X.SALES} SELECT month, supp, {r('v')} FROM sa WHERE month % 2 = 0 AND supp % 3 = 1")
def constraint_and(spark, d):
    even, third = subset.Constraint(month=lambda c: c.point % 2 == 0), subset.Constraint(supp=lambda c: c.point % 3 == 1)
    return rows(X.sales(spark, d).extract(even & third), month="month", supp="supp")


def _flagged(spark, d) -> list[Grid]:
    """Quantity by line for each return flag, with attributes."""
    df = X.table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").cast("bigint").alias("line")).agg(F.sum("l_quantity").alias("v"))
    return [
        Grid.from_table(df.where(F.col("l_returnflag") == f), {"line": np.arange(1, 8)}, "v", long_name=n, attributes={"flag": f, "table": "lineitem"}).with_coord(Coord(long_name="code", points=np.array(ord(f)), dims=()))
        for f, n in (("R", "returned"), ("A", "accepted"), ("N", "none"))
    ]


_FLAG_ROWS = "SELECT CAST(l_linenumber AS BIGINT) AS line, " + r("sum(l_quantity)", 2) + " FROM lineitem WHERE l_returnflag {0} GROUP BY 1"


@query("attribute_constraint", _FLAG_ROWS.format("= 'A'"))
def attribute_constraint(spark, d):
    return rows(subset.extract_one(_flagged(spark, d), subset.AttributeConstraint(flag="A", table=lambda t: t.startswith("line"))), 2, line="line")


@query("name_constraint", _FLAG_ROWS.format("= 'R'"))
def name_constraint(spark, d):
    return rows(subset.extract_one(_flagged(spark, d), subset.NameConstraint(long_name="returned", standard_name=None)), 2, line="line")


@query("list_extract", "SELECT l_returnflag AS flag, " + r("sum(l_quantity)", 2) + " FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1")
def list_extract(spark, d):
    found = collection.GridList(_flagged(spark, d)).extract_each(["none", "accepted"])
    out = None
    for g in found:
        own = rows(g.collapsed("line", A.SUM), 2).select(F.lit(g.attributes["flag"]).alias("flag"), "v")
        out = own if out is None else out.unionByName(own)
    return out


@query("between_test", f"WITH {X.PRICE} SELECT size, {r('v')} FROM ps WHERE size > 10 AND size <= 20 AND v IS NOT NULL")
def between_test(spark, d):
    g = X.price_size(spark, d)
    g = g.replace_coord(replace(g.coord("size"), bounds=None))
    return rows(g.extract(subset.Constraint(size=subset.between(10, 20, low_inclusive=False))), size="size")


@query("slices_over", "SELECT l_returnflag AS flag, CAST(l_linenumber AS BIGINT) AS line, " + r("sum(l_quantity)", 2) + " FROM lineitem GROUP BY ALL")
def slices_over(spark, d):
    whole = combine.merge_one([replace(g, long_name="quantity", attributes={}) for g in _flagged(spark, d)])
    out = None
    for g in subset.slices_over(whole, "code"):
        own = rows(g, 2, line="line").select(F.lit(chr(int(g.coord("code").points))).alias("flag"), "line", "v")
        out = own if out is None else out.unionByName(own)
    return out


@query("slices_of", f"WITH {X.PLANE} SELECT x, count(*) AS n, {r('max(v)')} FROM pl GROUP BY x")
def slices_of(spark, d):
    """One field of y for each x."""
    out = None
    for g in subset.slices(X.price_plane(spark, d), "y"):
        own = g.df.agg(F.count("v").alias("n"), (F.round(F.max("v"), 6) + F.lit(0.0)).alias("v")).select(F.lit(int(g.coord("x").points)).cast("bigint").alias("x"), "n", "v")
        out = own if out is None else out.unionByName(own)
    return out


@query("extent_intersection", f"WITH {X.WORLD} SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, {r('v')} FROM wo WHERE longitude BETWEEN 90 AND 180")
def extent_intersection(spark, d):
    g = X.world(spark, d)
    return rows(subset.intersect_all(g, subset.Extent("longitude", 90, 180), ignore_bounds=True), latitude="latitude", longitude="longitude")


@query("cell_arithmetic", f"WITH {X.PRICE} SELECT size, CAST((size + 3) % 7 AS DOUBLE) AS point, CAST((size + 2.5) % 7 AS DOUBLE) AS lo FROM ps")
def cell_arithmetic(spark, d):
    """Cells shifted by three, modulo seven."""
    c = X.price_size(spark, d).coord("size")
    own = [(int(cell.point), float(((cell + 3) % 7).point), float(((cell + 3) % 7).bound[0])) for cell in c.cells()]
    return X.price_size(spark, d).df.join(local_table(spark, [(k - 1, k, a, b) for k, a, b in own], "i_size int, size long, point double, lo double"), "i_size").select("size", "point", "lo")


@query("cell_hash_equality", f"WITH {X.PRICE} SELECT count(*) AS cells, count(DISTINCT size) AS distinct_cells FROM ps")
def cell_hash_equality(spark, d):
    g = X.price_size(spark, d)
    there = {x.i_size for x in g.df.where("v is not null").collect()}
    cells = [c for k, c in enumerate(g.coord("size").cells()) if k in there]
    return local_table(spark, [(len(cells), len({Cell(c.point, c.bound) for c in cells + cells}))], "cells long, distinct_cells long")


# Shape and components.


@query("promote_demote", f"WITH {X.PRICE} SELECT CAST(100 - size AS BIGINT) AS depth, {r('v')} FROM ps WHERE v IS NOT NULL")
def promote_demote(spark, d):
    g = X.price_size(spark, d)
    g = shape.promote(g.with_coord(Coord(long_name="depth", points=100 - g.coord("size").points, dims=("size",))), "depth")
    assert g.dim_coord("size").name() == "depth" and not g.coord("size").is_dim
    return rows(shape.promote(shape.demote(g, "depth"), "depth"), depth="depth")


@query("component_edits", f"WITH {X.SALES} SELECT month, supp * 2 AS double_supp, {r('v')} FROM sa")
def component_edits(spark, d):
    """A coordinate added, another replaced, a third removed."""
    g = X.sales(spark, d)
    c = g.coord("supp")
    g = g.with_coord(Coord(long_name="double_supp", points=c.points, dims=c.dims)).with_coord(Coord(long_name="gone", points=c.points, dims=c.dims, role="ancillary"))
    g = g.replace_coord(replace(g.coord("double_supp"), points=c.points * 2)).without_coord("gone")
    assert not g.find("gone") and g.find(role="ancillary") == []
    return rows(g, month="month", double_supp="double_supp")


@query("component_lookup", "SELECT * FROM (VALUES ('x', 'longitude', true), ('y', 'latitude', true), ('t', 'day', true)) t(axis, name, is_dim)")
def component_lookup(spark, d):
    world, orders = X.world(spark, d), X.orders_day(spark, d)
    found = [("x", world.coord(axis="x", is_dim=True)), ("y", world.coord(axis="y")), ("t", orders.coord(axis="t"))]
    return local_table(spark, [(a, c.name(), c.is_dim) for a, c in found], "axis string, name string, is_dim boolean")


@query("dimension_mapping", "SELECT * FROM (VALUES ('day', 'day', CAST(0 AS BIGINT)), ('event_type', 'event_type', 1), ('user_id', 'user_id', 2)) t(name, dim, place)")
def dimension_mapping(spark, d):
    g = X.events_day(spark, d)
    return local_table(spark, [(c.name(), g.dims_of(c)[0], list(g.dims).index(g.dims_of(c)[0])) for c in g.coords], "name string, dim string, place long")


@query("component_listing", f"WITH {X.EVENTS} SELECT name, n FROM (SELECT 'event_type' AS name, count(DISTINCT event_type) AS n FROM ev UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM ev UNION ALL SELECT 'day', max(day) - min(day) + 1 FROM ev)")
def component_listing(spark, d):
    return local_table(spark, [(c.name(), c.points.size) for c in X.events_day(spark, d).find(role="coord")], "name string, n long")


@query("equality_and_compatibility", "SELECT true AS equal, false AS changed_equal, true AS compatible, false AS other_units_compatible")
def equality_and_compatibility(spark, d):
    g = X.sales(spark, d)
    changed = g.with_df(g.df.withColumn("v", F.when(F.col("i_supp") == 2, F.col("v") + 1).otherwise(F.col("v"))))
    found = (g.equals(X.sales(spark, d)), g.equals(changed), g.is_compatible(changed), g.is_compatible(replace(g, units="m")))
    return local_table(spark, [found], "equal boolean, changed_equal boolean, compatible boolean, other_units_compatible boolean")


@query("rename_and_clear", "SELECT 'turnover' AS name, 'unknown' AS cleared")
def rename_and_clear(spark, d):
    g = X.sales(spark, d)
    return local_table(spark, [(shape.rename(g, "turnover").name(), shape.clear_identity(g).name())], "name string, cleared string")


@query("describe_diff", "SELECT 'name: sales / quantity' AS line UNION ALL SELECT 'units: kg / m'")
def describe_diff(spark, d):
    return local_table(spark, [(x,) for x in shape.describe_diff(X.sales(spark, d), X.quantity(spark, d))], "line string")


@query("metadata_difference", "SELECT * FROM (VALUES ('long_name', 'sales', 'quantity'), ('units', 'kg', 'm')) t(key, a, b)")
def metadata_difference(spark, d):
    found = collection.metadata_difference(X.sales(spark, d), X.quantity(spark, d))
    return local_table(spark, [(k, str(a), str(b)) for k, (a, b) in found.items()], "key string, a string, b string")


@query("metadata_combine", "SELECT 'sales' AS name, CAST(1 AS BIGINT) AS lenient, CAST(0 AS BIGINT) AS strict, 'unknown' AS units")
def metadata_combine(spark, d):
    a = replace(X.sales(spark, d), attributes={"only": "a", "both": 1})
    b = replace(a, attributes={"both": 2}, units="m")
    soft, hard = collection.combine_metadata(a, b), collection.combine_metadata(a, b, lenient=False)
    return local_table(spark, [(soft.name(), len(soft.attributes), len(hard.attributes), hard.units)], "name string, lenient long, strict long, units string")


@query("metadata_filter", "SELECT 'accepted' AS name UNION ALL SELECT 'none'")
def metadata_filter(spark, d):
    found = collection.find_metadata(_flagged(spark, d), attributes={"table": "lineitem"}, test=lambda g: g.attributes["flag"] < "R")
    return local_table(spark, [(g.name(),) for g in found], "name string")


@query("attribute_split", "SELECT 'title' AS key, 'file' AS place UNION ALL SELECT 'flag', 'field'")
def attribute_split(spark, d):
    own, wide = collection.split_attributes(collection.checked_attributes({"title": "t", "flag": "A"}))
    return local_table(spark, [(k, "field") for k in own] + [(k, "file") for k in wide], "key string, place string")


@query("list_container", "SELECT 'none' AS name, CAST(0 AS BIGINT) AS place UNION ALL SELECT 'returned', 1 UNION ALL SELECT 'accepted', 2")
def list_container(spark, d):
    a, b, c = _flagged(spark, d)
    own = collection.GridList([a])
    own.append(b)
    own.insert(0, c)
    own = own[:1] + own[1:].copy()
    return local_table(spark, [(g.name(), k) for k, g in enumerate(own)], "name string, place long")


@query("coordinate_constructor", "SELECT CAST(5 + 10 * k AS DOUBLE) AS point, CAST(10 * k AS DOUBLE) AS lo, CAST(10 * k + 10 AS DOUBLE) AS hi FROM (SELECT unnest(range(0, 36)) AS k)")
def coordinate_constructor(spark, d):
    c = Coord.regular(-5.0, 10.0, 36, "x", with_bounds=True, standard_name="longitude", units="degrees")
    return local_table(spark, [(float(cell.point), *map(float, cell.bound)) for cell in c.cells()], "point double, lo double, hi double")


@query("coordinate_units", f"WITH {X.WORLD} SELECT CAST(longitude AS DOUBLE) AS longitude, round(radians(longitude), 9) + 0.0 AS radians FROM wo GROUP BY longitude")
def coordinate_units(spark, d):
    c = X.world(spark, d).coord("longitude")
    return local_table(spark, list(zip(c.points.tolist(), np.round(c.with_units("radians").points, 9).tolist())), "longitude double, radians double")


@query("coordinate_checks", "SELECT * FROM (VALUES ('contiguous', true), ('regular', true), ('monotonic', true), ('closes', true), ('discontiguous', false)) t(test, passed)")
def coordinate_checks(spark, d):
    g = X.world(spark, d)
    x, y = g.coord("longitude"), g.coord("latitude")
    gap = replace(y, bounds=y.bounds + np.where(np.arange(18) < 9, 0.0, 0.5)[:, None])
    from .frame import monotonic

    found = [("contiguous", axes.is_contiguous(y)), ("regular", axes.is_regular(x)), ("monotonic", monotonic(y.points)), ("closes", axes.is_contiguous(x)), ("discontiguous", axes.is_contiguous(gap) or axes.discontiguities(gap).sum() != 1)]
    return local_table(spark, [(k, bool(v)) for k, v in found], "test string, passed boolean")


@query("coordinate_agreement", "SELECT true AS same, false AS moved, false AS without_bounds")
def coordinate_agreement(spark, d):
    c = X.world(spark, d).coord("latitude")
    return local_table(spark, [(equal_points(c, replace(c)), equal_points(c, replace(c, points=c.points + 1e-9)), equal_points(c, replace(c, bounds=None)))], "same boolean, moved boolean, without_bounds boolean")


@query("coordinate_digest", "SELECT true AS equal, false AS other")
def coordinate_digest(spark, d):
    c = X.world(spark, d).coord("latitude")
    return local_table(spark, [(collection.hexdigest(c.points) == collection.hexdigest(c.points.copy()), collection.hexdigest(c.points) == collection.hexdigest(c.points + 1))], "equal boolean, other boolean")


@query("is_masked", f"WITH {X.EVENTS}, {X.WORLD} SELECT count(v) < (max(day) - min(day) + 1) * count(DISTINCT event_type) * count(DISTINCT user_id) AS events, (SELECT count(*) FROM wo) < 648 AS world FROM ev")
def is_masked(spark, d):
    return local_table(spark, [(collection.is_masked(X.events_day(spark, d)), collection.is_masked(X.world(spark, d)))], "events boolean, world boolean")


@query("clip_text", "SELECT o_orderpriority AS text, CASE WHEN length(o_orderpriority) <= 6 THEN o_orderpriority ELSE substr(o_orderpriority, 1, 6) || '...' END AS clipped FROM orders GROUP BY 1")
def clip_text(spark, d):
    kinds = [x[0] for x in X.table(spark, d, "orders").select("o_orderpriority").distinct().collect()]
    return local_table(spark, [(t, collection.clip_string(t.replace(" ", "_"), 6).replace("_", " ")) for t in kinds], "text string, clipped string")


@query("rule_helpers", "SELECT 'code' AS scalar, 'line' AS vector, 'line: sum' AS method, true AS none")
def rule_helpers(spark, d):
    g = _flagged(spark, d)[0]
    low = g.collapsed("line", A.SUM)
    found = (collection.scalar_coord(g, "code").name(), collection.vector_coord(g, "line").name(), str(collection.cell_method_of(low, "sum", "line")), collection.scalar_coord(g, "line") is None and collection.vector_coord(g, "code") is None)
    return local_table(spark, [found], "scalar string, vector string, method string, none boolean")


# Reductions of coordinates, and what they record.


@query("coordinate_collapse", f"WITH {X.SALES} SELECT CAST(min(month) AS DOUBLE) AS lo, CAST(max(month) AS DOUBLE) AS hi, CAST(floor((min(month) + max(month)) / 2.0) AS BIGINT) AS point FROM sa")
def coordinate_collapse(spark, d):
    c = reduce.collapsed_coord(X.sales(spark, d).coord("month"), {"month"})
    return local_table(spark, [(float(c.bounds[0]), float(c.bounds[1]), int(c.points))], "lo double, hi double, point long")


@query("text_collapse", "SELECT string_agg(event_type, '|' ORDER BY event_type) AS text FROM (SELECT DISTINCT event_type FROM events)")
def text_collapse(spark, d):
    c = reduce.collapsed_coord(X.events_day(spark, d).coord("event_type"), {"event_type"})
    return local_table(spark, [(str(c.points),)], "text string")


@query("grouped_bounds", f"WITH {X.SALES}, y AS (SELECT 1970 + month // 12 AS year, min(month) AS lo, max(month) AS hi FROM sa GROUP BY 1) SELECT CAST(year AS BIGINT) AS year, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, (lo + hi) / 2.0 AS point FROM y")
def grouped_bounds(spark, d):
    """The range of months that each year's cell covers."""
    g = X.sales(spark, d)
    g = g.with_coord(Coord(long_name="year", points=1970 + g.coord("month").points // 12, dims=("month",))).aggregated_by("year", A.SUM)
    m, y = g.coord("month"), g.coord("year")
    return local_table(spark, [(int(a), float(lo), float(hi), float(p)) for a, (lo, hi), p in zip(y.points, m.bounds, m.points)], "year long, lo double, hi double, point double")


@query("cell_methods", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'month: mean'), (1, 'supp: maximum')) t(place, text)")
def cell_methods(spark, d):
    g = X.sales(spark, d).collapsed("month", A.MEAN).collapsed("supp", A.MAX)
    return local_table(spark, [(k, str(m)) for k, m in enumerate(g.cell_methods)], "place long, text string")


@query("returned_weights", f"WITH {X.SALES}, {X.QUANTITY} SELECT month, {r('sum(qu.v)', 2)} FROM sa JOIN qu USING (month, supp) GROUP BY month")
def returned_weights(spark, d):
    _, sums = X.sales(spark, d).collapsed("supp", A.MEAN, weights=X.quantity(spark, d), returned=True)
    return rows(sums, 2, month="month")


# Maths, calculus, cumulative functions.


@query("coordinate_arithmetic", f"WITH {X.PRICE} SELECT size, CAST(size * 2.5 AS DOUBLE) AS point, CAST((size - 0.5) * 2.5 AS DOUBLE) AS lo FROM ps")
def coordinate_arithmetic(spark, d):
    g = X.price_size(spark, d)
    wide = maths.coord_maths(g.coord("size"), "multiply", 2.5)
    out = join_table(g.df.where("v is not null"), g, replace(wide, long_name="wide"), "point", bounds=True)
    return out.select((F.col("i_size") + 1).cast("bigint").alias("size"), "point", F.col("point_lo").alias("lo"))


@query("in_place_maths", f"WITH {X.PRICE} SELECT size, {r('(v + 1) * 3 - 2')} FROM ps WHERE v IS NOT NULL")
def in_place_maths(spark, d):
    g = X.price_size(spark, d)
    g += 1
    g *= 3
    g -= 2
    return rows(g, size="size")


@query("cumulative_function", f"WITH {X.SALES} SELECT month, supp, {r('max(v) OVER (PARTITION BY supp ORDER BY month)', 4)} FROM sa")
def cumulative_function(spark, d):
    return rows(maths.cumulative(X.sales(spark, d), "month", "max"), 4, month="month", supp="supp")


@query("cumulative_day", f"WITH {X.ORDERS} SELECT day, {r('sum(v) OVER (ORDER BY day)', 2)} FROM od")
def cumulative_day(spark, d):
    """One series, added up by blocks."""
    return rows(maths.cumulative(X.orders_day(spark, d), "day"), 2, day="day")


@query("rolling_long", f"WITH {X.ORDERS}, e AS (SELECT min(day) AS lo, max(day) AS hi FROM od), g AS (SELECT unnest(range(lo, hi - 363)) AS day FROM e) SELECT CAST(g.day + 182 AS DOUBLE) AS day, {r('sum(v)', 2)} FROM g JOIN od o ON o.day BETWEEN g.day AND g.day + 364 GROUP BY g.day")
def rolling_long(spark, d):
    """A window of a year over one series."""
    return rows(X.orders_day(spark, d).rolling_window("day", A.SUM, 365), 2, day="day")


@query("curl_of_three", f"""WITH {X.PLANE}, c AS (SELECT a.x, a.y, a.v AS a, b.v AS b, c.v AS c, e.v AS e FROM pl a JOIN pl b ON b.x = a.x + 1 AND b.y = a.y JOIN pl c ON c.x = a.x AND c.y = a.y + 1 JOIN pl e ON e.x = a.x + 1 AND e.y = a.y + 1)
    SELECT 'i' AS part, CAST(a.x AS DOUBLE) AS x, CAST(a.y + 0.5 AS DOUBLE) AS y, {r('2 * (c.v - a.v) - (a.v + c.v) / 2', 6)} FROM pl a JOIN pl c ON c.x = a.x AND c.y = a.y + 1
    UNION ALL SELECT 'k', CAST(x + 0.5 AS DOUBLE), CAST(y + 0.5 AS DOUBLE), {r('2 * ((b - a) + (e - c)) / 2 - ((c - a) + (e - b)) / 2', 6)} FROM c""")  # fmt: skip
def curl_of_three(spark, d):
    """(P, z P, 2 P) over x, y and z = 0, 1, 2: the first component at its first middle of z, the third at z = 2."""
    p = X.price_plane(spark, d)
    g = shape.broadcast_to(p, {"z": 3, **p.dims}).with_coord(Coord(long_name="z", units="m", points=np.arange(3.0), dims=("z",), is_dim=True))
    i, _, k = stats.curl3(g.named("x_wind"), (g * g.coord("z")).named("y_wind"), (g * 2.0).named("upward"), "x", "y", "z")
    parts = [rows(c[n], 6, x="x", y="y").select(F.lit(name).alias("part"), F.col("x").cast("double"), F.col("y").cast("double"), "v") for name, c, n in (("i", i, 0), ("k", k, 2))]
    return parts[0].unionByName(parts[1])


@query("wpercentile_kinds", f"""WITH {X.SALES}, {X.QUANTITY}, j AS (SELECT month, sa.v AS v, qu.v AS w FROM sa JOIN qu USING (month, supp)),
    c AS (SELECT month, v, (sum(w) OVER (PARTITION BY month ORDER BY v ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY month) AS p FROM j),
    b AS (SELECT *, lag(p) OVER (PARTITION BY month ORDER BY v) AS p0, lag(v) OVER (PARTITION BY month ORDER BY v) AS v0 FROM c),
    x AS (SELECT month, max(CASE WHEN p0 < 0.4 AND 0.4 <= p THEN CASE WHEN 0.4 - p0 <= p - 0.4 THEN v0 ELSE v END END) AS near, max(CASE WHEN p0 < 0.4 AND 0.4 <= p THEN v END) AS after FROM b GROUP BY month HAVING min(p) < 0.4 AND max(p) > 0.4)
    SELECT month, 'nearest' AS kind, {r('near')} FROM x UNION ALL SELECT month, 'next', {r('after')} FROM x""")  # fmt: skip
def wpercentile_kinds(spark, d):
    sales, weight = X.sales_and_quantity(spark, d)
    parts = [rows(sales.collapsed("supp", A.WPERCENTILE, weights=weight, percent=40, kind=k), month="month").select("month", F.lit(k).alias("kind"), "v") for k in ("nearest", "next")]
    return parts[0].unionByName(parts[1])


@query("vector_name", "SELECT 'wind' AS name")
def vector_name(spark, d):
    return local_table(spark, [(stats.spatial_name("x_wind", "y_wind"),)], "name string")


@query("pearsonr_own_masks", f"""WITH {X.EVENTS}, a AS (SELECT user_id, day, v FROM ev WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT user_id, day, v FROM ev WHERE event_type = (SELECT max(event_type) FROM events)),
    k AS (SELECT user_id, day FROM a UNION SELECT user_id, day FROM b), j AS (SELECT k.user_id, a.v AS x, b.v AS y FROM k LEFT JOIN a USING (user_id, day) LEFT JOIN b USING (user_id, day)),
    m AS (SELECT user_id, avg(x) AS mx, avg(y) AS my FROM j GROUP BY 1), s AS (SELECT user_id, sum((x - mx) * (y - my)) AS c, sqrt(sum((x - mx) * (x - mx)) * sum((y - my) * (y - my))) AS n FROM j JOIN m USING (user_id) GROUP BY 1)
    SELECT user_id, {r('c / n', 6)} FROM s WHERE c IS NOT NULL AND n > 0""")  # fmt: skip
def pearsonr_own_masks(spark, d):
    """Two event types by day: each mean and variance over its own days, the product over the days of both."""
    g = X.events_day(spark, d)
    kinds = sorted(g.coord("event_type").points.tolist())
    a, b = (g.extract(subset.Constraint(event_type=k)) for k in (kinds[0], kinds[-1]))
    return rows(stats.pearsonr(a, replace(b, coords=tuple(c for c in b.coords if c.dims)), "day"), 6, user_id="user_id")


@query("pearsonr_offset", f"""WITH {X.SALES}, {X.QUANTITY}, j AS (SELECT month, CAST(supp AS DOUBLE) AS w, sa.v / 1e3 AS a, qu.v AS b FROM sa JOIN qu USING (month, supp)), m AS (SELECT month, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM j GROUP BY 1)
    SELECT month, {r('sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) * (a - ma)) * sum(w * (b - mb) * (b - mb)))', 4)} FROM j JOIN m USING (month) GROUP BY month""")  # fmt: skip
def pearsonr_offset(spark, d):
    """A hundred million added to both fields changes nothing."""
    a, b = X.sales(spark, d) / 1e3 + 1e8, X.quantity(spark, d) + 1e8
    return rows(stats.pearsonr(a, b, "supp", weights="supp", common_mask=True), 4, month="month")


@query("relevel_with_gaps", f"""WITH {X.SALES}, e AS (SELECT min(month) AS m0 FROM sa), k AS (SELECT supp, month - m0 AS i, v FROM sa, e WHERE month % 5 <> 2), t AS (SELECT unnest([155.5, 333.25, 401.75]) AS t)
    SELECT a.supp, CAST(t AS DOUBLE) AS level, {r('a.v + (b.v - a.v) * (t - (a.i * 10.0 + a.supp)) / 10', 5)} FROM k a JOIN k b ON a.supp = b.supp AND b.i = a.i + 1 JOIN t ON t > a.i * 10.0 + a.supp AND t < b.i * 10.0 + b.supp""")  # fmt: skip
def relevel_with_gaps(spark, d):
    """Every fifth month is masked: nothing is interpolated across it."""
    g = X.sales(spark, d)
    m, s = g.coord("month").points, g.coord("supp").points
    g = subset.mask_where(g, Coord(long_name="gap", points=m % 5 == 2, dims=("month",)))
    levels = Coord(long_name="level", points=(m[:, None] - m.min()) * 10.0 + s[None, :], dims=("month", "supp"))
    return rows(interpolate.relevel(g, levels, [155.5, 333.25, 401.75], "month"), 5, supp="supp", level="level")


@query("relevel_by_field", f"""WITH {X.SALES}, {X.QUANTITY}, k AS (SELECT supp, month, sa.v AS v, qu.v AS z FROM sa JOIN qu USING (month, supp)), t AS (SELECT unnest([100.5, 333.5]) AS t),
    h AS (SELECT a.supp, t, a.month, a.v + (b.v - a.v) * (t - a.z) / (b.z - a.z) AS x FROM k a JOIN k b ON a.supp = b.supp AND b.month = a.month + 1 JOIN t ON t BETWEEN least(a.z, b.z) AND greatest(a.z, b.z) AND a.z <> b.z)
    SELECT supp, CAST(t AS DOUBLE) AS quantity, {r('min_by(x, month)', 6)} FROM h GROUP BY supp, t""")  # fmt: skip
def relevel_by_field(spark, d):
    """Levels that are a field: the sales at the first crossing of a quantity."""
    sales, quantity = X.sales_and_quantity(spark, d)
    return rows(interpolate.relevel(sales, quantity, [100.5, 333.5], "month"), 6, supp="supp", quantity="quantity")


# Calendars and categories.


@query("categorised_coordinate", f"WITH {X.ORDERS} SELECT CASE WHEN day % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, {r('max(v)')} FROM od GROUP BY 1")
def categorised_coordinate(spark, d):
    g = C.categorised(X.orders_day(spark, d), "parity", "day", lambda c, p: "odd" if p % 2 else "even")
    return rows(g.aggregated_by("parity", A.MAX), parity="parity")


@query("agg_by_hour", f"SELECT CAST(hour(ts) AS BIGINT) AS hour, {r('sum(value)', 8)} FROM events GROUP BY 1")
def agg_by_hour(spark, d):
    hours = F.expr("cast(timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', cast(date_trunc('HOUR', ts) as timestamp_ntz)) as bigint)")
    raw = X.table(spark, d, "events").withColumn("time", hours)
    g = Grid.from_table(raw.groupBy("time").agg(F.sum("value").alias("v")), {"time": None}, "v", source=raw, long_name="value")
    g = C.add_hour(g.replace_coord(replace(g.coord("time"), units="hours since 1970-01-01")), "time")
    return rows(g.aggregated_by("hour", A.SUM), 8, hour="hour")


@query("agg_by_season_number", f"WITH {X.ORDERS}, q AS (SELECT CAST(month(DATE '1970-01-01' + CAST(day AS INTEGER)) % 12 // 3 AS BIGINT) AS k, v FROM od) SELECT k AS season_number, {r('sum(v)', 2)} FROM q GROUP BY 1")
def agg_by_season_number(spark, d):
    return rows(C.add_season_number(X.orders_day(spark, d), "day").aggregated_by("season_number", A.SUM), 2, season_number="season_number")


@query("unify_time_units", f"WITH {X.ORDERS} SELECT CAST(day AS DOUBLE) AS day, {r('v')} FROM od")
def unify_time_units(spark, d):
    """The later half counts hours from another epoch; both come back in days of one."""
    g = X.orders_day(spark, d)
    n = g.dims["day"] // 2
    later = g[n:]
    c = later.coord("day")
    later = later.replace_coord(replace(c, points=(c.points - 10_957) * 24, units="hours since 2000-01-01"))
    return rows(combine.concatenate_one(C.unify_time_units([g[:n], later])), day="day")


@query("datetime_samples", f"WITH {X.ORDERS}, s AS (SELECT min(day) + 100 AS a FROM od) SELECT CAST(a + 0.5 AS DOUBLE) AS day, round((x.v + y.v) / 2, 4) + 0.0 AS v FROM s JOIN od x ON x.day = a JOIN od y ON y.day = a + 1")
def datetime_samples(spark, d):
    from datetime import datetime, timedelta

    g = X.orders_day(spark, d)
    when = datetime(1970, 1, 1) + timedelta(days=int(g.coord("day").points[0]) + 100, hours=12)
    return rows(g.interpolate([("day", [when])], interpolate.Linear()), 4, day="day")


# Combining.


@query("merge_cube", "SELECT CAST(ascii(l_returnflag) AS BIGINT) AS code, CAST(l_linenumber AS BIGINT) AS line, " + r("sum(l_quantity)", 2) + " FROM lineitem GROUP BY ALL")
def merge_cube(spark, d):
    parts = [replace(g, long_name="quantity", attributes={}) for g in _flagged(spark, d)]
    return rows(combine.merge_one(parts), 2, code="code", line="line")


@query("derived_space", "SELECT * FROM (VALUES ('time', true), ('level', true), ('label', false)) t(name, is_axis)")
def derived_space(spark, d):
    """Twelve places of three times and four levels; a label follows the level."""
    columns = {"label": [(f"l{k % 4}", None) for k in range(12)], "level": [(k % 4, None) for k in range(12)], "time": [(k // 4, None) for k in range(12)]}
    chosen, needs = combine.derived_space(columns)
    return local_table(spark, [(n, True) for n in chosen] + [(n, False) for n in needs], "name string, is_axis boolean")


@query("concatenate_cube", _SALES_ROWS)
def concatenate_cube(spark, d):
    g = X.sales(spark, d)
    n = g.dims["month"]
    return rows(combine.concatenate_one([g[k : k + 12] for k in range(0, n, 12)][::-1]), month="month", supp="supp")


@query("equalise_attributes", "SELECT l_returnflag AS flag, CAST(1 AS BIGINT) AS kept, CAST(1 AS BIGINT) AS taken FROM lineitem GROUP BY 1")
def equalise_attributes(spark, d):
    grids = _flagged(spark, d)
    kept, taken = combine.equalise_attributes(grids)
    return local_table(spark, [(t["flag"], len(g.attributes), len(t)) for g, t in zip(kept, taken)], "flag string, kept long, taken long")


@query("equalise_cubes", "SELECT CAST(ascii(l_returnflag) AS BIGINT) AS code, " + r("sum(l_quantity)", 2) + " FROM lineitem GROUP BY ALL")
def equalise_cubes(spark, d):
    """Fields that differ in attributes merge after they are equalised."""
    parts = [replace(g, long_name="quantity", var_name=f"q{k}") for k, g in enumerate(_flagged(spark, d))]
    (whole,) = combine.merge(combine.equalise(parts, normalise_names=True, attributes=True))
    return rows(whole.collapsed("line", A.SUM), 2, code="code")


@query("lazy_stack", f"WITH {X.PRICE} SELECT CAST(k AS BIGINT) AS k, size, {r('v * (k + 1)')} FROM ps, (SELECT unnest(range(0, 3)) AS k) WHERE v IS NOT NULL")
def lazy_stack(spark, d):
    g = X.price_size(spark, d)
    parts = [(g * float(k + 1)).with_coord(Coord(long_name="k", points=np.array(k), dims=())) for k in range(3)]
    return rows(combine.merge_one([replace(p, long_name="price") for p in parts]), k="k", size="size")


@query("realise_together", f"WITH {X.SALES}, {X.QUANTITY} SELECT {r('(SELECT sum(v) FROM sa) / (SELECT sum(v) FROM qu)', 6)}")
def realise_together(spark, d):
    with combine.realised([X.sales(spark, d), X.quantity(spark, d)]) as (a, b):
        top, low = (g.collapsed(["month", "supp"], A.SUM) for g in (a, b))
        value = maths.divide(top, low).df.head()[0]
    return local_table(spark, [(round(value, 6),)], "v double")


# Vertical formulas: price cells by size (the level) and nation (the place).

_LEVELS = f"WITH {X.PRICE}, f AS (SELECT size, CAST(n_nationkey AS BIGINT) AS nation, size / 50.0::DOUBLE AS s, n_nationkey * 0.25::DOUBLE AS eta, 100.0::DOUBLE + n_nationkey * 8 AS depth FROM ps, nation WHERE v IS NOT NULL) SELECT size, nation, round({{0}}, 6) + 0.0 AS height FROM f"


def _column(spark, d) -> Grid:
    g = shape.broadcast_to(X.price_size(spark, d), {"size": 50, "nation": 25})
    g = g.with_df(g.df.where("v is not null"))
    k, n = np.arange(1, 51), np.arange(25)
    parts = {"s": (k / 50.0, "size"), "down": (-k / 50.0, "size"), "c": (-((k / 50.0) ** 3), "size"), "thick": (k * 100.0, "size"), "zlev": (-2.0 * k, "size"), "level": (k - 1, "size"), "eta": (n * 0.25, "nation"), "depth": (100.0 + n * 8, "nation"), "surface": (100_000.0 + n * 50, "nation")}
    for name, (points, dim) in parts.items():
        g = g.with_coord(Coord(long_name=name, points=points, dims=(dim,)))
    return g


_FORMULAS = {
    "atmosphere_sigma": (lambda: V.atmosphere_sigma("s", "surface", 1000.0), "1000 + s * (100000.0 + nation * 50 - 1000)"),
    "hybrid_pressure": (lambda: V.hybrid_pressure("thick", "s", "surface"), "size * 100 + s * (100000.0 + nation * 50)"),
    "ocean_sigma": (lambda: V.ocean_sigma("down", "eta", "depth"), "eta + -s * (depth + eta)"),
    "ocean_sigma_z": (lambda: V.ocean_sigma_z("down", "eta", "depth", 150.0, 20, "zlev", "level"), "CASE WHEN size - 1 < 20 THEN eta + -s * (least(150.0, depth) + eta) ELSE -2.0 * size END"),
    "ocean_s_g1": (lambda: V.ocean_s_g1("down", "c", "eta", "depth", 50.0), "(50 * -s + (depth - 50) * -(s * s * s)) + eta * (1 + (50 * -s + (depth - 50) * -(s * s * s)) / depth)"),
    "ocean_s_g2": (lambda: V.ocean_s_g2("down", "c", "eta", "depth", 50.0), "eta + (eta + depth) * (50 * -s + depth * -(s * s * s)) / (50 + depth)"),
    "ocean_s": (lambda: V.ocean_s("down", "eta", "depth", 5.0, 0.4, 50.0), "eta * (1 - s) + 50 * -s + (depth - 50) * (0.6 * sinh(-5 * s) / sinh(5) + 0.4 * (tanh(5 * (0.5 - s)) / (2 * tanh(2.5)) - 0.5))"),
}


def _formula(make):
    def run(spark, d):
        out = V.derive(_column(spark, d), make(), "height")
        return out.select((F.col("i_size") + 1).cast("bigint").alias("size"), F.col("i_nation").cast("bigint").alias("nation"), (F.round("height", 6) + F.lit(0.0)).alias("height"))

    return run


for _name, (_make, _sql) in _FORMULAS.items():
    query(_name, _LEVELS.replace("{{0}}", _sql).replace("{0}", _sql))(_formula(_make))


@query("derived_from_field", f"WITH {X.SALES}, {X.QUANTITY} SELECT month, supp, round(1000 + qu.v / 1000 * (sa.v - 1000), 6) + 0.0 AS pressure FROM sa JOIN qu USING (month, supp)")
def derived_from_field(spark, d):
    """A formula whose dependencies are as large as the data."""
    sales, quantity = X.sales_and_quantity(spark, d)
    out = V.derive(sales, V.atmosphere_sigma(quantity / 1000.0, sales, 1000.0), "pressure")
    return rows(sales.with_df(out.select(*sales.keys(), F.col("pressure").alias("v"))), 6, month="month", supp="supp").withColumnRenamed("v", "pressure")


@query("derived_points", "SELECT CAST(n_nationkey AS BIGINT) AS nation, round(CAST(500 + (100000 + n_nationkey * 50) / 10 AS DOUBLE), 6) + 0.0 AS pressure FROM nation")
def derived_points(spark, d):
    """The derived coordinate as an array over its dependencies, at the fifth level."""
    c = V.derived_points(_column(spark, d), V.hybrid_pressure("thick", "s", "surface"))
    return local_table(spark, [(k, round(float(x), 6)) for k, x in enumerate(c.points[4])], "nation long, pressure double")


# Sphere.


@query("gridcell_angles", "SELECT CAST(n_nationkey AS BIGINT) AS nation, true AS east FROM nation")
def gridcell_angles(spark, d):
    """Cells along parallels point east."""
    g = X.nations(spark, d)
    lon, lat = g.coord(axis="x").points.reshape(5, 5), g.coord(axis="y").points.reshape(5, 5)
    corners = lambda p, a, b: np.stack([p + x for x in (a, b)[0]], axis=-1)
    bx, by = corners(lon, (-1, 1, 1, -1), None), corners(lat, (-1, -1, 1, 1), None)
    angles = S.gridcell_angles(Coord(long_name="x", points=lon, bounds=bx, dims=("a", "b")), Coord(long_name="y", points=lat, bounds=by, dims=("a", "b")))
    return local_table(spark, [(k, bool(abs(x) < 1e-9)) for k, x in enumerate(angles.ravel())], "nation long, east boolean")


@query("rotate_grid_vectors", f"WITH {X.WORLD} SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, {r('v * cos(radians(30)) - 2 * v * sin(radians(30))')} FROM wo")
def rotate_grid_vectors(spark, d):
    u = X.world(spark, d)
    angles = Grid(df=u.df.withColumn("v", F.lit(30.0)), dims=u.dims, coords=u.coords, long_name="angle", units="degrees")
    east, _ = S.rotate_vectors(u, u * 2.0, angles)
    return rows(east, latitude="latitude", longitude="longitude")


@query("rotate_winds", f"WITH {X.WORLD} SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, round(v * v * 5, 4) + 0.0 AS v FROM wo")
def rotate_winds(spark, d):
    """Turning keeps a vector's length."""
    u = X.world(spark, d)
    a, b = S.rotate_winds(u, u * 2.0, 177.5, 37.5)
    both = a.df.withColumnRenamed("v", "_a").join(b.df.withColumnRenamed("v", "_b"), a.keys())
    return rows(u.with_df(both.select(*u.keys(), (F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")).alias("v"))), 4, latitude="latitude", longitude="longitude")


@query("xy_grids", "SELECT CAST(-90 + 10 * y AS DOUBLE) AS latitude, CAST(10 * x AS DOUBLE) AS longitude FROM (SELECT unnest(range(0, 19)) AS y), (SELECT unnest(range(0, 37)) AS x)")
def xy_grids(spark, d):
    x, y = regrid.xy_grids(X.world(spark, d), corners=True)
    return local_table(spark, list(zip(y.ravel().tolist(), x.ravel().tolist())), "latitude double, longitude double")


@query("geometry_area_weights", f"WITH {X.WORLD}, w AS (SELECT latitude, longitude, v, greatest(0, least(longitude + 5, 123) - greatest(longitude - 5, 31)) * greatest(0, least(latitude + 5, 27) - greatest(latitude - 5, -44)) AS w FROM wo) SELECT {r('sum(v * w) / sum(w)')} FROM w")
def geometry_area_weights(spark, d):
    g = X.world(spark, d)
    share = subset.geometry_area_weights(g, [(31, -44), (123, -44), (123, 27), (31, 27)])
    return rows(g.collapsed(["latitude", "longitude"], A.MEAN, weights=replace(share, units="1")))


@query("geometry_validity", "SELECT * FROM (VALUES ('square', true), ('bow', false), ('line', false), ('flat', false)) t(shape, valid)")
def geometry_validity(spark, d):
    shapes = {"square": [(0, 0), (1, 0), (1, 1), (0, 1)], "bow": [(0, 0), (1, 1), (1, 0), (0, 1)], "line": [(0, 0), (1, 1)], "flat": [(0, 0), (1, 1), (2, 2)]}
    return local_table(spark, [(n, subset.polygon_problem(p) is None) for n, p in shapes.items()], "shape string, valid boolean")


@query("discontiguities", "SELECT CAST(10 * k - 85 AS DOUBLE) AS latitude, k = 9 AS gap FROM (SELECT unnest(range(0, 18)) AS k)")
def discontiguities(spark, d):
    y = X.world(spark, d).coord("latitude")
    y = replace(y, bounds=y.bounds + np.where(y.points > 5, 1.0, 0.0)[:, None])
    return local_table(spark, list(zip(y.points.tolist(), map(bool, axes.discontiguities(y)))), "latitude double, gap boolean")


@query("region_average", f"WITH {X.WORLD} SELECT {r('sum(v * cos(radians(latitude))) / sum(cos(radians(latitude)))')} FROM wo WHERE latitude BETWEEN -30 AND 30")
def region_average(spark, d):
    g = X.world(spark, d).extract(subset.Constraint(latitude=subset.between(-30, 30)))
    return rows(g.collapsed(["latitude", "longitude"], A.MEAN, weights=S.cosine_latitude_weights(g)))


@query("regrid_functions", f"""WITH {X.WORLD}, t AS (SELECT x, y FROM (SELECT unnest([45.0, 135.0, 225.0, 315.0]) AS x), (SELECT unnest([-60.0, 0.0, 60.0]) AS y)),
    o AS (SELECT t.x, t.y, v, greatest(0, least(longitude + 5, x + 45) - greatest(longitude - 5, x - 45)) * greatest(0, sin(radians(least(latitude + 5, y + 30))) - sin(radians(greatest(latitude - 5, y - 30)))) AS w FROM wo, t)
    SELECT CAST(x AS DOUBLE) AS longitude, CAST(y AS DOUBLE) AS latitude, {r('sum(w * v) / sum(w)')} FROM o WHERE w > 1e-12 GROUP BY x, y""")  # fmt: skip
def regrid_functions(spark, d):
    return rows(regrid.regrid_area_weighted(X.world(spark, d), regrid.make_grid(spark, 4, 3), 1.0), longitude="longitude", latitude="latitude")


@query("planar_nearest", f"""WITH {X.NATIONS}, t AS (SELECT x, y FROM (SELECT unnest([-135.5, -45.25, 44.75, 134.5]) AS x), (SELECT unnest([-60.5, 1.25, 61.75]) AS y)),
    c AS (SELECT x, y, v, (x - lon) * (x - lon) + (y - lat) * (y - lat) AS far FROM t, na) SELECT CAST(x AS DOUBLE) AS longitude, CAST(y AS DOUBLE) AS latitude, {r('min_by(v, far)')} FROM c GROUP BY x, y""")  # fmt: skip
def planar_nearest(spark, d):
    target = regrid.make_grid(spark, x_points=[-135.5, -45.25, 44.75, 134.5], y_points=[-60.5, 1.25, 61.75])
    return rows(X.nations(spark, d).regrid(target, regrid.UnstructuredNearest(planar=True)), longitude="longitude", latitude="latitude")


_SYSTEMS = {
    "mercator": (T.Mercator(0.0), "radians(lon) * 6371229.0", "ln(tan(pi() / 4 + radians(lat) / 2)) * 6371229.0"),
    "orthographic": (T.Orthographic(20.0, 30.0), "CASE WHEN near >= 0 THEN 6371229.0 * cos(radians(lat)) * sin(radians(lon - 30)) END", "CASE WHEN near >= 0 THEN 6371229.0 * (cos(radians(20)) * sin(radians(lat)) - sin(radians(20)) * cos(radians(lat)) * cos(radians(lon - 30))) END"),
    "stereographic": (T.Stereographic(20.0, 30.0), "2 * 6371229.0 / (1 + near) * cos(radians(lat)) * sin(radians(lon - 30))", "2 * 6371229.0 / (1 + near) * (cos(radians(20)) * sin(radians(lat)) - sin(radians(20)) * cos(radians(lat)) * cos(radians(lon - 30)))"),
    "equal_area": (T.LambertAzimuthalEqualArea(20.0, 30.0), "6371229.0 * sqrt(2 / (1 + near)) * cos(radians(lat)) * sin(radians(lon - 30))", "6371229.0 * sqrt(2 / (1 + near)) * (cos(radians(20)) * sin(radians(lat)) - sin(radians(20)) * cos(radians(lat)) * cos(radians(lon - 30)))"),
}


def _projected(system):
    def run(spark, d):
        g = X.nations(spark, d)
        x, y = projections.forward(system, g.coord(axis="x").points, g.coord(axis="y").points)
        own = [(k, *(None if np.isnan(v) else round(float(v), 2) + 0.0 for v in p)) for k, p in enumerate(zip(x, y))]
        return local_table(spark, [p for p in own if p[1] is not None], "nation long, x double, y double")

    return run


for _name, (_system, _x, _y) in _SYSTEMS.items():
    query(f"system_{_name}", f"WITH {X.NATIONS}, n AS (SELECT nation, lat, lon, sin(radians(20)) * sin(radians(lat)) + cos(radians(20)) * cos(radians(lat)) * cos(radians(lon - 30)) AS near FROM na), p AS (SELECT nation, {_x} AS x, {_y} AS y FROM n) SELECT nation, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y FROM p WHERE x IS NOT NULL")(_projected(_system))


@query("systems_invert", "SELECT * FROM (VALUES ('albers', true), ('conformal', true), ('geostationary', true), ('national', true), ('oblique', true), ('perspective', true), ('polar', true), ('rotated', true)) t(system, back)")
def systems_invert(spark, d):
    """Every nation's place, moved to where the system looks, comes back from it."""
    wgs = T.GeogCS(6_378_137.0, inverse_flattening=298.257223563)
    kinds = {
        "albers": T.AlbersEqualArea(20.0, 10.0, ellipsoid=wgs), "conformal": T.LambertConformal(30.0, 10.0, secant_latitudes=(20.0, 50.0), ellipsoid=wgs), "geostationary": T.Geostationary(0.0, 10.0, 35_786_000.0, ellipsoid=wgs), "national": T.TransverseMercator(49.0, 8.0, 400_000.0, -100_000.0, 0.9996, wgs),
        "oblique": T.ObliqueMercator(40.0, 45.0, 10.0, ellipsoid=wgs), "perspective": T.VerticalPerspective(40.0, 10.0, 36_000_000.0), "polar": T.PolarStereographic(90.0, 10.0, true_scale_lat=60.0, ellipsoid=wgs), "rotated": T.RotatedGeogCS(37.5, 177.5),
    }
    g = X.nations(spark, d)
    lon, lat = 10 + g.coord(axis="x").points / 60, 45 + g.coord(axis="y").points / 10
    found = [(k, projections.inverse(s, *projections.forward(s, lon, lat))) for k, s in kinds.items()]
    return local_table(spark, [(k, bool(np.abs(a - lon).max() < 1e-6 and np.abs(b - lat).max() < 1e-6)) for k, (a, b) in found], "system string, back boolean")


@query("project_mercator", f"WITH {X.WORLD}, y AS (SELECT unnest(range(0, 18)) AS j), e AS (SELECT ln(tan(pi() / 4 + radians(85) / 2)) AS top), t AS (SELECT j, degrees(2 * atan(exp(-top + j * 2 * top / 17)) - pi() / 2) AS lat FROM y, e), n AS (SELECT j, least(85, greatest(-85, ceil((lat + 85) / 10 - 0.5) * 10 - 85)) AS lat FROM t) SELECT CAST(j AS BIGINT) AS j, {r('sum(v)')} FROM wo JOIN n ON n.lat = wo.latitude GROUP BY j")
def project_mercator(spark, d):
    """Nearest cells on a regular grid of a Mercator map, added up by its rows."""
    made = regrid.project(X.world(spark, d), T.Mercator(180.0))
    return made.df.groupBy(F.col("i_latitude").cast("bigint").alias("j")).agg((F.round(F.sum("v"), 6) + F.lit(0.0)).alias("v")).where("v is not null")


@query("turn_winds", f"WITH {X.WORLD} SELECT CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, {r('v', 5)} FROM wo")
def turn_winds(spark, d):
    """A Mercator map's axes run along those of longitude and latitude."""
    u = X.world(spark, d)
    a, _ = S.turn_winds(u, u * 2.0, T.Mercator(180.0))
    return rows(a, 5, latitude="latitude", longitude="longitude")


# Meshes: a face a nation, as wide as it is high by its number.


def _nation_mesh(spark, d) -> mesh.Mesh:
    k = np.array(sorted(x[0] for x in X.table(spark, d, "nation").select("n_nationkey").collect()), float)
    w, h, x, y = 1 + k % 3, 2 + k % 2, 10 * k, 0 * k
    bx, by = np.stack([x, x + w, x + w, x], axis=1), np.stack([y, y, y + h, y + h], axis=1)
    return mesh.Mesh.from_bounds(spark, Coord(long_name="x", points=x, bounds=bx, dims=("f",)), Coord(long_name="y", points=y, bounds=by, dims=("f",)))


@query("mesh_nodes", "SELECT CAST(10.0 * n_nationkey + dx * (1 + n_nationkey % 3) AS DOUBLE) AS x, CAST(dy * (2 + n_nationkey % 2) AS DOUBLE) AS y FROM nation, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)")
def mesh_nodes(spark, d):
    return _nation_mesh(spark, d).points("node").select("x", "y")


@query("mesh_edges", "SELECT CAST(count(*) * 4 AS BIGINT) AS edges, CAST(count(*) * 4 AS BIGINT) AS outer_edges FROM nation")
def mesh_edges(spark, d):
    return _nation_mesh(spark, d).edges_of_faces().agg(F.count("*").alias("edges"), F.sum((F.col("n_faces") == 1).cast("long")).alias("outer_edges"))


@query("mesh_connectivity", "SELECT CAST(n_nationkey AS BIGINT) AS loc, CAST(4 AS BIGINT) AS n FROM nation")
def mesh_connectivity(spark, d):
    c = _nation_mesh(spark, d).connectivity("face_node_connectivity")
    return c.transposed().transposed().lengths().select(F.col("loc").cast("bigint"), "n")


@query("mesh_centres", "SELECT CAST(n_nationkey AS BIGINT) AS loc, CAST(10 * n_nationkey + (1 + n_nationkey % 3) / 2 AS DOUBLE) AS x, CAST((2 + n_nationkey % 2) / 2 AS DOUBLE) AS y FROM nation")
def mesh_centres(spark, d):
    """Face centres as the means of their corners."""
    m = replace(_nation_mesh(spark, d), centres={})
    return m.points("face").select(F.col("loc").cast("bigint"), (F.round("x", 6) + F.lit(0.0)).alias("x"), (F.round("y", 6) + F.lit(0.0)).alias("y"))


@query("mesh_region", f"WITH {X.NATIONS} SELECT nation, {r('v')} FROM na WHERE nation BETWEEN 5 AND 15")
def mesh_region(spark, d):
    """The faces whose centre lies in a box, with their values."""
    g = X.nations(spark, d)
    inside = mesh.extract_region(g, "nation", _nation_mesh(spark, d), (45.0, 155.0), (-1.0, 1.0))
    return inside.where("v is not null").select(F.col("i_nation").cast("bigint").alias("nation"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


# Functions and formats of the user.


@query("saver_plugin", _SALES_ROWS)
def saver_plugin(spark, d):
    """A writer and a format that a user adds: rows of text."""
    if "rows" not in store.WRITERS:

        def write(g, path, **_):
            g.df.where("v is not null").select(F.to_json(F.struct(*g.keys(), "v")).alias("value")).write.text(path)

        def read(spark, path):
            return [Grid(df=spark.read.schema("i_month int, i_supp int, v double").json(path), dims={"month": 0, "supp": 0}, long_name="plain")]

        store.add_writer("rows", write)
        store.add_format(store.Format(1, "rows", lambda p, b: p.endswith(".rows"), read))
    g, at = X.sales(spark, d), _at(spark, "sales.rows")
    store.save(g, at)
    (plain,) = store.load_raw(spark, at)
    return rows(g.with_df(plain.df), month="month", supp="supp")


@query("function_table", f"WITH {X.EVENTS} SELECT event_type, count(v) AS n FROM ev GROUP BY 1")
def function_table(spark, d):
    """Fields dealt out as a table of (label, cells)."""
    out = None
    for g in subset.slices_over(X.events_day(spark, d), "event_type"):
        own = g.df.agg(F.count("v").alias("n")).select(F.lit(str(g.coord("event_type").points)).alias("event_type"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("uri_parts", "SELECT * FROM (VALUES ('file', '/a/b.nc'), ('https', '//h/x'), ('file', 'C:/d.pp')) t(scheme, rest)")
def uri_parts(spark, d):
    return local_table(spark, [store.decode_uri(u) for u in ("/a/b.nc", "https://h/x", "C:/d.pp")], "scheme string, rest string")


@query("path_expansion", "SELECT name FROM (VALUES ('a.grid'), ('b.grid')) t(name)")
def path_expansion(spark, d):
    at = _at(spark, "")
    for name in ("b.grid", "a.grid", "c.other.grid.x"):
        X.price_size(spark, d).df.limit(1).write.parquet(f"{at}{name}")
    return local_table(spark, [(p.rstrip("/").rsplit("/", 1)[1],) for p in store.expand(spark, [f"{at}*.grid"])], "name string")


@query("format_dispatch", "SELECT * FROM (VALUES ('x.grid', 'field folder'), ('x.nc', 'netCDF classic'), ('x.pp', 'PP'), ('x.ff', 'fieldsfile'), ('x.tif', 'GeoTIFF'), ('x.txt', 'dispersion text')) t(path, format)")
def format_dispatch(spark, d):
    first = {"x.grid": b"", "x.nc": b"CDF\1", "x.pp": b"\0\0\1\0", "x.ff": bytes(7) + b"\x14", "x.tif": b"II*\0", "x.txt": b"NAME III"}
    return local_table(spark, [(p, store.find_format(p, b).name) for p, b in first.items()], "path string, format string")

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.frame import Coord, GridError
from gridspark.functions import aggregators as A
from gridspark.operators import interpolate as I
from gridspark.operators import mesh, regrid
from gridspark.operators.subset import Constraint
from gridspark.plans.explain import facts, require_scalable
from gridspark.sources import netcdf3, store
from gridspark.streaming import events
from tests.stock import axis, field, simple_2d, simple_3d, values


def _plane(spark):
    return field(spark, [[3.0, 4, 5], [23, 24, 25], [43, 44, 45]], ["y", "x"], [axis("y", [-10.0, 0, 10]), axis("x", [30.0, 40, 50])])


def test_interpolation_modes(spark):
    g = _plane(spark)
    assert values(g.interpolate([("x", [32.0, 42.0]), ("y", [-8.0, 2.0])], I.Nearest())).tolist() == [[3, 4], [23, 24]]
    assert values(g.interpolate([("x", [35.0, 55.0])], I.Linear()))[0].tolist() == pytest.approx([3.5, 5.5])
    assert values(g.interpolate([("x", 35.0)], I.Linear())).tolist() == pytest.approx([3.5, 23.5, 43.5])
    assert np.isnan(values(g.interpolate([("x", [55.0])], I.Linear("nan")))[0, 0])
    assert values(g.interpolate([("x", [55.0, 40.0])], I.Linear("mask"))).mask[0].tolist() == [True, False]
    with pytest.raises(GridError):
        g.interpolate([("x", [55.0])], I.Linear("error"))
    ties = field(spark, [1.0, 2, 3], ["x"], [axis("x", [0.0, 1, 2])])
    assert values(ties.interpolate([("x", [0.5, 1.5])], I.Nearest())).tolist() == [1, 2]
    ring = simple_3d(spark)[0, 0]
    assert values(ring.interpolate([("longitude", [135.0, -135.0, 495.0])], I.Linear())).tolist() == pytest.approx([1.5, 0.5, 1.5])


def test_masked_corners_contaminate_only_with_weight(spark):
    a = np.ma.masked_array([1.0, 2, 3], [0, 1, 0])
    g = field(spark, a, ["x"], [axis("x", [0.0, 1, 2])])
    got = values(g.interpolate([("x", [0.0, 0.5, 2.0])], I.Linear()))
    assert got.tolist() == [1, None, 3]


def test_trajectories_and_levels(spark):
    g = _plane(spark)
    line = I.trajectory([{"x": 30.0, "y": -10.0}, {"x": 50.0, "y": 10.0}], 3)
    assert values(I.along_trajectory(g, line)).tolist() == [3, 24, 45]
    assert values(I.along_trajectory(g, {"x": [31.0], "y": [9.0]}, "nearest")).tolist() == [43]
    levels = Coord(long_name="z", points=np.array([[0.0, 10, 20], [0, 5, 10], [100, 110, 120]]).T, dims=("y", "x"))
    got = values(I.relevel(g, levels, [5.0, 200.0], "y"))
    assert got.shape == (2, 3) and got[0, :2].tolist() == pytest.approx([13, 24]) and got.mask[0, 2] and got.mask[1].all()


def test_relevel_across_gaps(spark):
    levels = axis("z", [0.0, 10, 20, 30])
    for gaps in ([0, 1, 1, 0], [0, 1, 0, 0], [1, 0, 1, 0]):
        g = field(spark, np.ma.masked_array([1.0, 2, 3, 7], gaps), ["z"], [levels])
        there = np.flatnonzero(np.logical_not(gaps))
        lo, hi = there[0], there[1]
        z, v = levels.points, [1.0, 2, 3, 7]
        t = (z[lo] + z[hi]) / 2 + 1
        for sparse in (g, g.with_df(g.df.where("v is not null"))):
            got = values(I.relevel(sparse, "z", [t, 40.0], "z", across_gaps=True))
            assert got[0] == pytest.approx(v[lo] + (v[hi] - v[lo]) * (t - z[lo]) / (z[hi] - z[lo])) and got.mask.tolist() == [False, True]
            assert values(I.relevel(sparse, "z", [t], "z")).mask.all()
    falling = field(spark, np.ma.masked_array([[1.0, 2, 3], [4, 5, 6]], [[0, 1, 0], [0, 0, 0]]), ["x", "y"], [axis("x", [0.0, 1]), axis("y", [0.0, 1, 2])])
    down = Coord(long_name="h", points=np.array([30.0, 20, 10]), dims=("y",))
    assert values(I.relevel(falling, down, [15.0], "y", across_gaps=True))[:, 0].tolist() == pytest.approx([2.5, 5.5])


def test_area_weighted(spark):
    g = simple_2d(spark)
    names = {"bar": "y", "foo": "x"}
    from dataclasses import replace

    g = replace(g, coords=tuple(replace(c, long_name=names[c.name()]) for c in g.coords))
    x, y = axis("x", [0.0, 30.0], [(-15, 15), (15, 45)], "foo"), axis("y", [5.0], [(0, 10)], "bar")
    target = replace(g, dims={"bar": 1, "foo": 2}, coords=(y, x))
    assert values(g.regrid(target, regrid.AreaWeighted())).tolist() == [[2.5, 4.5]]
    off = replace(target, coords=(y, axis("x", [0.0, 40.0], [(-15, 15), (35, 50)], "foo")))
    assert values(g.regrid(off, regrid.AreaWeighted())).mask.tolist() == [[False, True]]
    holes = g.with_df(g.df.withColumn("v", F.when(F.col("v") != 0, F.col("v"))))
    assert values(holes.regrid(target, regrid.AreaWeighted(mdtol=0))).mask.tolist() == [[True, False]]
    assert values(holes.regrid(target, regrid.AreaWeighted(mdtol=0.5)))[0, 0] == pytest.approx(10 / 3)


def test_point_in_cell_nearest_and_projection(spark):
    lon, lat = np.array([5.0, 15, 355, 185]), np.array([10.0, 20, -10, 50])
    src = field(spark, [1.0, 3, 10, 20], ["p"], [Coord(standard_name="longitude", units="degrees", points=lon, dims=("p",)), Coord(standard_name="latitude", units="degrees", points=lat, dims=("p",))])
    target = regrid.make_grid(spark, 2, 2)
    got = values(src.regrid(target, regrid.PointInCell()))
    assert got.tolist() == [[None, 10], [2, 20]]
    assert values(src.regrid(target, regrid.PointInCell(np.array([1.0, 3, 1, 1]))))[1, 0] == 2.5
    assert values(src.regrid(regrid.make_grid(spark, x_points=[2.0, 180.0], y_points=[0.0, 60.0]), regrid.UnstructuredNearest())).tolist() == [[1, 20], [3, 20]]
    flat = field(spark, [1.0, 2, 3], ["p"], [axis("x", [0.0, 5, 9], dim="p"), Coord(long_name="y", points=np.array([0.0, 0, 9]), dims=("p",))])
    square = field(spark, np.zeros((2, 2)), ["y", "x"], [axis("y", [0.0, 8]), axis("x", [1.0, 7])])
    assert values(flat.regrid(square, regrid.UnstructuredNearest(planar=True))).tolist() == [[1, 2], [1, 3]]
    world = regrid.make_grid(spark, 36, 18)
    turned = regrid.project_rotated(world, 0.0, 90.0, 6, 4)
    assert turned.dims == {"latitude": 4, "longitude": 6}
    edges = np.array([0.0, 1, 4, 9, 16])
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 0.5, 1, 8.9, 15.9, 16)], "x double").select(regrid.cell_number(F.col("x"), edges).alias("k"))
    assert [r.k for r in df.collect()] == [None, 0, 0, 1, 2, 3, None]


def test_meshes(spark):
    x = Coord(long_name="x", points=np.array([0.5, 1.5]), bounds=np.array([[0.0, 1, 1, 0], [1, 2, 2, 1]]), dims=("f",))
    y = Coord(long_name="y", points=np.array([0.5, 0.5]), bounds=np.array([[0.0, 0, 1, 1], [0, 0, 1, 1]]), dims=("f",))
    m = mesh.Mesh.from_bounds(spark, x, y)
    assert m.nodes.count() == 6 and [r.area for r in m.face_areas().orderBy("loc").collect()] == [1, 1]
    assert m.edges_of_faces().where("n_faces = 2").count() == 1 and m.edges_of_faces().count() == 7
    assert [(r.x, r.y) for r in mesh.Mesh(m.nodes, m.connectivities).points("face").orderBy("loc").collect()] == [(0.5, 0.5), (1.5, 0.5)]
    ragged = mesh.Connectivity.from_array(spark, "face_node_connectivity", np.ma.masked_equal([[1, 2, 3, 0], [1, 2, 3, 4]], 0), start_index=1)
    assert [r.n for r in ragged.lengths().orderBy("loc").collect()] == [3, 4]
    full = field(spark, np.zeros(4), ["f"], [])
    part = lambda at, v: field(spark, v, ["p"], [Coord(long_name="i_mesh_index", points=np.array(at), dims=("p",))])
    assert values(mesh.recombine_submeshes(full, [part([0, 1], [1.0, 2]), part([1, 3], [5.0, 6])], "f")).tolist() == [1, 5, None, 6]
    assert mesh.extract_region(field(spark, [7.0, 8], ["f"]), "f", m, (1, 2), (0, 1)).count() == 1
    with pytest.raises(GridError):
        mesh.Connectivity("nothing", m.nodes)


def test_store_round_trip(spark, tmp_path):
    g = simple_3d(spark, True).with_coord(Coord(long_name="label", points=np.array(["a", "b"]), dims=("wibble",))).collapsed("latitude", A.MEAN)
    path = f"{tmp_path}/one.grid"
    from gridspark.functions.systems import GeogCS

    g = g.replace_coord(__import__("dataclasses").replace(g.coord("longitude"), coord_system=GeogCS(6_371_229.0)))
    store.save(g, path)
    back = store.load_one(spark, path)
    assert back.coord("longitude").coord_system == GeogCS(6_371_229.0)
    assert back.equals(g) and [str(m) for m in back.cell_methods] == ["latitude: mean"]
    assert values(store.load_one(spark, path, Constraint(wibble=30.0))).shape == (4,)
    store.save([simple_2d(spark)[:, :2], simple_2d(spark)[:, 2:]], f"{tmp_path}/two.grid")
    assert len(store.load_raw(spark, f"{tmp_path}/two.grid")) == 2
    assert values(store.load(spark, f"{tmp_path}/t*.grid", policy="recommended")[0]).tolist() == values(simple_2d(spark)).tolist()
    store.save_field(simple_2d(spark), f"{tmp_path}/packed.grid", packing=(0.5, 1.0))
    assert values(store.load_one(spark, f"{tmp_path}/packed.grid")).tolist() == values(simple_2d(spark)).tolist()

    def drop(field, path):
        raise store.IgnoreField

    assert store.load(spark, path, callback=drop) == []
    with pytest.raises(GridError):
        store.load(spark, f"{tmp_path}/nothing*")
    with pytest.raises(GridError):
        store.save(g, f"{tmp_path}/x.unknown")
    assert store.decode_uri("http://a/b") == ("http", "//a/b") and store.decode_uri("/a:b") == ("file", "/a:b")


def test_chunks_set_the_split_size(spark):
    path = "/root/testdata/sf0.1/lineitem.parquet"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with store.chunks(spark, 1 << 20):
        assert spark.read.parquet(path).rdd.getNumPartitions() > 4
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_netcdf_round_trip(spark, tmp_path):
    g = simple_2d(spark)
    g = g.with_df(g.df.withColumn("v", F.when(F.col("v") != 5, F.col("v") + 0.25)), attributes={"title": "t", "k": 3}).with_coord(Coord(long_name="height", units="m", points=np.array(2.5), dims=())).with_coord(Coord(long_name="area", points=np.arange(12.0).reshape(3, 4), dims=("bar", "foo")))
    path = f"{tmp_path}/x.nc"
    store.save(g, path)
    back = store.load_one(spark, path)
    assert values(back).tolist() == values(g).tolist() and back.dims == g.dims and back.attributes["k"] == 3
    assert back.coord("foo").bounds.tolist() == g.coord("foo").bounds.tolist() and back.coord("height").points.item() == 2.5 and back.coord("area").points.shape == (3, 4)
    assert store.load(spark, path, Constraint("nothing")) == []
    assert netcdf3.header_facts(spark, path).count() >= 6
    with pytest.raises(GridError):
        netcdf3.read_header(b"HDF\1" + bytes(40))


def test_netcdf_record_variables():
    import struct

    head = b"CDF\1" + struct.pack(">i", 2) + struct.pack(">ii", 10, 2) + netcdf3._text("t") + struct.pack(">i", 0) + netcdf3._text("x") + struct.pack(">i", 3) + struct.pack(">ii", 0, 0)

    def table(begin):
        out = struct.pack(">ii", 11, 2)
        for n, b in (("a", begin), ("b", begin + 12)):
            out += netcdf3._text(n) + struct.pack(">iii", 2, 0, 1) + netcdf3._attributes({"_FillValue": 99}) + struct.pack(">ii", 4, 12) + struct.pack(">i", b)
        return out

    begin = len(head) + len(table(0))
    rows = np.array([[1, 2, 3], [10, 20, 30], [4, 99, 6], [40, 50, 60]], ">i4").tobytes()
    data = head + table(begin) + rows
    h = netcdf3.read_header(data)
    assert netcdf3.read_array(data, h, h.variables["a"]).tolist() == [[1, 2, 3], [4, None, 6]]
    assert netcdf3.read_array(data, h, h.variables["b"], 1, 2).tolist() == [[40, 50, 60]]


def test_tables(spark):
    g = simple_2d(spark).with_coord(Coord(long_name="kind", points=np.array(["a", "b", "c"]), dims=("bar",)))
    wide = store.as_table(g, aux=True).orderBy("bar", "foo").toPandas()
    assert wide.columns.tolist() == ["bar", "foo", "kind", "thing"] and wide.thing.tolist() == list(range(12))
    frame = wide.set_index(["bar", "foo"])
    (back,) = store.from_pandas(spark, frame, aux=["kind"])
    assert values(back).tolist() == values(g).tolist() and back.coord("kind").dims == ("bar",)
    with pytest.raises(GridError):
        store.from_pandas(spark, frame.iloc[:-1])
    with pytest.raises(GridError):
        store.from_pandas(spark, pd.concat([frame, frame]))


def test_plans(spark):
    sales = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    own = facts(sales.where("l_quantity > 10").groupBy("l_returnflag").agg(F.sum("l_tax")))
    assert own.exchanges == 1 and "l_quantity" in own.pushed_filters[0] and set(own.read_columns[0]) == {"l_quantity", "l_tax", "l_returnflag"}
    g = simple_3d(spark)
    assert require_scalable((g - g.collapsed("longitude", A.MEAN)).df).nested_loops == 0
    one = require_scalable(_plane(spark).interpolate([("x", [32.0, 42.0]), ("y", [-8.0, 2.0])], I.Linear()).df, 1)
    assert one.exchanges == 1 and one.broadcasts == 2
    with pytest.raises(AssertionError):
        require_scalable(g.df.repartition(3).groupBy("i_latitude").count(), 1)


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")

    def drain(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = drain(events.windowed(stream, "ts", "value", A.MEAN, "1 day", by=("event_type",)), "complete", "days").toPandas()
    want = src.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.avg("value").alias("w")).toPandas()
    both = got.merge(want, on=["start", "event_type"])
    assert len(both) == len(got) == len(want) and np.allclose(both.v, both.w)
    runs = drain(events.longest_runs(stream, "user_id", "ts", F.col("value") > 20), "update", "runs").toPandas().set_index("key")
    for user, part in src.toPandas().sort_values("ts").groupby("user_id"):
        best = run = 0
        for v in part.value:
            run = run + 1 if v > 20 else 0
            best = max(best, run)
        assert runs.loc[str(user)].longest == best
    assert drain(events.by_season(stream, "ts", "value", A.MAX), "complete", "seasons").select("season").distinct().count() == 1
    assert drain(events.sessions(stream, "ts", "user_id", "1 hour"), "complete", "sess").agg(F.sum("n")).head()[0] == src.count()


def test_pp_round_trip(spark, tmp_path):
    from gridspark.sources import pp

    t = Coord(standard_name="time", units="hours since 1970-01-01", points=np.array([12.0, 36.0]), bounds=np.array([[0.0, 24], [24, 48]]), dims=("time",), is_dim=True)
    z = Coord(standard_name="height", units="m", points=np.array([10.0, 50, 100]), dims=("level",), is_dim=True)
    y = Coord(standard_name="latitude", units="degrees", points=np.array([-45.0, 45.0]), dims=("y",), is_dim=True)
    x = Coord(standard_name="longitude", units="degrees", points=np.array([0.0, 90, 180, 270]), dims=("x",), is_dim=True, circular=True)
    a = np.ma.masked_equal(np.arange(48.0).reshape(2, 3, 2, 4), 7)
    g = field(spark, a, ["time", "level", "y", "x"], [t, z, y, x], attributes={"STASH": "m01s03i236"})
    store.save(g, f"{tmp_path}/x.pp")
    (back,) = store.load_raw(spark, f"{tmp_path}/x.pp")
    assert values(back).tolist() == a.tolist() and (back.name(), back.units, back.attributes["STASH"]) == ("air_temperature", "K", "m01s03i236")
    for n in ("time", "height", "latitude", "longitude"):
        assert back.coord(n).points.tolist() == g.coord(n).points.tolist()
    assert back.coord("time").bounds.tolist() == t.bounds.tolist() and back.coord("longitude").circular
    table = pp.field_table(spark, f"{tmp_path}/x.pp")
    assert table.count() == 6 and {r.blev for r in table.collect()} == {10, 50, 100} and table.where("lbuser4 = 3236").count() == 6
    (tmp_path / "little.pp").write_bytes(pp.to_bytes(g[0, 0], "<"))
    assert values(store.load_one(spark, f"{tmp_path}/little.pp")).tolist() == a[0, 0].tolist()


def _many_records(spark):
    t = Coord(standard_name="time", units="hours since 1970-01-01", points=np.arange(6) * 6.0, dims=("time",), is_dim=True)
    z = Coord(standard_name="air_pressure", units="hPa", points=np.array([500.0, 850.0]), dims=("level",), is_dim=True)
    y = Coord(standard_name="latitude", units="degrees", points=np.linspace(-60, 60, 5), dims=("y",), is_dim=True)
    x = Coord(standard_name="longitude", units="degrees", points=np.arange(7) * 10.0, dims=("x",), is_dim=True)
    a = np.ma.masked_equal(np.arange(420.0).reshape(6, 2, 5, 7) / 4, 13.25)
    a[0, 0, 2, :] = np.ma.masked
    return field(spark, a, ["time", "level", "y", "x"], [t, z, y, x], attributes={"STASH": "m01s16i203"}), a


def test_packed_records(spark, tmp_path):
    from gridspark.sources import packing, pp

    g, a = _many_records(spark)
    pp.save_pp(g, f"{tmp_path}/p.pp", accuracy=-3)
    (back,) = store.load_raw(spark, f"{tmp_path}/p.pp", "air_temperature")
    assert values(back).tolist() == a.tolist()  # quarters are exact at eighths
    assert store.load_raw(spark, f"{tmp_path}/p.pp", "relative_humidity") == []
    rng = np.random.default_rng(3)
    for _ in range(50):
        v = np.round(rng.normal(size=(4, 9)), 2)
        v[rng.random((4, 9)) < 0.3] = -1e30
        assert (packing.unpack_runs(packing.pack_runs(v, -1e30), 36, -1e30) == v.ravel()).all()
        assert np.allclose(packing.unpack_rows(packing.pack_rows(v, -10, -1e30), 4, 9, -1e30), v, rtol=0, atol=2**-10)
    land = np.array([[1, 0, 1], [0, 0, 1]])
    raw = np.array([1.0, 2, 3], ">f4").tobytes()
    assert packing.unpacked(raw, 120, ">", 4, 2, 3, False, -9.0, land).tolist() == [[1, -9, 2], [-9, -9, 3]]
    assert packing.unpacked(raw, 220, ">", 4, 2, 3, False, -9.0, land).tolist() == [[-9, 1, -9], [2, 3, -9]]
    for code in (3, 120):
        with pytest.raises(GridError):
            packing.unpacked(raw, code, ">", 4, 2, 3, False, -9.0)


def test_zero_bitmaps_of_either_sense(spark):
    """A row of lowest, zero and packed points, built by hand."""
    from gridspark.sources import packing

    want = [0.0, 2.0, 3.0, 0.0, 2.0, 5.0]
    for sense in (0, 1):
        zero = [int((v == 0) == bool(sense)) for v in want]
        low = [int(v == 2) for v in want]
        bits = low + zero + [0] * 20 + [int(b) for v in (1, 3) for b in f"{v:02b}"] + [0] * 28
        body = np.packbits(np.array(bits, np.uint8)).tobytes()
        control = (2 | packing.LOWEST | packing.ZERO) << 16 | len(body) // 4
        raw = np.array([5 + len(body) // 4, 0, 6 << 16 | 1, packing.to_ibm_float(2.0), control], ">u4").tobytes() + body
        got = packing.unpack_rows(raw, 1, 6, -9.0)[0].tolist()
        assert got == want or sense == 1  # where both senses fit the length, a set bit is a point that isn't zero


def test_fieldsfiles(spark, tmp_path):
    from gridspark.sources import pp

    g, a = _many_records(spark)
    other = (g * 2.0).with_df((g * 2.0).df, attributes={"STASH": "m01s03i245"})
    for accuracy in (None, -4):
        at = f"{tmp_path}/f{accuracy}.ff"
        pp.save_fieldsfile([g, other], at, accuracy)
        assert store.find_format(at, open(at, "rb").read(8)).name == "fieldsfile"
        one, two = store.load_raw(spark, at)
        assert (one.name(), two.name(), two.units) == ("air_temperature", "relative_humidity", "percent")
        assert values(one).tolist() == a.tolist() and values(two).tolist() == (a * 2).tolist()
        assert one.coord("time").points.tolist() == (np.arange(6) * 6.0).tolist() and one.dims == {"time": 6, "level": 2, "y": 5, "x": 7}
        assert pp.field_table(spark, at, pp.fieldsfile_records).count() == 24


def test_bytes_of_stores_without_ranges(spark, tmp_path, monkeypatch):
    from gridspark.sources import bytesio

    g, a = _many_records(spark)
    for name in ("a.pp", "a.ff"):
        store.save(g, f"{tmp_path}/{name}")
    monkeypatch.setattr(bytesio, "local_name", lambda *_: None)
    for name in ("a.pp", "a.ff"):
        (back,) = store.load_raw(spark, f"{tmp_path}/{name}")
        assert values(back).tolist() == a.tolist()


def test_lists_text_and_systems(spark):
    from gridspark.functions import systems
    from gridspark.operators import collection as K

    g = simple_2d(spark)
    many = K.GridList([g[:, :2], g[:, 2:]])
    assert values(many.concatenate_one()).tolist() == values(g).tolist() and len(many[:1] + many) == 3
    with pytest.raises(TypeError):
        many.append(3)
    assert K.xml(g, True) == K.xml(simple_2d(spark), True) != K.xml(g * 1.0, True) and "coord" in K.dot(g)
    assert K.find_metadata(g.coords, axis="x") == [] and len(K.find_metadata(g.coords, "foo")) == 1
    assert K.hexdigest(np.arange(3)) == K.hexdigest(np.arange(3)) != K.hexdigest(np.arange(3.0))
    with pytest.raises(GridError):
        K.checked_attributes({"units": "m"})
    a, b = (g.with_df(g.df, attributes=x) for x in ({"p": 1, "q": 2}, {"p": 1, "q": 3, "r": 4}))
    assert K.combine_metadata(a, b).attributes == {"p": 1, "r": 4} and K.combine_metadata(a, b, False).attributes == {"p": 1}
    assert list(K.metadata_difference(a, b)) == ["attributes"] and not K.is_masked(g) and K.is_masked(simple_3d(spark, True))
    assert K.clip_string("a long text of many words", 8) == "a long text..."
    assert systems.GeogCS(6_378_137.0, None, 298.257223563).semi_minor_axis == pytest.approx(6_356_752.314245)
    for s in (systems.osgb(), systems.RotatedGeogCS(37.5, 177.5, ellipsoid=systems.GeogCS(6_371_229.0)), systems.AlbersEqualArea()):
        assert systems.from_dict(systems.to_dict(s)) == s
    lon, lat = systems.RotatedGeogCS(37.5, 177.5).to_true(0.0, 90.0)
    assert lat == pytest.approx(37.5)


FIELD_TEXT = """NAME III (version 6.0)
Run name:                  x
X grid origin:             -10.0
X grid size:               3
X grid resolution:         2.0
Y grid origin:             40.0
Y grid size:               2
Y grid resolution:         1.5
Number of field cols:      2
Number of preliminary cols: 4

Fields:
"""


def test_dispersion_text(spark, tmp_path):
    from gridspark.sources import dispersion

    cells = {"Species Category": ["VOLCANIC"] * 2, "Quantity": ["Air Concentration", "Dosage"], "Species": ["ASH"] * 2, "Units": ["g / m^3"] * 2, "Time Av or Int": ["003 hr time averaged", ""], "Time": ["01/02/2020  03:00 UTC"] * 2, "Z": ["From 0 to 100m agl"] * 2}
    text = FIELD_TEXT + "".join(", , , , " + ", ".join(cells.get(r, ["", ""])) + ",\n" for r in dispersion.FIELD_ROWS)
    text += "X (Lat-Long), Y (Lat-Long), X, Y,\n" + "".join(f" {x}.5, {y}.5, 0, 0, {10 * y + x}.0, {x / 2}, \n" for y in (1, 2) for x in (1, 2, 3))
    (tmp_path / "field.txt").write_text(text)
    a, b = store.load_raw(spark, f"{tmp_path}/field.txt")
    assert values(a).tolist() == [[11, 12, 13], [21, 22, 23]] and values(b)[0].tolist() == [0.5, 1, 1.5]
    assert a.name() == "ASH_AIR_CONCENTRATION" and a.coord("longitude").points.tolist() == [-10, -8, -6] and a.cell_methods[0].method == "mean"
    assert a.coord("time").points.item() == 24 * 18293 + 3
    series = "NAME III (version 6.0)\nRun name: x\nNumber of field cols: 1\nNumber of series: 1\n\nFields:\n"
    cells = {"Species": ["ASH"], "Quantity": ["Dosage"], "Location": ["Here"], "X": ["X = -3.5 Lat-Long"], "Y": ["Y = 50.7 Lat-Long"]}
    series += "".join(", " + ", ".join(cells.get(r, [""])) + ",\n" for r in dispersion.SERIES_ROWS) + "T,\n" + "01/02/2020  02:00 UTC, 2.5, \n01/02/2020  01:00 UTC, 1.5, \n"
    (tmp_path / "series.txt").write_text(series)
    (c,) = store.load_raw(spark, f"{tmp_path}/series.txt")
    assert values(c).tolist() == [1.5, 2.5] and c.coord("longitude").points.item() == -3.5 and c.coord("location").points.item() == "Here"


def test_mesh_files_and_rasters(spark, tmp_path):
    import struct

    from gridspark.operators.subset import Extent, intersect_all
    from gridspark.sources import mesh_files

    x = Coord(long_name="x", points=np.array([0.5, 1.5]), bounds=np.array([[0.0, 1, 1, 0], [1, 2, 2, 1]]), dims=("f",))
    y = Coord(long_name="y", points=np.array([0.5, 0.5]), bounds=np.array([[0.0, 0, 1, 1], [0, 0, 1, 1]]), dims=("f",))
    m = mesh.Mesh.from_bounds(spark, x, y)
    mesh_files.save_mesh(m, f"{tmp_path}/m.nc")
    back = mesh_files.load_mesh(spark, f"{tmp_path}/m.nc")
    assert back.nodes.exceptAll(m.nodes).isEmpty() and [r.area for r in back.face_areas().collect()] == [1, 1]
    assert back.points("face").orderBy("loc").collect() == m.points("face").orderBy("loc").collect()
    with pytest.raises(GridError):
        mesh_files.load_mesh(spark, f"{tmp_path}/m.nc", "other")
    world = regrid.make_grid(spark, 4, 2)
    store.save(world, f"{tmp_path}/w.tif")
    raw = (tmp_path / "w.tif").read_bytes()
    assert raw[:4] == b"II*\0" and struct.unpack_from("<8f", raw, 8) == (0.0,) * 8
    gx, gy = regrid.xy_grids(world, corners=True)
    assert gx.shape == (3, 5) and gy[0, 0] == -90
    assert intersect_all(world, Extent("longitude", 0, 100), ignore_bounds=True).dims["longitude"] == 1


def test_projections_against_published_examples():
    """Numerical examples of Snyder's manual and of the British grid's guide."""
    from gridspark.functions import projections as P
    from gridspark.functions import systems as T

    clarke = T.GeogCS(6_378_206.4, inverse_flattening=1 / (1 - np.sqrt(1 - 0.00676866)))
    hayford = T.GeogCS(6_378_388.0, inverse_flattening=297.0)
    examples = [
        (T.osgb(), 1.717921583, 52.657570306, 651_409.903, 313_177.270), (T.TransverseMercator(0, -75, 0, 0, 0.9996, clarke), -73.5, 40.5, 127_106.5, 4_484_124.4), (T.Mercator(-180.0, clarke), -75, 35, 11_688_673.7, 4_139_145.6),
        (T.LambertConformal(23, -96, 0, 0, (33, 45), clarke), -75, 35, 1_894_410.9, 1_564_649.5), (T.AlbersEqualArea(23, -96, 0, 0, (29.5, 45.5), clarke), -75, 35, 1_885_472.7, 1_535_925.0),
        (T.LambertAzimuthalEqualArea(40, -100, 0, 0, clarke), -110, 30, -965_932.1, -1_056_814.9), (T.Stereographic(40, -100, 0, 0, None, clarke, 0.9999), -90, 30, 971_630.8, -1_063_049.3), (T.PolarStereographic(-90, -100, 0, 0, -71, hayford), 150, -75, -1_540_033.6, -560_526.4),
    ]
    for system, lon, lat, x, y in examples:
        assert np.allclose(P.forward(system, lon, lat), (x, y), rtol=0, atol=0.06), system
        assert np.allclose(P.inverse(system, x, y), (lon, lat), rtol=0, atol=2e-6), system
    for system in (T.Orthographic(45, 10), T.VerticalPerspective(45, 10, 3.6e7), T.Geostationary(0, 10, 3.58e7)):
        assert np.isnan(P.forward(system, -170.0, -45.0)).all() and np.isnan(P.inverse(system, 1e8, 0.0)).any()
    lon, lat = np.array([10.0, 20.0]), np.array([50.0, 60.0])
    assert np.allclose(P.turning(T.GeogCS(1.0), T.PolarStereographic(90.0, 0.0), lon, lat), np.radians(lon), atol=1e-6)


def test_buckets_equal_all_pairs():
    rng = np.random.default_rng(8)
    for n, dims in ((1, 2), (7, 3), (400, 2), (900, 3)):
        points = rng.normal(size=(n, dims)).round(1)
        points[: n // 2] *= 0.01  # crowded and sparse together
        wanted = np.concatenate([rng.normal(size=(300, dims)).round(1), points[: min(n, 50)], rng.normal(size=(20, dims)) * 100])
        want = ((wanted[:, None, :] - points) ** 2).sum(axis=-1).argmin(axis=1)
        assert regrid.Buckets(points).nearest(wanted).tolist() == want.tolist()


def test_project_masks_what_a_system_hides(spark):
    from gridspark.functions.systems import Orthographic

    y = Coord(standard_name="latitude", units="degrees", points=np.linspace(-80, 80, 9), dims=("y",), is_dim=True)
    x = Coord(standard_name="longitude", units="degrees", points=np.arange(0, 360, 20.0), dims=("x",), is_dim=True, circular=True)
    g = field(spark, np.arange(162.0).reshape(9, 18), ["y", "x"], [y, x])
    made = regrid.project(g, Orthographic(0.0, 90.0), 11, 9)
    v = values(made)
    assert made.dims == {"y": 9, "x": 11} and np.ma.getmaskarray(v)[0, 0] and not np.ma.getmaskarray(v)[4, 5]
    assert made.coord(axis="x").name() == "projection_x_coordinate" and 76 <= v[4, 5] <= 77


def test_problems_are_captured_and_the_rest_is_loaded(spark, tmp_path):
    from gridspark.sources import pp

    g, a = _many_records(spark)
    data = bytearray(pp.to_bytes(g) + pp.to_bytes(g.with_df(g.df, attributes={"STASH": "m01s03i245"})))
    one = len(data) // 24
    for k in range(12, 24):
        data[k * one + 4 + 4 * pp.WORDS["lbpack"] : k * one + 8 + 4 * pp.WORDS["lbpack"]] = (3).to_bytes(4, "big")
    (tmp_path / "x.pp").write_bytes(bytes(data))
    (tmp_path / "y.pp").write_bytes(bytes(data[:300]) + b"junk" * 100)
    with store.captured_problems() as found:
        (back,) = store.load_raw(spark, f"{tmp_path}/x.pp")
    assert values(back).tolist() == a.tolist() and [(p.part, "3" in str(p.error)) for p in found] == [("m01s03i245", True)]
    assert found[0].path.endswith("x.pp") and "GridError" in found[0].trace and store.LOAD_PROBLEMS == []


def test_plugins(tmp_path, monkeypatch):
    from gridspark.plugins import use_plugin

    (tmp_path / "gridspark_plugins").mkdir()
    (tmp_path / "gridspark_plugins" / "mine.py").write_text("answer = 42\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert use_plugin("mine").answer == 42
    with pytest.raises(ImportError):
        use_plugin("none")

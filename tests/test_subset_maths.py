from datetime import datetime

import numpy as np
import pytest

from gridspark.frame import Cell, Coord, Grid, GridError
from gridspark.functions import axes, calendar, spherical, vertical
from gridspark.operators import combine, maths, shape, stats, subset
from gridspark.units import Unit, UnitError, civil_from_days, days_from_civil
from tests.stock import axis, field, simple_1d, simple_2d, simple_3d, values


def test_constraints(spark):
    g = simple_2d(spark)
    assert values(g.extract(subset.Constraint("thing", bar=7.5))).tolist() == [4, 5, 6, 7]
    assert values(g.extract(subset.Constraint(bar=5.0))).tolist() == [[0, 1, 2, 3], [4, 5, 6, 7]]  # both cells share the edge
    assert g.extract("other") is None and g.extract(subset.Constraint(nothing=1)) is None
    both = subset.Constraint(foo=lambda c: c > 0) & subset.Constraint(bar=[2.5, 12.5])
    assert values(g.extract(both)).tolist() == [[2, 3], [10, 11]]
    assert g.extract(subset.AttributeConstraint(a=1)) is None
    assert g.extract(subset.NameConstraint(long_name="thing", standard_name=None)) is not None
    with pytest.raises(GridError):
        subset.extract_one([g, g], "thing")
    plan = g.extract(subset.Constraint(foo=lambda c: c > 0)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "Join" not in plan


def test_cells_and_partial_dates():
    c = Cell(5, (4, 6))
    assert c == 4 and c == 6 and c != 7 and c > 3.9 and not c > 4 and c <= 4 and c < 7 and not c < 6 and c >= 6
    assert Cell(1) < Cell(2) and (Cell(5, (4, 6)) % 5).bound == (4, 1) and (Cell(1) + 2).point == 3
    p = subset.PartialDateTime(month=3, day=5)
    assert p == datetime(2020, 3, 5) and datetime(1999, 3, 5) == p and p > datetime(2021, 3, 4) and p < datetime(2021, 4, 1)
    with pytest.raises(TypeError):
        _ = p < subset.PartialDateTime(month=4)


def test_indexing_and_reversal(spark):
    g = simple_3d(spark)
    a = np.arange(24).reshape(2, 3, 4)
    for keys in ((0,), (slice(None), 1), (Ellipsis, slice(None, None, -1)), (1, slice(0, 2), [3, 1]), (slice(None), slice(None, None, 2), slice(1, 4, 2))):
        assert values(g[keys]).tolist() == a[keys].tolist() if not any(isinstance(k, list) for k in keys) else values(g[keys]).tolist() == a[1, 0:2][:, [3, 1]].tolist()
    assert values(subset.reverse(g, "latitude")).tolist() == a[:, ::-1].tolist()
    assert not g[:, :, [3, 1, 2]].coord("longitude").is_dim
    with pytest.raises(IndexError):
        g[5]


def test_modular_ranges(spark):
    g = simple_3d(spark)[0, 0]
    got = subset.intersection(g, "longitude", 0, 270)
    assert got.coord("longitude").points.tolist() == [0, 90, 180, 270] and values(got).tolist() == [2, 3, 0, 1]
    got = subset.intersection(g, "longitude", -100, 10)
    assert got.coord("longitude").points.tolist() == [-90, 0]
    lon = g.coord("longitude").guess_bounds()
    wide = g.replace_coord(lon)
    got = subset.intersection(wide, "longitude", 40, 60)
    assert got.coord("longitude").points.tolist() == [0, 90]
    assert subset.intersection(wide, "longitude", 40, 60, threshold=0.1).coord("longitude").points.tolist() == [90]
    assert subset.intersection(wide, "longitude", 40, 100, ignore_bounds=True).coord("longitude").points.tolist() == [90]
    with pytest.raises(GridError):
        subset.intersection(simple_1d(spark), "foo", 0, 1)
    with pytest.raises(GridError):
        subset.intersection(g, "longitude", 0, 400)


def test_masks_and_shapes(spark):
    g = simple_2d(spark)
    g = g.replace_coord(g.coord("bar")).with_df(g.df)
    assert values(subset.mask_where(g, lambda v: v > 5)).count() == 6
    stencil = field(spark, [1.0, 0, 1], ["bar"], [g.coord("bar")])
    assert values(subset.mask_where(g, stencil)).mask[:, 0].tolist() == [True, False, True]
    x = Coord(standard_name="longitude", units="degrees", points=np.arange(4.0), bounds=np.stack([np.arange(4) - 0.5, np.arange(4) + 0.5], axis=1), dims=("x",), is_dim=True)
    y = Coord(standard_name="latitude", units="degrees", points=np.arange(3.0), bounds=np.stack([np.arange(3) - 0.5, np.arange(3) + 0.5], axis=1), dims=("y",), is_dim=True)
    h = field(spark, np.ones((3, 4)), ["y", "x"], [y, x])
    tri = [(-0.5, -0.5), (3.5, -0.5), (-0.5, 2.5)]
    w = subset.geometry_area_weights(h, tri).points
    assert w.sum() == pytest.approx(6.0) and w[0, 0] == pytest.approx(1.0)
    assert subset.polygon_problem(tri) is None and subset.polygon_problem([(0, 0), (1, 1), (1, 0), (0, 1)]) and subset.polygon_problem([(0, 0), (1, 1)]) and subset.polygon_problem([(0, 0), (1, 1), (2, 2)])
    with pytest.raises(GridError):
        subset.mask_outside_shape(h, [(0, 0), (1, 1), (1, 0), (0, 1)])
    assert values(subset.mask_outside_shape(h, tri, minimum_weight=0.5)).count() == (w >= 0.5).sum()
    assert values(subset.mask_outside_shape(h, tri, all_touched=True, invert=True)).count() == (w == 0).sum()


def test_units():
    assert Unit.parse("km h-1").linear(Unit.parse("m s-1"))[0] == pytest.approx(1 / 3.6)
    scale, shift = Unit.parse("celsius").linear(Unit.parse("K"))
    assert (scale, shift) == (1, 273.15)
    assert (Unit.parse("m") * Unit.parse("s-2")).symbol() == "m s-2" and (Unit.parse("m2") ** 0.5).symbol() == "m"
    with pytest.raises(UnitError):
        Unit.parse("m").linear(Unit.parse("s"))
    with pytest.raises(UnitError):
        Unit.parse("m") ** 0.5
    assert Unit.parse("hours since 1970-01-02").linear(Unit.parse("days since 1970-01-01")) == (1 / 24, 1.0)
    for c in ("standard", "360_day", "noleap", "all_leap"):
        z = np.arange(-2000, 40_000, 37)
        assert (days_from_civil(*civil_from_days(z, c), c) == z).all()


def test_arithmetic_aligns_and_checks(spark):
    g = simple_3d(spark)
    mean = g.collapsed("longitude", __import__("gridspark.functions.aggregators", fromlist=["MEAN"]).MEAN)
    a = np.arange(24).reshape(2, 3, 4)
    assert values(g - mean).tolist() == (a - a.mean(axis=2, keepdims=True)).tolist()
    assert values(mean - g).tolist() == (a.mean(axis=2, keepdims=True) - a).tolist()
    assert values(2 - g)[0, 0].tolist() == [2, 1, 0, -1] and values(-g / 2)[1, 2, 3] == -11.5
    assert values(g / g).mask[0, 0, 0] and (g * g).units == "1"
    assert values(g * g.coord("latitude"))[0, 0].tolist() == [0, 90, 180, 270]
    with pytest.raises(UnitError):
        g + g.with_df(g.df, units="m")
    shifted = g.replace_coord(axis("wibble", [10.0, 31.0]))
    with pytest.raises(GridError):
        g + shifted
    assert (g**2).name() == "unknown" and values(g**2)[0, 0, 3] == 9
    assert values(maths.log(g)).mask[0, 0, 0] and maths.log10(g).units.startswith("lg(")
    assert values(maths.apply_function(g, np.hypot, g))[0, 0, 3] == pytest.approx(np.hypot(3, 3))
    assert values(maths.apply_function(g, "sin"))[0, 0, 1] == pytest.approx(np.sin(1))
    assert maths.coord_maths(g.coord("wibble"), "multiply", 2).points.tolist() == [20, 60]
    masked = simple_3d(spark, True)
    assert values(masked + g).count() == 15


def test_calculus_and_correlation(spark):
    g = simple_2d(spark)
    assert values(stats.delta(g, "foo")).tolist() == [[1.0] * 3] * 3
    assert values(stats.differentiate(g, "foo"))[0, 0] == pytest.approx(1 / 15) and stats.differentiate(g, "foo").coord("foo").points.tolist() == [0, 15, 30]
    ring = simple_3d(spark)
    d = stats.delta(ring, "longitude")
    assert values(d)[0, 0].tolist() == [1, 1, 1, -3] and d.coord("longitude").points.tolist() == [-135, -45, 45, 135]
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 5, 30))
    x, y = (field(spark, v, ["k", "n"], [axis("k", range(5)), axis("n", range(30))]) for v in (a, b))
    want = [np.corrcoef(p, q)[0, 1] for p, q in zip(a, b)]
    assert values(stats.pearsonr(x, y, "n")).tolist() == pytest.approx(want)
    assert values(stats.pearsonr(x, y, "n", common_mask=True)).tolist() == pytest.approx(want)
    assert values(stats.pearsonr(x, y)).item() == pytest.approx(np.corrcoef(a.ravel(), b.ravel())[0, 1])
    assert values(stats.pearsonr(x, y[0], "n"))[0] == pytest.approx(want[0])
    assert stats.spatial_name("x_wind", "y_wind") == "wind"


def test_curl_of_a_rotation(spark):
    n = 5
    yy, xx = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    coords = [axis("y", range(n), units="m"), axis("x", range(n), units="m")]
    u, v = field(spark, -yy.astype(float), ["y", "x"], coords, name="u wind"), field(spark, xx.astype(float), ["y", "x"], coords, name="v wind")
    got = values(stats.curl(u, v, "x", "y"))
    assert np.allclose(got, 2) and got.shape == (4, 4)


def test_calendar(spark):
    t = axis("time", [0, 31, 59, 334, 365], units="days since 1970-01-01")
    g = field(spark, np.arange(5.0), ["time"], [t])
    for add, name, want in (
        (calendar.add_month, "month", ["Jan", "Feb", "Mar", "Dec", "Jan"]), (calendar.add_season, "season", ["djf", "djf", "mam", "djf", "djf"]), (calendar.add_season_year, "season_year", [1970, 1970, 1970, 1971, 1971]),
        (calendar.add_season_number, "season_number", [0, 0, 1, 0, 0]), (calendar.add_weekday_number, "weekday_number", [3, 6, 6, 1, 4]), (calendar.add_day_of_year, "day_of_year", [1, 32, 60, 335, 1]), (calendar.add_hour, "hour", [0] * 5),
    ):
        assert add(g, "time").coord(name).points.tolist() == want
    assert calendar.add_season_year(g, "time", at_start=True).coord("season_year").points.tolist() == [1969, 1969, 1970, 1970, 1970]
    assert calendar.add_season_membership(g, "time", "ja").coord("season_membership").points.tolist() == [False] * 5
    with pytest.raises(GridError):
        calendar.add_season(g, "time", seasons=("djf", "mam"))
    named = calendar.categorised(g, "label", "time", lambda c, p: "x" * 70 if p else "y")
    assert [len(s) for s in named.coord("label").points] == [1, 64, 64, 64, 64]
    a, b = calendar.unify_time_units([g, g.replace_coord(axis("time", np.arange(5) * 24.0, units="hours since 1970-01-02"))])
    assert b.coord("time").points.tolist() == [1, 2, 3, 4, 5] and a.coord("time").units == b.coord("time").units


def test_axes(spark):
    c = axis("x", [0.0, 1, 3])
    assert c.guess_bounds().bounds.tolist() == [[-0.5, 0.5], [0.5, 2], [2, 4]]
    lat = Coord(standard_name="latitude", units="degrees", points=np.array([-90.0, 0, 90]), dims=("y",), is_dim=True)
    assert lat.guess_bounds().bounds.tolist() == [[-90, -45], [-45, 45], [45, 90]]
    t = axis("time", [15, 45], units="days since 1970-01-01")
    assert t.guess_bounds(monthly=True).bounds.tolist() == [[0, 31], [31, 59]]
    with pytest.raises(ValueError):
        t.guess_bounds(yearly=True)  # two points in one year
    years = axis("time", [100.0, 400.0], units="days since 1970-01-01")
    assert years.guess_bounds(yearly=True).bounds.tolist() == [[0, 365], [365, 730]]
    for points, how in (([3.0, 1.0, 2.0], {}), ([1.0, 2.0], {"monthly": True}), ([1.0, 70.0], {"monthly": True})):
        with pytest.raises(ValueError):
            Coord(long_name="time", points=np.array(points), dims=("t",), units="days since 1970-01-01").guess_bounds(**how)
    assert axes.is_contiguous(c.guess_bounds()) and axes.contiguous_edges(c).tolist() == [-0.5, 0.5, 2, 4]
    assert axes.nearest_index(axis("x", [0.0, 2, 4]), 1) == 0 and axes.nearest_index(c.guess_bounds(), 1.9) == 1
    lon = simple_3d(spark).coord("longitude")
    assert axes.nearest_index(lon, 179) == 0 and axes.nearest_index(lon, 480) == 3
    assert axes.is_regular(lon) and axes.regular_step(lon) == 90 and not axes.is_regular(c)
    assert [axes.axis_of(x) for x in (lat, lon, t, c)] == ["y", "x", "t", "x"]


def test_sphere(spark):
    from gridspark.operators.regrid import make_grid

    g = make_grid(spark, 8, 4)
    w = values(spherical.area_weights(g, normalize=True))
    assert w.sum() == pytest.approx(1) and w.shape == (4, 8)
    assert values(spherical.area_weights(g)).sum() == pytest.approx(4 * np.pi * spherical.EARTH_RADIUS**2)
    assert values(spherical.cosine_latitude_weights(g)).tolist() == pytest.approx(np.cos(np.radians([-67.5, -22.5, 22.5, 67.5])).tolist())
    assert spherical.wrap_lons([370, -10], 0).tolist() == [10, 350]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10.0, 50.0), (-120.0, -30.0)], "lon double, lat double")
    x, y = spherical.rotate_columns(F.col("lon"), F.col("lat"), 177.5, 37.5)
    back = df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", *spherical.unrotate_columns(F.col("x"), F.col("y"), 177.5, 37.5))
    for r in back.collect():
        assert r[2] == pytest.approx(r[0]) and r[3] == pytest.approx(r[1])
    pole = df.limit(1).select(*spherical.rotate_columns(F.lit(177.5), F.lit(37.5), 177.5, 37.5)).head()
    assert pole[1] == pytest.approx(90)
    square = Coord(long_name="x", points=np.array([[0.0]]), bounds=np.array([[[-1.0, 1, 1, -1]]]), dims=("j", "i")), Coord(long_name="y", points=np.array([[0.0]]), bounds=np.array([[[-1.0, -1, 1, 1]]]), dims=("j", "i"))
    assert spherical.gridcell_angles(*square)[0, 0] == pytest.approx(0)


def test_vertical_formulas(spark):
    delta = Coord(long_name="delta", units="m", points=np.array([100.0, 50, 10]), dims=("z",))
    sigma = Coord(long_name="sigma", points=np.array([0.8, 0.9, 0.95]), dims=("z",))
    oro = Coord(long_name="orography", units="m", points=np.array([10.0, 25, 50, 5]), dims=("x",))
    g = field(spark, np.zeros((3, 4)), ["z", "x"], [delta, sigma, oro])
    high = vertical.derived_points(g, vertical.hybrid_height("delta", "sigma", "orography"))
    assert np.allclose(high.points, delta.points[:, None] + sigma.points[:, None] * oro.points)
    flat = vertical.derived_points(g, vertical.hybrid_pressure("delta", None, "orography"))
    assert flat.points.tolist() == [[100.0] * 4, [50.0] * 4, [10.0] * 4]
    ocean = vertical.derived_points(g, vertical.ocean_s("sigma", "orography", "orography", 3.0, 0.4, 20.0))
    s, d = sigma.points[:, None], oro.points
    c = 0.6 * np.sinh(3 * s) / np.sinh(3) + 0.4 * (np.tanh(3 * (s + 0.5)) / (2 * np.tanh(1.5)) - 0.5)
    assert np.allclose(ocean.points, d * (1 + s) + 20 * s + (d - 20) * c)
    level = g.with_coord(Coord(long_name="k", points=np.arange(3), dims=("z",)))
    z = vertical.derived_points(level, vertical.ocean_sigma_z("sigma", "orography", "orography", 20.0, 2, "delta", "k"))
    assert z.points[2].tolist() == [10.0] * 4 and z.points[0].tolist() == pytest.approx((d + 0.8 * (np.minimum(20, d) + d)).tolist())
    for f in (vertical.atmosphere_sigma("sigma", "orography", 5.0), vertical.ocean_sigma("sigma", "orography", "orography"), vertical.ocean_s_g1("sigma", "sigma", "orography", "orography", 4.0), vertical.ocean_s_g2("sigma", "sigma", "orography", "orography", 4.0)):
        assert np.isfinite(vertical.derived_points(g, f).points).all()


def test_shape(spark):
    g = simple_2d(spark)
    assert values(shape.transpose(g)).tolist() == np.arange(12).reshape(3, 4).T.tolist()
    one = g[1:2]
    assert shape.squeeze(one).dims == {"foo": 4} and shape.squeeze(one).coord("bar").dims == ()
    lifted = shape.new_axis(shape.squeeze(one), "bar")
    assert lifted.dims == {"bar": 1, "foo": 4} and lifted.dim_coord("bar") is not None
    aux = g.with_coord(Coord(long_name="k", points=np.array([3.0, 2, 1]), dims=("bar",)))
    assert shape.promote(aux, "k").dim_coord("bar").name() == "k" and shape.demote(aux, "bar").dim_coord("bar") is None
    assert shape.describe_diff(g, shape.rename(g, "other")) == ["name: thing / other"]
    assert g.equals(g) and not g.equals(g * 1.0) and g.is_compatible(g)
    assert g.fingerprint() == shape.transpose(shape.transpose(g)).fingerprint()


def test_merge(spark):
    def part(t, z, label=None):
        g = simple_1d(spark)
        g = g.with_df(g.df.withColumn("v", g.df.v + 100 * t + 1000 * z)).with_coord(Coord(long_name="t", points=np.array(t), dims=())).with_coord(Coord(long_name="height", units="m", points=np.array(z), dims=()))
        return g if label is None else g.with_coord(Coord(long_name="label", points=np.array(label), dims=()))

    grid = combine.merge_one([part(t, z) for z in (1, 0) for t in (2, 1, 3)])
    assert grid.dims == {"t": 3, "height": 2, "foo": 11} and values(grid)[1, 1, 4] == 4 + 200 + 1000
    line = combine.merge_one([part(t, 0, f"m{t}") for t in (3, 1)])
    assert line.coord("label").points.tolist() == ["m1", "m3"] and line.coord("label").dims == ("t",)
    loose = combine.merge_one([part(1, 1), part(2, 2), part(1, 2)])
    assert loose.dims == {"merged": 3, "foo": 11}
    with pytest.raises(combine.DuplicateDataError):
        combine.merge([part(1, 1), part(1, 1)])
    assert len(combine.merge([part(1, 1), part(1, 1)], unique=False)) == 2
    assert len(combine.merge([part(1, 1), shape.rename(part(2, 1), "other")])) == 2


def test_concatenate(spark):
    g = simple_2d(spark)
    whole = combine.concatenate_one([g[:, 2:], g[:, :1], g[:, 1:2]])
    assert values(whole).tolist() == values(g).tolist() and whole.coord("foo").bounds.tolist() == g.coord("foo").bounds.tolist()
    assert len(combine.concatenate([g[:, :3], g[:, 2:]])) == 2
    quarters = [g[a, b] for a in (slice(0, 2), slice(2, 3)) for b in (slice(0, 2), slice(2, 4))]
    assert values(combine.concatenate_one(quarters)).tolist() == values(g).tolist()
    other = g[:, 2:].with_df(g[:, 2:].df, units="m")
    assert len(combine.concatenate([g[:, :2], other])) == 2
    a, b = combine.equalise([g.with_df(g.df, attributes={"k": 1, "z": 2}), g.with_df(g.df, attributes={"k": 1})], attributes=True)
    assert a.attributes == b.attributes == {"k": 1}


def test_modular_ranges_equal_a_plain_search_over_shifts(spark):
    """Every cell tried at seven shifts; the lowest one where it shares enough wins, a mere touch only if nothing else does."""
    from gridspark.operators.subset import Extent, _turns

    rng = np.random.default_rng(12)
    for case in range(400):
        n = int(rng.integers(1, 13))
        edges = np.sort(rng.choice(np.arange(0, 361, 15), n + 1, replace=False)) + rng.choice([0, -180, 720, -45])
        lo, hi = edges[:-1].astype(float), edges[1:].astype(float)
        if case % 3 == 0:
            lo = hi = (lo + hi) / 2
        low = float(rng.choice(np.arange(-360, 361, 15)))
        high = low + float(rng.choice(np.arange(0, 361, 15)))
        extent = Extent("x", low, high, bool(rng.integers(2)), bool(rng.integers(2)))
        threshold = float(rng.choice([0.0, 0.3, 0.6]))
        turns, kept = _turns(lo, hi, extent, 360.0, threshold)
        for k in range(n):
            fits = []
            for t in range(-6, 7):
                a, b = lo[k] + 360 * t, hi[k] + 360 * t
                share = min(b, high) - max(a, low)
                if (b >= low if extent.min_inclusive else b > low) and (a <= high if extent.max_inclusive else a < high) and share >= threshold * (hi[k] - lo[k]) - 1e-6:
                    fits.append((t, share))
            assert kept[k] == bool(fits), (case, k)
            if fits:
                wide = [t for t, share in fits if share > 1e-6]
                assert turns[k] == (wide[0] if wide else fits[0][0]), (case, k)


def test_modular_seams(spark):
    lon = Coord(standard_name="longitude", units="degrees", points=np.arange(8) * 45.0, bounds=np.stack([np.arange(8) * 45.0 - 22.5, np.arange(8) * 45.0 + 22.5], axis=1), dims=("x",), is_dim=True, circular=True)
    g = field(spark, np.arange(8.0), ["x"], [lon])
    whole = subset.intersection(g, "longitude", 0, 360)
    assert whole.coord("longitude").points.tolist() == [k * 45.0 for k in range(8)] and values(whole).tolist() == list(range(8))
    assert subset.intersection(g, "longitude", -180, 180).coord("longitude").points.tolist() == [-180, -135, -90, -45, 0, 45, 90, 135]
    cut = subset.intersection(g, "longitude", 10, 370, threshold=0.5)  # the cell round 0 has more of itself below 370
    assert cut.coord("longitude").points.tolist()[-1] == 360 and len(cut.coord("longitude").points) == 8
    down = subset.intersection(subset.reverse(g, "longitude"), "longitude", -50, 50, ignore_bounds=True)
    assert down.coord("longitude").points.tolist() == [45, 0, -45] and values(down).tolist() == [1, 0, 7]
    with pytest.raises(ValueError):
        subset.intersection(g, "longitude", 0, 361)


def test_group_bounds_equal_a_plain_range():
    from gridspark.operators.reduce import grouped_coord

    rng = np.random.default_rng(5)
    for down in (False, True):
        points = np.sort(rng.choice(100, 12, replace=False)).astype(float)[:: -1 if down else 1]
        group = rng.integers(0, 4, 12).tolist()
        group = [sorted(set(group)).index(x) for x in group]
        for bounded in (False, True):
            half = np.stack([points - 0.5, points + 0.5], axis=1)[:, :: -1 if down else 1]
            c = Coord(long_name="p", points=points, bounds=half if bounded else None, dims=("x",), is_dim=True)
            got = grouped_coord(c, "x", group)
            for k in range(max(group) + 1):
                own = (half if bounded else points[:, None])[np.array(group) == k]
                want = [own.max(), own.min()] if down else [own.min(), own.max()]
                assert got.bounds[k].tolist() == want and got.points[k] == sum(want) / 2
    ring = Coord(standard_name="longitude", units="degrees", points=np.arange(0, 360, 90.0), dims=("x",), is_dim=True, circular=True)
    assert grouped_coord(ring, "x", [0, 0, 1, 1]).bounds.tolist() == [[0, 90], [180, 360]]
    names = Coord(long_name="n", points=np.array(["a", "b", "c"]), dims=("x",))
    assert grouped_coord(names, "x", [0, 1, 0]).points.tolist() == ["a|c", "b"]


def test_rows_beside_the_points(spark):
    df = spark.createDataFrame([(1, 2.0), (5, 3.0)], "k long, x double")
    with pytest.raises(Exception, match="axis k has no point 5"):
        Grid.from_table(df, {"k": [1, 2]}, "x").df.collect()
    assert Grid.from_table(df, {"k": [1, 2]}, "x", outside="drop").df.count() == 1
    assert Grid.from_table(df, {"k": None}, "x").dims == {"k": 2}


def test_concatenation_by_keys(spark):
    g = simple_2d(spark)
    parts = [g[a, b] for a in (slice(0, 1), slice(1, 3)) for b in (slice(2, 4), slice(0, 2))]
    whole = combine.concatenate_one(parts[::-1])
    assert values(whole).tolist() == values(g).tolist()
    again = combine.concatenate([g[:, :2], g[:, 2:], g[:, 1:3]])
    assert sorted(x.shape for x in again) == [(3, 2), (3, 4)]
    down = subset.reverse(g, "foo")
    assert values(combine.concatenate_one([down[:, 2:], down[:, :2]])).tolist() == values(down).tolist()
    assert len(combine.concatenate([g[:, :2], down[:, :2]])) == 2

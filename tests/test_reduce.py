import numpy as np
import pytest

from gridspark.frame import Coord, GridError
from gridspark.functions import aggregators as A
from gridspark.operators import reduce
from tests.stock import axis, field, simple_1d, simple_2d, simple_3d, values


def test_collapse_coordinates_and_provenance(spark):
    got = simple_2d(spark).collapsed("foo", A.MEAN)
    assert values(got).tolist() == [1.5, 5.5, 9.5]
    foo = got.coord("foo")
    assert foo.points.item() == 15.0 and foo.bounds.tolist() == [-15, 45] and foo.dims == ()
    assert str(got.cell_methods[-1]) == "foo: mean"
    texts = field(spark, np.arange(3), ["k"], [Coord(long_name="label", points=np.array(["a", "b", "c"]), dims=("k",))])
    assert texts.collapsed("k", A.SUM).coord("label").points.item() == "a|b|c"


@pytest.mark.parametrize("mdtol,want", [(None, [4, 2, 4, None]), (1, [4, 2, 4, None]), (0.5, [4, 2, None, None]), (0, [4, None, None, None]), (1 / 3, [4, 2, None, None])])
def test_missing_data_tolerance(spark, mdtol, want):
    a = np.ma.masked_array(np.arange(12.0).reshape(3, 4), [[0, 0, 0, 1], [0, 0, 1, 1], [0, 1, 1, 1]])
    got = values(field(spark, a, ["y", "x"], [axis("x", range(4)), axis("y", range(3))]).collapsed("y", A.MEAN, mdtol=mdtol))
    want = [4.0, 3.0, 2.0, None] if mdtol in (None, 1) else [w if w is None else [4.0, 3.0][k] for k, w in enumerate(want[:2])] + [None, None]
    assert got.tolist() == want


def test_absent_rows_are_masked_cells(spark):
    g = simple_2d(spark)
    sparse = g.with_df(g.df.where("i_bar <> 1"))
    assert values(sparse.collapsed("bar", A.MEAN, mdtol=0.5)).tolist() == [4, 5, 6, 7]
    assert values(sparse.collapsed("bar", A.MEAN, mdtol=0.3)).mask.all()
    assert sparse.dense().df.count() == 12


def test_every_plain_aggregator_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = np.ma.masked_array(rng.uniform(0.5, 9, (6, 5)), rng.random((6, 5)) < 0.2)
    a[:, 4] = np.ma.masked
    g = field(spark, a, ["y", "x"], [axis("x", range(5)), axis("y", range(6))])
    want = {
        "SUM": a.sum(axis=0), "MEAN": a.mean(axis=0), "MIN": a.min(axis=0), "MAX": a.max(axis=0), "RMS": np.sqrt((a**2).mean(axis=0)), "GMEAN": np.exp(np.log(a).mean(axis=0)),
        "HMEAN": 1 / (1 / a).mean(axis=0), "MEDIAN": np.ma.median(a, axis=0), "VARIANCE": a.var(axis=0, ddof=1), "STD_DEV": a.std(axis=0, ddof=1),
    }
    for name, w in want.items():
        got = values(g.collapsed("y", A.ALL[name]))
        assert got[:4].tolist() == pytest.approx(np.ma.asarray(w)[:4].tolist()), name
        assert got.mask[4], name
    over = lambda v: v > 4
    assert values(g.collapsed("y", A.COUNT, function=over))[:4].tolist() == (a > 4).sum(axis=0)[:4].tolist()
    assert values(g.collapsed("y", A.PROPORTION, function=over))[:4].tolist() == pytest.approx(((a > 4).sum(axis=0) / a.count(axis=0))[:4].tolist())
    assert values(g.collapsed("y", A.COUNT, function=over)).mask[4]


def test_nan_is_a_value_but_not_for_the_median(spark):
    g = field(spark, [[1.0, np.nan, 3.0]], ["y", "x"], [axis("x", range(3))])
    assert np.isnan(values(g.collapsed("x", A.MIN))[0]) and np.isnan(values(g.collapsed("x", A.MAX))[0])
    assert values(g.collapsed("x", A.MEDIAN))[0] == 2.0


def test_weights_of_every_form(spark):
    g = simple_2d(spark)
    w = np.arange(12.0).reshape(3, 4) + 1
    want = np.average(np.arange(12).reshape(3, 4), axis=1, weights=w)
    area = Coord(long_name="cell_area", points=w, dims=("bar", "foo"), role="measure", units="m2")
    for weights in (w, area, field(spark, w, ["bar", "foo"], g.coords)):
        assert values(g.collapsed("foo", A.MEAN, weights=weights)).tolist() == pytest.approx(want.tolist())
    named = g.with_coord(area)
    assert values(named.collapsed("foo", A.MEAN, weights="cell_area")).tolist() == pytest.approx(want.tolist())
    total = named.collapsed("foo", A.SUM, weights="cell_area")
    assert total.units == "m2"
    mean, sums = g.collapsed("foo", A.MEAN, weights=w, returned=True)
    assert values(sums).tolist() == w.sum(axis=1).tolist()
    with pytest.raises(GridError):
        g.collapsed("foo", A.MAX, weights=w)


def test_percentiles(spark):
    g = field(spark, [[1.0, 2.0, 3.0, 4.0]], ["y", "x"], [axis("x", range(4))])
    assert values(g.collapsed("x", A.PERCENTILE, percent=50)).tolist() == [2.5]
    many = g.collapsed("x", A.PERCENTILE, percent=[10, 50, 90])
    assert many.dims == {"y": 1, "percentile": 3} and values(many)[0].tolist() == pytest.approx([1.3, 2.5, 3.7])
    assert many.coord("percentile_over_x").units == "percent"
    assert values(g.collapsed("x", A.PERCENTILE, percent=25, alphap=0.5, betap=0.5)).tolist() == [1.5]
    assert values(g.collapsed("x", A.WPERCENTILE, percent=50, weights=np.ones((1, 4)))).tolist() == [2.5]
    assert values(g.collapsed("x", A.WPERCENTILE, percent=[0, 100], weights=np.array([[1.0, 1, 1, 5]])))[0].tolist() == [1, 4]
    assert values(g.collapsed("x", A.WPERCENTILE, percent=50, weights=np.zeros((1, 4)))).mask.all()


def test_longest_run(spark):
    a = np.ma.masked_array([[1, 1, 0, 1, 1, 1, 0], [0] * 7, [1, 1, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1, 1]], [[0] * 7, [0] * 7, [0, 0, 0, 1, 0, 0, 0], [1] * 7])
    g = field(spark, a, ["y", "x"], [axis("x", range(7))])
    got = values(g.collapsed("x", A.MAX_RUN, function=lambda v: v == 1))
    assert got.tolist() == [3, 0, 3, None] and not g.collapsed("x", A.MAX_RUN, function=lambda v: v == 1).cell_methods


def test_runs_across_blocks(spark):
    n = 3 * reduce.RUN_BLOCK
    df = spark.range(n).selectExpr("cast(id as int) as i_x", f"case when id < 10 or id = {n - 5} then 0D else 1D end as v")
    g = field(spark, [0.0], ["x"]).with_df(df, dims={"x": n})
    assert values(g.collapsed("x", A.MAX_RUN, function=lambda v: v > 0)).item() == n - 15


def test_peak_is_at_least_the_maximum_and_exact_for_polynomials(spark):
    x = np.arange(9.0)
    curve = -((x - 3.37) ** 2)
    g = field(spark, [curve, np.full(9, 2.0), np.where(x == 4, np.nan, x)], ["y", "x"], [axis("x", range(9))])
    got = values(g.collapsed("x", A.PEAK))
    assert got[0] == pytest.approx(0, abs=1e-4) and got[1] == 2 and got[2] == pytest.approx(8)


def test_groups(spark):
    g = simple_1d(spark).with_coord(Coord(long_name="kind", points=np.array(list("abbaaccabbb")), dims=("foo",))).with_coord(Coord(long_name="name", points=np.array(list("0123456789X")), dims=("foo",)))
    got = g.aggregated_by("kind", A.SUM)
    assert values(got).tolist() == [0 + 3 + 4 + 7, 1 + 2 + 8 + 9 + 10, 5 + 6]
    assert got.coord("kind").points.tolist() == ["a", "b", "c"] and got.coord("name").points.tolist() == ["0|3|4|7", "1|2|8|9|X", "5|6"]
    foo = got.coord("foo")
    assert foo.bounds.tolist() == [[0, 8], [1, 11], [5, 7]] and foo.points.tolist() == [4, 6, 6] and not foo.is_dim
    two = g.with_coord(Coord(long_name="half", points=np.array([0] * 6 + [1] * 5), dims=("foo",))).aggregated_by(["kind", "half"], A.COUNT, function=lambda v: v >= 0)
    assert values(two).tolist() == [3, 2, 1, 1, 1, 3]
    with pytest.raises(GridError):
        simple_2d(spark).aggregated_by(["foo", "bar"], A.SUM)
    assert values(g.aggregated_by("kind", A.MAX_RUN, function=lambda v: v < 9)).tolist() == [4, 3, 2]


def test_circular_groups_close_the_circle(spark):
    lon = Coord(standard_name="longitude", units="degrees", points=np.array([0.0, 90, 180, 270]), dims=("x",), is_dim=True, circular=True)
    half = Coord(long_name="half", points=np.array([0, 0, 1, 1]), dims=("x",))
    got = field(spark, [1.0, 2, 3, 4], ["x"], [lon, half]).aggregated_by("half", A.MEAN)
    assert got.coord("longitude").bounds.tolist() == [[0, 90], [180, 360]]


def test_rolling_windows(spark):
    g = simple_1d(spark)
    got = g.rolling_window("foo", A.MEAN, 3)
    assert values(got).tolist() == list(range(1, 10))
    foo = got.coord("foo")
    assert foo.bounds[0].tolist() == [0, 3] and foo.points[0] == 1.5
    assert values(g.rolling_window("foo", A.SUM, 3, weights=[1, 0, 2])).tolist() == [k + 2 * (k + 2) for k in range(9)]
    assert values(g.rolling_window("foo", A.MAX, 4, step=3)).tolist() == [3, 6, 9]
    for bad in (1, 12):
        with pytest.raises(GridError):
            g.rolling_window("foo", A.MEAN, bad)
    with pytest.raises(GridError):
        simple_3d(spark).rolling_window("longitude", A.MEAN, 2)


def test_long_windows_equal_short_ones(spark):
    rng = np.random.default_rng(0)
    a = np.ma.masked_array(rng.uniform(1, 5, (2, 90)), rng.random((2, 90)) < 0.3)
    g = field(spark, a, ["y", "x"], [axis("x", range(90))])
    for agg, options in ((A.MEAN, {}), (A.MIN, {}), (A.STD_DEV, {}), (A.COUNT, {"function": lambda v: v > 3}), (A.HMEAN, {})):
        long = values(g.rolling_window("x", agg, 70, mdtol=0.32, **options))
        keep, reduce.SPREAD_WINDOW = reduce.SPREAD_WINDOW, 100
        try:
            short = values(g.rolling_window("x", agg, 70, mdtol=0.32, **options))
        finally:
            reduce.SPREAD_WINDOW = keep
        assert long.mask.tolist() == short.mask.tolist() and long.compressed().tolist() == pytest.approx(short.compressed().tolist())


def test_custom_aggregator(spark):
    span = A.custom("span", lambda s: s.max() - s.min())
    assert values(simple_2d(spark).collapsed("foo", span)).tolist() == [3, 3, 3]


def test_spline_peaks_equal_a_plain_spline():
    """Basis functions by their recursion, all of them at every place."""
    from gridspark.operators.reduce import spline_peak

    def basis(t, k, j, p):
        if k == 0:
            return float(t[j] <= p < t[j + 1] or (p == t[-1] and t[j] < t[j + 1] == t[-1]))
        left = (p - t[j]) / (t[j + k] - t[j]) * basis(t, k - 1, j, p) if t[j + k] > t[j] else 0
        return left + ((t[j + k + 1] - p) / (t[j + k + 1] - t[j + 1]) * basis(t, k - 1, j + 1, p) if t[j + k + 1] > t[j + 1] else 0)

    rng = np.random.default_rng(2)
    for n in (2, 3, 4, 6, 8):
        y, k = rng.normal(size=n), min(5, n - 1)
        inner = n - k - 1
        knots = [float(x) for x in range((k + 1) // 2, (k + 1) // 2 + inner)] if k % 2 else [x + 0.5 for x in range(k // 2, k // 2 + inner)]
        t = [0.0] * (k + 1) + knots + [n - 1.0] * (k + 1)
        weights = np.linalg.solve([[basis(t, k, j, float(i)) for j in range(n)] for i in range(n)], y)
        want = max(y.max(), max(sum(w * basis(t, k, j, p) for j, w in enumerate(weights)) for p in np.linspace(0, n - 1, 100 * n)))
        assert abs(spline_peak(y) - want) < 1e-9
    gaps = np.array([1.0, 5.0, 1.0, np.nan, 2.0, 9.0, np.nan])
    assert spline_peak(gaps) == max(spline_peak(gaps[:3]), spline_peak(gaps[4:6])) >= 9.0


@pytest.mark.parametrize("agg", [A.SUM, A.MEAN, A.MIN, A.MAX, A.RMS, A.HMEAN, A.VARIANCE, A.STD_DEV])
def test_long_windows_equal_short_ones(spark, monkeypatch, agg):
    from gridspark.operators import reduce

    a = np.ma.masked_greater(np.random.default_rng(1).uniform(1, 9, (2, 40)), 8)
    g = field(spark, a, ["k", "x"], [axis("x", np.arange(40))])
    for window, step in ((7, 1), (13, 3), (40, 1)):
        want = values(g.rolling_window("x", agg, window, step=step, mdtol=0.4))
        monkeypatch.setattr(reduce, "SPREAD_WINDOW", 2)
        got = values(g.rolling_window("x", agg, window, step=step, mdtol=0.4))
        monkeypatch.undo()
        assert (np.ma.getmaskarray(got) == np.ma.getmaskarray(want)).all() and np.ma.allclose(got, want)


@pytest.mark.parametrize("kind", ["sum", "min", "max"])
def test_running_functions_by_blocks(spark, monkeypatch, kind):
    from gridspark.operators import maths

    a = np.ma.masked_greater(np.random.default_rng(3).uniform(-5, 9, (3, 25)), 7)
    g = field(spark, a, ["k", "x"], [axis("x", np.arange(25))])
    want = values(maths.cumulative(g, "x", kind))
    monkeypatch.setattr(maths, "RUN", 4)
    got = values(maths.cumulative(g, "x", kind))
    assert (np.ma.getmaskarray(got) == np.ma.getmaskarray(want)).all() and np.ma.allclose(got, want)


@pytest.mark.parametrize("how", [{}, {"alphap": 0.5, "betap": 0.5}, {"alphap": 0.0, "betap": 1.0}])
def test_percentiles_by_ranges_equal_sorted_ones(spark, monkeypatch, how):
    rng = np.random.default_rng(6)
    a = np.ma.masked_greater(np.where(rng.random((3, 700)) < 0.5, 4.0, rng.normal(5, 3, (3, 700))), 9)
    a[2, 1:] = np.ma.masked
    g = field(spark, a, ["k", "x"], [axis("x", np.arange(700))])
    for over in ("x", ["k", "x"]):
        for options in ({"percent": 37, "mdtol": 0.9}, {"percent": [0, 10, 50, 99.5, 100]}):
            want = values(g.collapsed(over, A.PERCENTILE, **options, **how))
            monkeypatch.setattr(reduce, "RANKED_CELLS", 0)
            got = values(g.collapsed(over, A.PERCENTILE, **options, **how))
            monkeypatch.undo()
            assert (np.ma.getmaskarray(got) == np.ma.getmaskarray(want)).all() and np.ma.allclose(got, want), (over, options)
    want = values(g.collapsed("x", A.MEDIAN))
    monkeypatch.setattr(reduce, "RANKED_CELLS", 0)
    assert np.ma.allclose(values(g.collapsed("x", A.MEDIAN)), want)

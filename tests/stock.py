"""Small fields with known values."""

import numpy as np

from gridspark.frame import Coord, Grid


def field(spark, values, names, coords=(), **more):
    """A field from an array; None or masked entries are masked, NaN stays."""
    a = np.ma.asarray(values)
    mask = np.ma.getmaskarray(a)
    rows = [(*map(int, at), None if mask[at] else float(a[at])) for at in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, ", ".join([*(f"i_{n} int" for n in names), "v double"]))
    return Grid(df=df, dims=dict(zip(names, a.shape)), coords=tuple(coords), long_name=more.pop("name", "thing"), **more)


def values(grid):
    """The cells as a masked array."""
    out = np.ma.masked_all(grid.shape)
    for row in grid.df.where("v is not null").select(*grid.keys(), "v").collect():
        out[tuple(row[:-1])] = row[-1]
    return out


def axis(name, points, bounds=None, dim=None, **more):
    p = np.asarray(points)
    return Coord(long_name=name, points=p, bounds=None if bounds is None else np.asarray(bounds), dims=(dim or name,), is_dim=p.dtype.kind in "iuf", **more)


def simple_1d(spark):
    return field(spark, np.arange(11), ["foo"], [axis("foo", np.arange(1, 12), [(k, k + 1) for k in range(11)])])


def simple_2d(spark):
    bar = axis("bar", [2.5, 7.5, 12.5], [(0, 5), (5, 10), (10, 15)])
    foo = axis("foo", [-7.5, 7.5, 22.5, 37.5], [(-15, 0), (0, 15), (15, 30), (30, 45)])
    return field(spark, np.arange(12).reshape(3, 4), ["bar", "foo"], [bar, foo])


def simple_3d(spark, masked=False):
    a = np.ma.arange(24).reshape(2, 3, 4)
    if masked:
        a = np.ma.masked_less_equal(a, 8)
    wibble = axis("wibble", [10.0, 30.0])
    lat = Coord(standard_name="latitude", units="degrees", points=np.array([90.0, 0.0, -90.0]), dims=("latitude",), is_dim=True)
    lon = Coord(standard_name="longitude", units="degrees", points=np.array([-180.0, -90.0, 0.0, 90.0]), dims=("longitude",), is_dim=True, circular=True)
    return field(spark, a, ["wibble", "latitude", "longitude"], [wibble, lat, lon])

"""Fields built from the driver's tables: each a grid with the SQL of the same cells."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import Coord, Grid

DAY = "cast(datediff(to_date({0}), date'1970-01-01') as bigint)"
SQL_DAY = "CAST(datediff('day', DATE '1970-01-01', CAST({0} AS DATE)) AS BIGINT)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _days(spark: SparkSession, d: str, name: str, column: str) -> np.ndarray:
    """Every day between a table's first and last."""
    lo, hi = table(spark, d, name).agg(F.expr(f"min({DAY.format(column)})"), F.expr(f"max({DAY.format(column)})")).head()
    return np.arange(lo, hi + 1)


def as_time(c: Coord) -> Coord:
    return replace(c, units="days since 1970-01-01")


def events_day(spark: SparkSession, d: str) -> Grid:
    """Mean value by day, event type and user; many cells are masked."""
    raw = table(spark, d, "events")
    df = raw.groupBy(F.expr(DAY.format("ts")).alias("day"), "event_type", "user_id").agg(F.avg("value").alias("v"))
    g = Grid.from_table(df, {"day": _days(spark, d, "events", "ts"), "event_type": None, "user_id": None}, "v", source=raw, long_name="value", units="m")
    return g.replace_coord(as_time(g.coord("day")))


EVENTS = f"ev AS (SELECT {SQL_DAY.format('ts')} AS day, event_type, user_id, avg(value) AS v FROM events GROUP BY ALL)"


def orders_day(spark: SparkSession, d: str) -> Grid:
    """Total price by day; days without orders are masked."""
    df = table(spark, d, "orders").groupBy(F.expr(DAY.format("o_orderdate")).alias("day")).agg(F.sum("o_totalprice").alias("v"))
    g = Grid.from_table(df, {"day": _days(spark, d, "orders", "o_orderdate")}, "v", long_name="price", units="kg")
    return g.replace_coord(as_time(g.coord("day")))


ORDERS = f"od AS (SELECT {SQL_DAY.format('o_orderdate')} AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"


def _shipped(spark: SparkSession, d: str) -> DataFrame:
    month = F.expr("cast((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 as bigint)")
    return table(spark, d, "lineitem").withColumns({"month": month, "supp": F.col("l_suppkey")})


def _by_month(raw: DataFrame, column: str, axes: dict, **names) -> Grid:
    df = raw.groupBy("month", "supp").agg(F.sum(column).alias("v"))
    return Grid.from_table(df, axes, "v", source=raw, **names)


def sales(spark: SparkSession, d: str) -> Grid:
    """Extended price by ship month (months since 1970) and supplier."""
    return _by_month(_shipped(spark, d), "l_extendedprice", {"month": None, "supp": None}, long_name="sales", units="kg")


def sales_and_quantity(spark: SparkSession, d: str) -> tuple[Grid, Grid]:
    """:func:`sales` and :func:`quantity`, their axes found in one pass."""
    first = sales(spark, d)
    axes = {n: first.coord(n).points for n in ("month", "supp")}
    return first, _by_month(_shipped(spark, d), "l_quantity", axes, long_name="quantity", units="m")


SALES = "sa AS (SELECT CAST((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS BIGINT) AS month, l_suppkey AS supp, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"


def quantity(spark: SparkSession, d: str) -> Grid:
    """Quantity by ship month and supplier: weights for :func:`sales`."""
    return _by_month(_shipped(spark, d), "l_quantity", {"month": None, "supp": None}, long_name="quantity", units="m")


QUANTITY = "qu AS (SELECT CAST((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS BIGINT) AS month, l_suppkey AS supp, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def price_size(spark: SparkSession, d: str) -> Grid:
    """Mean retail price by part size 1 to 50, cells of width 1."""
    df = table(spark, d, "part").groupBy(F.col("p_size").cast("bigint").alias("size")).agg(F.avg("p_retailprice").alias("v"))
    g = Grid.from_table(df, {"size": np.arange(1, 51)}, "v", long_name="price", units="kg")
    return g.replace_coord(replace(g.coord("size").guess_bounds(), units="m"))


PRICE = "ps AS (SELECT CAST(p_size AS BIGINT) AS size, avg(p_retailprice) AS v FROM part GROUP BY ALL)"


def price_plane(spark: SparkSession, d: str) -> Grid:
    """Mean extended price by line number (x, 1 to 7) and quantity (y, 1 to 50), both with cells of width 1."""
    df = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("x"), F.col("l_quantity").cast("bigint").alias("y")).agg(F.avg("l_extendedprice").alias("v"))
    g = Grid.from_table(df, {"y": np.arange(1, 51), "x": np.arange(1, 8)}, "v", long_name="price", units="kg")
    for n in ("x", "y"):
        g = g.replace_coord(replace(g.coord(n).guess_bounds(), units="m"))
    return g


PLANE = "pl AS (SELECT CAST(l_linenumber AS BIGINT) AS x, CAST(l_quantity AS BIGINT) AS y, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"


def embed(spark: SparkSession, d: str) -> Grid:
    """Embedding components by vector and component."""
    df = table(spark, d, "embeddings").select(F.col("vec_id"), F.posexplode("embedding").alias("comp", "v")).withColumn("comp", F.col("comp").cast("bigint"))
    return Grid.from_table(df, {"vec_id": None, "comp": np.arange(64)}, "v", source=table(spark, d, "embeddings"), long_name="embedding")


EMBED = "em AS (SELECT vec_id, CAST(unnest(range(0, 64)) AS BIGINT) AS comp, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def nations(spark: SparkSession, d: str) -> Grid:
    """Customers' mean balance by nation, with invented latitude and longitude, both with bounds."""
    df = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(F.avg("c_acctbal").alias("v"))
    g = Grid.from_table(df, {"nation": np.arange(25)}, "v", long_name="balance", units="kg")
    k = np.arange(25)
    lat, lon = -84.0 + 7.0 * k, (97 * k) % 360 - 180.0
    g = g.with_coord(Coord(standard_name="latitude", units="degrees", points=lat, bounds=np.stack([lat - 3.5, lat + 3.5], axis=1), dims=("nation",)))
    return g.with_coord(Coord(standard_name="longitude", units="degrees", points=lon, dims=("nation",)))


NATIONS = "na AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, avg(c_acctbal) AS v, -84.0 + 7.0 * c_nationkey AS lat, (97 * c_nationkey) % 360 - 180.0 AS lon FROM customer GROUP BY c_nationkey)"


def world(spark: SparkSession, d: str) -> Grid:
    """Mean quantity on a 10-degree latitude by 10-degree longitude grid, from keys folded onto the sphere; longitude is circular."""
    lon, lat = F.expr("cast(l_partkey % 36 as bigint)"), F.expr("cast(l_suppkey % 18 as bigint)")
    df = table(spark, d, "lineitem").groupBy(lat.alias("latitude"), lon.alias("longitude")).agg(F.avg("l_quantity").alias("v"))
    g = Grid.from_table(df, {"latitude": np.arange(18), "longitude": np.arange(36)}, "v", long_name="quantity", units="kg")
    y = Coord(standard_name="latitude", units="degrees", points=-85.0 + 10 * np.arange(18), dims=("latitude",), is_dim=True)
    x = Coord(standard_name="longitude", units="degrees", points=5.0 + 10 * np.arange(36), dims=("longitude",), is_dim=True, circular=True)
    return replace(g, coords=(y.guess_bounds(), x.guess_bounds()))


WORLD = "wo AS (SELECT -85.0 + 10 * (l_suppkey % 18) AS latitude, 5.0 + 10 * (l_partkey % 36) AS longitude, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def world_months(spark: SparkSession, d: str) -> Grid:
    """Total quantity by ship month on the grid of :func:`world`; months are counted as 30 days of 24 hours from 1970."""
    month = F.expr("cast((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 as bigint)")
    raw = table(spark, d, "lineitem").withColumns({"month": month, "latitude": F.expr("cast(l_suppkey % 18 as bigint)"), "longitude": F.expr("cast(l_partkey % 36 as bigint)")})
    df = raw.groupBy("month", "latitude", "longitude").agg(F.sum("l_quantity").alias("v"))
    g = Grid.from_table(df, {"month": None, "latitude": np.arange(18), "longitude": np.arange(36)}, "v", source=raw, long_name="quantity", attributes={"STASH": "m01s05i216"})
    base = world(spark, d)
    t = replace(g.coord("month"), standard_name="time", long_name=None, units="hours since 1970-01-01", points=g.coord("month").points * 720.0, calendar="360_day")
    return replace(g, coords=(t, *base.coords))


MONTHS = "wm AS (SELECT CAST((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS BIGINT) AS month, -85.0 + 10 * (l_suppkey % 18) AS latitude, 5.0 + 10 * (l_partkey % 36) AS longitude, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"

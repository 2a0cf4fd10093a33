"""Every query against its SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridspark import fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = _sorted(__spark_entry__.queries()[name](spark, SF).toPandas()), _sorted(duck.execute(ORACLES[name]).df())
    assert got.columns.tolist() == want.columns.tolist() and len(got) == len(want)
    for c in got.columns:
        if pd.api.types.is_numeric_dtype(got[c]) and not pd.api.types.is_bool_dtype(got[c]):
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-5, equal_nan=True), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_combine_reaches_every_supplier(spark, duck):
    got = __spark_entry__.queries()["combine_cubes"](spark, SF).toPandas()
    n, suppliers = duck.execute("SELECT count(*), count(DISTINCT l_suppkey) FROM (SELECT DISTINCT date_trunc('month', l_shipdate), l_suppkey FROM lineitem)").fetchone()
    assert len(got) == n and got.supp.nunique() == suppliers > 3


def test_save_and_load_reads_written_cells(spark, duck):
    got = __spark_entry__.queries()["save_and_load"](spark, SF)
    assert got.inputFiles() and all("/stored-" in f and "/cells/" in f for f in got.inputFiles())
    assert got.select("supp").distinct().count() == duck.execute("SELECT count(DISTINCT l_suppkey) FROM lineitem").fetchone()[0]


@pytest.mark.parametrize("name", ["stream_daily_mean", "stream_sessions"])
def test_streams_read_a_table_of_part_files(spark, duck, tmp_path, name):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got, want = _sorted(__spark_entry__.queries()[name](spark, str(tmp_path)).toPandas()), _sorted(duck.execute(ORACLES[name]).df())
    assert len(got) == len(want) > 0 and got["n"].sum() == want["n"].sum() and np.array_equal(got["start_s"], want["start_s"])


def test_fingerprint_of_sums_that_differ_when_computed_again(spark, duck, monkeypatch):
    """As on a cluster, where parts of a sum arrive in any order."""
    sales = fixtures.sales

    def noisy(spark, d):
        import random

        g = sales(spark, d)
        again = F.udf(lambda v: v * (1 + 1e-14 * random.SystemRandom().random()), "double").asNondeterministic()
        return g.with_df(g.df.withColumn("v", again("v")))

    monkeypatch.setattr(fixtures, "sales", noisy)
    got = __spark_entry__.queries()["fingerprint_equality"](spark, SF).toPandas()
    assert got.to_dict("records") == duck.execute(ORACLES["fingerprint_equality"]).df().to_dict("records")


def test_fingerprint_changes_a_cell_that_is_there(spark, tmp_path):
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_suppkey < 2").write.parquet(f"{tmp_path}/lineitem.parquet")
    (row,) = __spark_entry__.queries()["fingerprint_equality"](spark, str(tmp_path)).collect()
    assert row.n > 0 and row.equal and not row.changed_equal


def test_relevel_passes_over_months_without_sales(spark, tmp_path):
    """Half the suppliers miss the 16th and 17th month, between which and their neighbours a target lies."""
    month = F.expr("(year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("m", month)
    first = lines.agg(F.min("m")).head()[0]
    lines.where(~((F.col("l_suppkey") % 2 == 1) & F.col("m").isin(first + 15, first + 16))).drop("m").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got, want = _sorted(__spark_entry__.queries()["relevel"](spark, str(tmp_path)).toPandas()), _sorted(con.execute(ORACLES["relevel"]).df())
    odd = want[(want.supp % 2 == 1) & (want.level == 155.5)]
    assert len(odd) > 0 and got[["supp", "level"]].equals(want[["supp", "level"]])
    assert np.allclose(got.v, want.v, rtol=1e-9, atol=1e-5)

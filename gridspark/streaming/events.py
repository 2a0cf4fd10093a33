"""Grids from streams: the same categories and aggregators over unbounded events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregators import Aggregator
from ..functions.calendar import SEASONS, season_column


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp of an instant; one without zone is read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")) if stream.schema[time].dataType.simpleString() == "timestamp_ntz" else stream


def windowed(stream: DataFrame, time: str, value: str, agg: Aggregator, width: str, slide: str | None = None, by: tuple[str, ...] = (), late: str = "10 minutes", **options) -> DataFrame:
    """A plain aggregator over tumbling or sliding windows and categories; data later than ``late`` are dropped."""
    if agg.kind != "plain":
        raise ValueError(f"{agg.name} needs an order or a whole group")
    span = F.window(time, width, slide) if slide else F.window(time, width)
    own = _timed(stream, time).withWatermark(time, late).withColumn("v", F.col(value).cast("double"))
    out = own.groupBy(span.alias("w"), *by).agg(agg.expr(F.col("v"), None, **{**agg.defaults, **options}).alias("v"), F.count("v").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "v", "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: its events with no gap longer than ``gap``."""
    out = _timed(stream, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


def by_season(stream: DataFrame, time: str, value: str, agg: Aggregator, seasons=SEASONS, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Daily (or wider) aggregates with the season as a category, so that state is dropped with the watermark."""
    return windowed(stream.withColumn("season", season_column(F.month(time), seasons)), time, value, agg, width, by=("season",), late=late)


def longest_runs(stream: DataFrame, key: str, time: str, passes: Column) -> DataFrame:
    """The longest run so far of events of a key that pass, in time order inside each batch; state is three numbers a key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    own = stream.select(F.col(key).cast("string").alias("key"), F.col(time).alias("ts"), F.coalesce(passes, F.lit(False)).alias("hit"))

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, best, n = state.get if state.exists else (0, 0, 0)
        parts = [b for b in batches]
        for hit in pd.concat(parts).sort_values("ts", kind="stable")["hit"] if parts else ():
            run = run + 1 if hit else 0
            best, n = max(best, run), n + 1
        state.update((run, best, n))
        yield pd.DataFrame({"key": [keys[0]], "longest": [best], "n": [n]})

    return own.groupBy("key").applyInPandasWithState(step, "key string, longest long, n long", "run long, best long, n long", "update", GroupStateTimeout.NoTimeout)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; below the warehouse where a single machine names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_streams").rstrip("/")


def drained(df: DataFrame, label: str) -> DataFrame:
    """Run a complete-mode aggregation over all that its source has now, and read its last result back.

    Offsets, state and results lie in the shared folder, so a lost executor
    costs a retry; the result is replaced as a whole by every batch.
    """
    spark = df.sparkSession
    at = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result")

    query = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/result")


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table of the driver's folder as a stream of files: a folder of part files, or a single file."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)

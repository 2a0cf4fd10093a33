"""Shared plumbing of the training-data operators: batches, shared scratch tables, hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_SLICE = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, a
    folder below the warehouse is set on a single machine (tests, a laptop),
    and a cluster is refused, as its machines share no other folder for sure.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Paths of scratch tables by application, oldest first.
_SCRATCH: dict[str, list[str]] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan once; a lost executor costs
    only re-reading the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    own = _SCRATCH.get(spark.sparkContext.applicationId, [])
    if path in own:
        own.remove(path)


def discard(df: DataFrame) -> None:
    """Delete what :func:`written` wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def distilled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that ``make`` returns, written; the scratch tables written on the way are deleted."""
    own = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    before = set(own)
    out = written(make(), label)
    for path in [p for p in own if p not in before and p != out._scratch_path]:
        _delete(spark, path)
    return out


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this application; frames that read one can't be run again."""
    for path in list(_SCRATCH.get(spark.sparkContext.applicationId, [])):
        _delete(spark, path)


def arrow_schema(ddl: str) -> pa.Schema:
    """A pyarrow schema for the simple types that the operators return."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
        "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
        "array<double>": pa.list_(pa.float64()), "array<binary>": pa.list_(pa.binary()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def map_slices(df: DataFrame, make: Callable[[], Callable[..., dict[str, list]]], ddl: str, rows: int = ROWS_PER_SLICE) -> DataFrame:
    """Map column lists to column lists, a bounded slice of rows at a time.

    ``make`` runs once a task and returns the function; that gets one Python
    list for each column of ``df`` and returns the columns named in ``ddl``.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if it comes from fewer files than there are cores; a file of one row group is one task otherwise."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df._jdf.inputFiles())  # the names stay in the JVM
    return df.repartition(cores) if 0 < 2 * files < cores else df


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the whole text alone, null texts as empty."""
    return spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """The ``bound`` rows of the smallest hash of ``key``; all rows where there are no more.

    Rows beyond a hash threshold, set from the row count, are left out before
    the sort, so that each task sorts and sends its share of about twice the
    bound, not the bound.
    """
    own, n = fresh(df, "_hash"), df.count()
    hashed = df.withColumn(own, F.xxhash64(F.col(key)))
    if n > 2 * bound:
        limit = int((2 * bound + 200) / n * 2**64) - 2**63
        hashed = hashed.where(F.col(own) < F.lit(min(limit, 2**63 - 1)))
    return hashed.orderBy(own, key).limit(bound).drop(own)


def row_hash(df: DataFrame) -> F.Column:
    """A hash of all columns but maps, and of which are null, as a hash of values alone passes nulls over."""
    own = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*own, *(c.isNull() for c in own))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base

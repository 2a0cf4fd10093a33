"""Byte ranges of files read by tasks, and fields streamed into single files a slab at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Grid, index, local_table
from .store import _filesystem

#: Cells of a slab, and slabs that the driver holds at once.
SLAB, AT_ONCE = 1 << 20, 4


def local_name(spark: SparkSession, path: str) -> str | None:
    """The name under which every machine opens a file of a shared file system, or None for other stores."""
    fs, at = _filesystem(spark, path)
    return at.toUri().getPath() if fs.getScheme() == "file" else None


def with_file(spark: SparkSession, path: str, rows: Callable[[Callable[[int, int], bytes], int], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Batches that one task makes from a file that it reads through ``read(begin, size)``; ``size`` of the file comes second.

    A shared file system is read by ranges; a file of another store comes as
    one value and so has at most 2 GB.
    """
    name = local_name(spark, path)
    if name:
        def ranged(batches):
            for b in batches:
                for own in b.column(0).to_pylist():
                    with open(own, "rb") as f:

                        def read(begin: int, size: int) -> bytes:
                            f.seek(begin)
                            return f.read(size)

                        yield from rows(read, f.seek(0, 2))

        return local_table(spark, [(name,)], "name string").mapInArrow(ranged, schema)

    def whole(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                yield from rows(lambda begin, size, data=data: data[begin : begin + size], len(data))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, schema)


def with_spans(spark: SparkSession, path: str, spans: list[tuple[int, int, int]], rows: Callable[[int, bytes], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Batches made from the byte spans (number, begin, size) of a file, dealt out over tasks where ranges can be read."""
    name = local_name(spark, path)
    if name:
        table = local_table(spark, spans, "k long, begin long, size long")
        parts = min(len(spans), 4 * spark.sparkContext.defaultParallelism)

        def ranged(batches):
            with open(name, "rb") as f:
                for b in batches:
                    for k, begin, size in zip(*(c.to_pylist() for c in b.columns)):
                        f.seek(begin)
                        yield from rows(k, f.read(size))

        return (table.repartitionByRange(parts, "k") if parts > 1 else table).mapInArrow(ranged, schema)

    def whole(batches):
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                for k, begin, size in spans:
                    yield from rows(k, data[begin : begin + size])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, schema)


def slabs(grid: Grid, dims: list[str], dtype: str, fill: float, size: int = SLAB, falling: tuple[str, ...] = ()) -> Iterator[bytes]:
    """The cells in the order of ``dims``, ``falling`` ones from their end, as consecutive byte strings of ``size`` cells.

    Tasks lay the slabs out; the driver holds a few at a time.
    """
    total, place, stride = prod(grid.dims[d] for d in dims), F.lit(0).cast("long"), 1
    for d in reversed(dims):
        at = F.col(index(d)).cast("long")
        place = place + (F.lit(grid.dims[d] - 1) - at if d in falling else at) * F.lit(stride).cast("long")
        stride *= grid.dims[d]
    count = ceil(total / size)

    def lay(t: pa.Table) -> pa.Table:
        k = t["slab"][0].as_py()
        a = np.full(min(size, total - k * size), fill, dtype)
        a[t["at"].to_numpy()] = t["v"].to_numpy()
        return pa.table({"slab": pa.array([k], pa.int64()), "body": pa.array([a.tobytes()], pa.binary())})

    cells = grid.df.where("v is not null").select(place.alias("p"), "v").selectExpr(f"p div {size} as slab", f"p % {size} as at", "v")
    laid = cells.groupBy("slab").applyInArrow(lay, "slab long, body binary").repartitionByRange(max(1, ceil(count / AT_ONCE)), "slab").sortWithinPartitions("slab")
    blank = lambda k: np.full(min(size, total - k * size), fill, dtype).tobytes()
    after = 0
    for row in laid.toLocalIterator():
        while after < row.slab:
            yield blank(after)
            after += 1
        yield bytes(row.body)
        after += 1
    while after < count:
        yield blank(after)
        after += 1


@contextmanager
def created(spark: SparkSession, path: str):
    """A file to write to, replaced if it is there."""
    fs, at = _filesystem(spark, path)
    stream = fs.create(at, True)
    try:
        yield stream
    finally:
        stream.close()

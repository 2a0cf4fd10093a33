"""Sharding by a two-pass external shuffle; the law that holds is ``rows``.

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash of id, text checksum and size; records equal in all three are counted
first and dealt out ``COPIES`` at a time, so no number of them fills a bucket.
Pass two shuffles each bucket by Fisher-Yates, seeded by the bucket's number. Buckets laid end to end are a
uniform order of all rows; the row at place p goes to shard ``p mod shards``
at slot ``p div shards``, so counts differ by one at most and slots have no
gap. Copies of a text need not share a shard under this law.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash

SHARDS, SEED = 8, 20_240_607
BUCKET_BYTES = 64 << 20
MIN_BUCKETS, MIN_ROWS = 1024, 256
SLOTS_PER_FILE = 65_536
#: Equal records that are scattered as one.
COPIES = 32
#: Buckets whose sizes one task adds up.
RUN = 4096


def bucket_count(rows: int, size: int) -> int:
    """Enough buckets that one holds ``BUCKET_BYTES`` of text on average; up to ``MIN_BUCKETS`` are used anyway while they get ``MIN_ROWS``."""
    return max(1, -(-size // BUCKET_BYTES), min(MIN_BUCKETS, rows // MIN_ROWS))


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1: for i from the end, swap place i with a uniform place up to i."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else []):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, _n) → (bucket, _off): the rows in the buckets before, added up in runs of ``RUN`` buckets."""
    run = F.expr(f"bucket div {RUN}")
    counts = counts.withColumn("_run", run)
    before = lambda *keys: Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("_run").agg(F.sum("_n").alias("_n"), F.min("bucket").alias("bucket"))  # one row for RUN buckets
    starts = runs.select("_run", F.coalesce(F.sum("_n").over(before()), F.lit(0)).alias("_start"))
    inside = counts.select("_run", "bucket", F.coalesce(F.sum("_n").over(before("_run")), F.lit(0)).alias("_in"))
    return inside.join(starts, "_run").select("bucket", (F.col("_start") + F.col("_in")).alias("_off"))


def _placed(ordered: pa.Table, copies: np.ndarray | None, columns: list[str], shards: int, seed: int) -> pa.Table:
    """The rows of a bucket, each as often as ``copies`` says, with the shard and slot that Fisher-Yates gives them."""
    index = np.arange(len(ordered)) if copies is None else np.repeat(np.arange(len(ordered)), copies)
    place = ordered["_off"][0].as_py() + fisher_yates(len(index), seed + ordered["bucket"][0].as_py())
    out = ordered.select(columns).take(pa.array(index))
    return out.append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards))


def sharded(df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), bucket for every row.

    Null texts count as no bytes; a null doc_id is scattered like a value and
    stays null; ids keep all 64 bits. Rows equal in id and text are
    interchangeable and each keep a place of their own. An empty table gives
    no rows; other columns are ignored.
    """
    light = _records(df, id_col, text_col)
    rows, size = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    n = bucket_count(rows, size)
    alike = light.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_all"))
    parts = alike.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_all - 1) div {COPIES})"))).withColumn("_m", F.expr(f"least({COPIES}L, _all - _part * {COPIES})")).drop("_all")
    scattered = parts.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "_part")).withColumn("bucket", F.pmod("_key", F.lit(n)))
    offsets = _offsets(scattered.groupBy("bucket").agg(F.sum("_m").alias("_n")))

    def shuffle(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("_key", "doc_id", "text_crc32", "size", "_part")])
        return _placed(t, t["_m"].to_numpy(), ["doc_id", "size", "text_crc32", "bucket"], shards, seed)

    placed = scattered.join(offsets, "bucket").groupBy("bucket").applyInArrow(shuffle, "doc_id long, size long, text_crc32 long, bucket long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket")


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows as ``path/shard=k`` in slot order, by the same two passes with the rows carried along.

    ``df`` may have any columns but shard and slot; nulls stay null and longs
    keep all 64 bits. Rows equal in id and text share a bucket here; where
    there are at most ``COPIES`` of them, places are those of :func:`sharded`.
    An empty table writes no rows.
    """
    if {c.lower() for c in df.columns} & {"shard", "slot"}:
        raise ValueError("columns shard and slot are the writer's")
    rows, size = _records(df, id_col, text_col).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    n = bucket_count(rows, size)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.crc32(body.cast("binary")), (F.octet_length(body) + 1).cast("long"), F.lit(0).cast("long"))
    names = [f"c{k}" for k in range(len(df.columns))]
    own = [F.col(f"`{c}`").alias(k) for k, c in zip(names, df.columns)]
    whole = df.select(key.alias("_key"), F.pmod(key, F.lit(n)).alias("bucket"), F.col(id_col).cast("long").alias("_id"), row_hash(df).alias("_tie"), *own)
    offsets = _offsets(whole.groupBy("bucket").agg(F.count("*").alias("_n")))

    def shuffle(t: pa.Table) -> pa.Table:
        out = _placed(t.sort_by([(c, "ascending") for c in ("_key", "_id", "_tie")]), None, names, shards, seed)
        return out.sort_by("slot")

    schema = ", ".join([*(f"{k} {f.dataType.simpleString()}" for k, f in zip(names, df.schema)), "shard int", "slot long"])
    out = whole.join(offsets, "bucket").groupBy("bucket").applyInArrow(shuffle, schema)
    files = max(1, -(-rows // (shards * SLOTS_PER_FILE)))
    dealt = out.repartitionById(shards * files, F.expr(f"cast(shard * {files} + slot div {SLOTS_PER_FILE} as int)")).sortWithinPartitions("shard", "slot")
    dealt.select(*(F.col(k).alias(c) for k, c in zip(names, df.columns)), "shard", "slot").write.partitionBy("shard").parquet(path)

"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint is the bitwise majority over the XXH64 hashes of its
3-word shingles. Two fingerprints link at Hamming distance 3 or less.

Candidate search is the pigeonring principle with 8 segments of 8 bits on a
ring: if at most 3 bits differ in all, some segment starts a chain whose first
``l`` segments together differ in at most ``3 * l / 8`` bits, for every ``l``.
So the chain's first two segments agree, and its first five differ in one bit
at most. One differing bit in the 24 bits of segments three to five leaves
their first or last 12 bits equal, which gives an equality key of 28 bits:
8 starts x 2 halves = 16 keys a fingerprint. A bucket's pairs pass the rest of
the chain budgets before the full Hamming check.

Only distinct fingerprints are searched, and a bucket gives the edges of
stars that span its links, never all its pairs; a bucket of more than
``BLOCK`` fingerprints is dealt out as pairs of blocks to further tasks, which
sends each of its n fingerprints out n / ``BLOCK`` times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fresh, map_slices, row_hash, spread, texts, written
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
SEGMENTS, WIDTH = 8, 8
BLOCK = 4096
#: Parts that the rows of one fingerprint, or the fingerprints of one component, are joined in.
PARTS = 64


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint; 0 for a text without words or null."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone is lowered, and white space is ASCII's
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(SHINGLE, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def make():
        def fn(ids, docs):
            fps = [fingerprint(t) for t in docs]
            return {"doc_id": ids, "fp": [x - (1 << 64) if x >> 63 else x for x in fps]}

        return fn

    return map_slices(texts(df, id_col, text_col), make, "doc_id long, fp long")


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    """x with the bits from ``by`` on moved to the low end."""
    return x if by == 0 else (x >> np.uint64(by)) | (x << np.uint64(64 - by))


def ring_keys(fp: F.Column) -> F.Column:
    """The 16 chain keys of a signed fingerprint column, as an array of longs."""
    keys = []
    for start in range(SEGMENTS):
        by = start * WIDTH
        turned = fp if by == 0 else F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, 64 - by))
        for half in range(2):
            mask = 0xFFFF | (0xFFF << (16 + 12 * half))
            keys.append(turned.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((2 * start + half) << 40)))
    return F.array(*keys)


def _linked(one: np.ndarray, many: np.ndarray, by: int) -> np.ndarray:
    """Which of ``many`` link to ``one``: chain budgets from the start ``by`` first, then Hamming."""
    diff = _rotated(one ^ many, by)
    ok = np.bitwise_count(diff & np.uint64((1 << 40) - 1)) <= 5 * RADIUS // SEGMENTS
    ok &= np.bitwise_count(diff & np.uint64((1 << 48) - 1)) <= 6 * RADIUS // SEGMENTS
    ok &= np.bitwise_count(diff & np.uint64((1 << 56) - 1)) <= 7 * RADIUS // SEGMENTS
    return ok & (np.bitwise_count(diff) <= RADIUS)


def _stars(fps: np.ndarray, by: int) -> list[tuple[np.uint64, np.uint64]]:
    """Edges (member, root) that span the links among the fingerprints of a bucket."""
    left, edges = fps, []
    while len(left) > 1:
        root, left, reach = left[0], left[1:], [left[0]]
        while reach and len(left):
            near = _linked(reach.pop(), left, by)
            if near.any():
                found = left[near]
                edges += [(x, root) for x in found]
                reach += list(found)
                left = left[~near]
    return edges


PAIRS = arrow_schema("u long, v long, key long, i int, j int")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key → edges (u, v); oversized buckets → (u, null, key, i, j) for block pairs."""

    def bucket(key: int, fps: np.ndarray) -> Iterator[tuple]:
        if len(fps) <= BLOCK:
            for a, b in _stars(fps, (key >> 41) * WIDTH):
                yield int(a.view(np.int64)), int(b.view(np.int64)), None, None, None
            return
        n = -(-len(fps) // BLOCK)
        for at, x in enumerate(fps.view(np.int64).tolist()):
            block = at % n
            for other in range(n):
                yield x, None, key, min(block, other), max(block, other)

    def buckets() -> Iterator[tuple[int, np.ndarray]]:
        """Each key with its fingerprints, joined once, however many batches they came in."""
        open_key, pieces = None, []
        for b in batches:
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)].tolist() if len(keys) else [0]
            for s, e in zip(cuts, cuts[1:]):
                if keys[s] != open_key:
                    if sum(map(len, pieces)) > 1:
                        yield open_key, np.concatenate(pieces)
                    open_key, pieces = int(keys[s]), []
                pieces.append(fps[s:e].view(np.uint64))
        if sum(map(len, pieces)) > 1:
            yield open_key, np.concatenate(pieces)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PAIRS)], schema=PAIRS)

    out: list[tuple] = []
    for key, fps in buckets():
        for row in bucket(key, fps):
            out.append(row)
            if len(out) >= 10_000:
                yield batch(out)
                out = []
    if out:
        yield batch(out)


def _block_pair(pdf):
    """One pair of blocks of an oversized bucket → its star edges."""
    import pandas as pd

    fps = pdf["u"].to_numpy().view(np.uint64)
    edges = _stars(fps, (int(pdf["key"].iloc[0]) >> 41) * WIDTH)
    return pd.DataFrame({"u": [int(a.view(np.int64)) for a, _ in edges], "v": [int(b.view(np.int64)) for _, b in edges]}, dtype="int64")


def links(distinct_fps: DataFrame) -> DataFrame:
    """(fp) distinct → edges (u, v) that span every link of distance 1 to 3."""
    keyed = distinct_fps.select(F.explode(ring_keys(F.col("fp"))).alias("key"), F.col("fp"))
    n = int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_search, "u long, v long, key long, i int, j int"), "ring")
    more = found.where("v is null").groupBy("key", "i", "j").applyInPandas(_block_pair, "u long, v long")
    return found.where("v is not null").select("u", "v").unionByName(more)


def _component_ids(classes: DataFrame, first: str) -> DataFrame:
    """(fp, ``first``), one row a fingerprint → (fp, least ``first`` of all fingerprints linked to it).

    Most fingerprints link to no other and need no join by root; those that do
    are joined to their root's least value by root and a part of the root, so
    that a component of any size is spread.
    """
    found = components(links(classes.select("fp")))
    held = found.withColumnRenamed("node", "fp").join(classes, "fp").withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int"))
    parts = held.groupBy("root", "part").agg(F.min(first).alias("least"))
    least = parts.groupBy("root").agg(F.min("least").alias("least"), F.collect_list("part").alias("part")).select("root", "least", F.explode("part").alias("part"))
    least = least.repartition("root", "part")  # else, where the other side is broadcast, a component stays in its root's task
    named = held.join(least, ["root", "part"]).select("fp", "least")
    return classes.join(named, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col(first)).otherwise(F.col("least")).alias("least"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links. Null and empty
    texts and texts of white space alone have fingerprint 0 and link like any
    other; repeated rows stay and share a component; a null doc_id keeps its
    row but never names a component unless all of the component are null. An
    empty table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(df, id_col, text_col), "fp").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    parts = fps.groupBy("fp", "part").agg(F.min("doc_id").alias("first_id"))  # copies meet by parts, not all in one task
    classes = written(parts.groupBy("fp").agg(F.min("first_id").alias("first_id")), "fpclass")
    ids = parts.select("fp", "part").join(_component_ids(classes, "first_id"), "fp")
    return fps.join(ids, ["fp", "part"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of fingerprints the one row that comes first by id (null last), then by a hash of the row.

    Only rows whose fingerprints link are dropped: rows that share an id but
    no link all stay. Rows equal in every column are one row. All columns are
    kept as they are; an empty table gives no rows.
    """

    def make():
        def fn(ids, docs, hashes):
            fps = [fingerprint(t) for t in docs]
            return {"doc_id": ids, "fp": [x - (1 << 64) if x >> 63 else x for x in fps], "tie": hashes}

        return fn

    slim = spread(df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), row_hash(df).alias("tie")))
    fps = map_slices(slim, make, "doc_id long, fp long, tie long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("tie"))).alias("first")
    classes = written(fps.groupBy("fp").agg(first), "fpclass")
    keep = _component_ids(classes, "first").select("least.doc_id", "least.tie").distinct()
    own = [fresh(df, x) for x in ("_own_id", "_own_null", "_own_tie")]
    kept = [fresh(df, x) for x in ("_kept_id", "_kept_null", "_kept_tie")]
    named = lambda key, tie, names: [F.coalesce(key, F.lit(0)).alias(names[0]), key.isNull().alias(names[1]), tie.alias(names[2])]
    marked = df.select("*", *named(F.col(f"`{id_col}`").cast("long"), row_hash(df), own))
    keep = keep.select(*named(F.col("doc_id"), F.col("tie"), kept))
    same = [F.col(a) == F.col(b) for a, b in zip(own, kept)]
    return marked.join(keep, same, "left_semi").dropDuplicates(own).drop(*own)

"""Mixing sources to target weights by Pfair scheduling, all in DataFrame functions.

Each source is cut into blocks. With integer tickets w of W in all, block k of
a source (from 0) is released at slot ``floor(k W / w)`` and due by slot
``ceil((k + 1) W / w)``; serving the earliest deadline among the released
blocks meets every deadline, so at any slot each source is less than one block
from its share. When a source runs out, a new phase begins with the sources
that are left, so every row is placed exactly once.

Within a phase the schedule repeats after W slots. So only one period a phase
is laid out, from the tickets and the sources' row counts alone; each row
then finds its slot by arithmetic from its rank inside its source. Ranks come
from row numbers inside hash buckets plus bucket offsets, so a source with a
third of all rows is spread over many tasks.

Any number of sources is placed. A phase that ends inside its first period is
laid out up to its end only, so the driver's work grows with the slots that
are served, never with sources times phases.
"""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

from .common import fresh, row_hash

BLOCK_ROWS = 32
TICKETS = 1024
#: Up to so many sources the schedule is a broadcast table of arrays; beyond, a table of blocks that is joined.
BROADCAST_SOURCES = 500
ROWS_PER_BUCKET, MAX_BUCKETS = 1024, 1 << 16
PRIME, STEP, SHIFT = 2_147_483_647, 1_103_515_245, 12_345

PHASE = "struct<phase:int,lo:long,hi:long,start:long,row_start:long,w:long,total:long,slots:array<int>>"
PHASES = f"array<struct<source:string,phases:array<{PHASE}>>>"
PART = ("phase", "lo", "hi", "start", "row_start", "w", "total", "slots")


def period(tickets: list[int]) -> list[int]:
    """Which source each of the W slots of one period serves: earliest deadline, then lowest index."""
    total, out = sum(tickets), []
    waiting = [(0, i, 0) for i in range(len(tickets))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // tickets[i]), i, k))
        due, i, k = heapq.heappop(ready)
        assert due > slot
        out.append(i)
        if k + 1 < tickets[i]:
            heapq.heappush(waiting, ((k + 1) * total // tickets[i], i, k + 1))
    return out


def plan(rows: list[int], tickets: list[int], block_rows: int = BLOCK_ROWS) -> list[list[dict]]:
    """For each source its phases: block range, first slot and row of the phase, tickets, slots in a period."""
    left = [-(-r // block_rows) for r in rows]
    done, out = [0] * len(rows), [[] for _ in rows]
    alike: dict[int, list[int]] = {}  # sources that are left, by tickets
    for i, n in enumerate(left):
        if n:
            alike.setdefault(tickets[i], []).append(i)
    weights = sorted(alike, reverse=True)
    total = sum(w * len(own) for w, own in alike.items())
    start = row_start = phase = 0
    while total:
        slots, ended = _served(alike, weights, total, left, tickets)
        if ended is None:
            last, ended = min(((left[i] - 1) // tickets[i] * total + s[(left[i] - 1) % tickets[i]], i) for i, s in slots.items())
        else:
            last = slots[ended][-1]
        length = last + 1
        whole, part = divmod(length, total)
        for i, s in slots.items():
            w = tickets[i]
            took = whole * w + bisect_left(s, part)
            if took:
                out[i].append({"phase": phase, "lo": done[i], "hi": done[i] + took, "start": start, "row_start": row_start, "w": w, "total": total, "slots": s})
            left[i], done[i] = left[i] - took, done[i] + took
        start += length
        row_start += length * block_rows - (-rows[ended] % block_rows)
        phase += 1
        own = alike[tickets[ended]]
        del own[bisect_left(own, ended)]
        total -= tickets[ended]
    return out


def _served(alike: dict[int, list[int]], weights: list[int], total: int, left: list[int], tickets: list[int]) -> tuple[dict[int, list[int]], int | None]:
    """The slots of each source that is served in one period, up to the first source that runs out, and that source.

    Sources that weren't served yet wait in order behind the first one of
    their tickets, as their deadlines are equal.
    """
    slots: dict[int, list[int]] = {}
    waiting: list[tuple[int, int, int]] = []  # release, source, block
    ready: list[tuple[int, int, int]] = []
    fresh, group = dict.fromkeys(weights, 0), 0
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // tickets[i]), i, k))
        while group < len(weights) and (not ready or -(-total // weights[group]) <= ready[0][0]):
            w = weights[group]
            if alike[w]:
                heapq.heappush(ready, (-(-total // w), alike[w][0], 0))
            group += 1
        due, i, k = heapq.heappop(ready)
        assert due > slot
        w = tickets[i]
        if not k:
            slots[i] = []
            fresh[w] += 1
            if fresh[w] < len(alike[w]):
                heapq.heappush(ready, (due, alike[w][fresh[w]], 0))
        slots[i].append(slot)
        if k + 1 == left[i]:
            return slots, i
        if k + 1 < w:
            heapq.heappush(waiting, ((k + 1) * total // w, i, k + 1))
    return slots, None


def default_tickets(rows: list[int]) -> list[int]:
    """Target weights proportional to the square root of a source's rows, as tickets of about ``TICKETS``."""
    scale = sum(math.sqrt(r) for r in rows)
    return [max(1, math.floor(TICKETS * math.sqrt(r) / scale + 0.5)) for r in rows]


def mixed(df: DataFrame, tickets: dict[str | None, int] | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, keep: bool = False, position: str = "_position") -> DataFrame:
    """Place every row in the interleaved order.

    Returns doc_id, source, phase, block (of the source), slot, release,
    deadline, position (from 0, gapless); with ``keep`` all columns of ``df``
    and the position as ``_position``. ``tickets`` maps each source to its target weight;
    without it :func:`default_tickets` holds. Null sources are a source of
    their own. Rows inside a source are ordered by a multiplicative hash of
    the id (of the row's numbers, dates and flags where the id is null), then
    by id, then by a hash of the row; rows equal in all columns are interchangeable. Any other column
    may have any name; ``keep`` needs ``_position`` to be free, and
    ``position`` names another. An empty table gives no rows; a single source
    keeps its own order.
    """
    spark = df.sparkSession
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    light = [f"`{f.name}`" for f in df.schema if isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType))]  # texts needn't be read
    at = F.coalesce(F.col(id_col).cast("long"), row_hash(df.select(*light)) if light else F.lit(0))
    spread = F.pmod(F.pmod(at, F.lit(PRIME)) * F.lit(STEP) + F.lit(SHIFT), F.lit(PRIME))
    n = df.count()
    buckets = min(MAX_BUCKETS, max(1, -(-n // ROWS_PER_BUCKET) * 4))
    rows = df.select(
        *([F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")] if keep else []),
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), name.alias("_s"), spread.alias("_h"),
        F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if f.name in (id_col, source_col) or keep and "map<" not in f.dataType.simpleString())).alias("_tie"),
    )
    rows = rows.withColumn("_b", F.expr(f"cast(_h * {buckets} div {PRIME} as int)"))
    counts = rows.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    sizes = {r[0]: r[1] for r in counts.groupBy("_s").agg(F.sum("_n")).collect()}
    names = sorted(sizes)
    shares = default_tickets([sizes[s] for s in names]) if tickets is None else [tickets[None if s == "null" else s[1:]] for s in names]
    phases = plan([sizes[s] for s in names], shares, block_rows)
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "_tie")
    ranked = rows.join(offsets, ["_s", "_b"]).withColumn("_r", F.col("_off") + F.row_number().over(order) - 1)
    ranked = ranked.withColumn("block", F.expr(f"_r div {block_rows}"))
    slot = "_k div _q.w * _q.total + _q.slots[cast(_k % _q.w as int)]"
    if len(names) <= BROADCAST_SOURCES:
        text = json.dumps([{"source": s, "phases": p} for s, p in zip(names, phases)])
        # bounded by BROADCAST_SOURCES phases of at most TICKETS + BROADCAST_SOURCES slots
        table = spark.range(1).select(F.explode(F.from_json(F.lit(text), PHASES)).alias("_t")).select(F.col("_t.source").alias("_s"), F.col("_t.phases").alias("_p"))
        placed = (
            ranked.join(F.broadcast(table), "_s")
            .withColumn("_q", F.expr("filter(_p, p -> block >= p.lo and block < p.hi)[0]"))
            .withColumn("_k", F.expr("block - _q.lo"))
            .withColumn("_t", F.expr(slot))
        )
    else:
        parts = [(s, tuple(p[k] for k in PART)) for s, own in zip(names, phases) for p in own]
        table = (
            spark.createDataFrame(parts, f"_s string, _q {PHASE}")
            .withColumn("block", F.expr("explode(sequence(_q.lo, _q.hi - 1))"))
            .withColumn("_k", F.expr("block - _q.lo"))
            .withColumn("_t", F.expr(slot))
            .withColumn("_q", F.expr("named_struct('phase', _q.phase, 'start', _q.start, 'row_start', _q.row_start, 'w', _q.w, 'total', _q.total)"))
        )
        placed = ranked.join(table, ["_s", "block"])
    placed = placed.withColumn("position", F.expr(f"_q.row_start + _t * {block_rows} + _r % {block_rows}"))
    if keep:
        return placed.select("_row.*", F.col("position").alias(position))
    return placed.selectExpr(
        "doc_id", "source", "_q.phase as phase", "block", "_q.start + _t as slot",
        "_q.start + _k * _q.total div _q.w as release", "_q.start + ((_k + 1) * _q.total + _q.w - 1) div _q.w as deadline", "position",
    )


def in_mixed_order(df: DataFrame, rows_per_file: int = 8192, **how) -> DataFrame:
    """The rows of ``df`` dealt into partitions by position and sorted, so that files follow the mix."""
    own = fresh(df, "_position")
    placed = mixed(df, keep=True, position=own, **how)
    files = max(1, -(-df.count() // rows_per_file))
    dealt = placed.repartitionById(files, F.expr(f"cast({own} div {rows_per_file} as int)"))
    return dealt.sortWithinPartitions(own).drop(own)


ORACLE = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS s, ((coalesce(doc_id, 0) % {PRIME}) * {STEP} + {SHIFT}) % {PRIME} AS h FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS rk FROM r),
c AS (SELECT s, count(*) AS n FROM r GROUP BY s),
t AS (SELECT s, n, row_number() OVER (ORDER BY s) AS i, greatest(1, CAST(floor({TICKETS} * sqrt(n) / (SELECT sum(sqrt(n)) FROM c) + 0.5) AS BIGINT)) AS w FROM c),
a AS (SELECT list(w ORDER BY i) AS w, list((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} ORDER BY i) AS b FROM t),
st AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS start, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS kk, b AS rem, w,
         CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS own_phase, CAST(0 AS BIGINT) AS release, CAST(0 AS BIGINT) AS deadline FROM a
  UNION ALL
  SELECT slot, phase + ended, CASE WHEN ended = 1 THEN slot + 1 ELSE start END,
         list_transform(kk, lambda x, i: CASE WHEN ended = 1 THEN 0 WHEN i = pick THEN x + 1 ELSE x END), rem, w, pick, phase, release, deadline
  FROM (SELECT *, CASE WHEN rem[pick] = 0 THEN 1 ELSE 0 END AS ended FROM (
    SELECT slot, phase, start, kk, list_transform(rem, lambda x, i: CASE WHEN i = pick THEN x - 1 ELSE x END) AS rem, w, pick,
           start + kk[pick] * total // w[pick] AS release, start + ((kk[pick] + 1) * total + w[pick] - 1) // w[pick] AS deadline
    FROM (SELECT *, list_min(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN rem[i] > 0 AND start + kk[i] * total // w[i] <= slot
                      THEN (start + ((kk[i] + 1) * total + w[i] - 1) // w[i]) * 1000 + i ELSE 9000000000000000000 END)) % 1000 AS pick
          FROM (SELECT slot + 1 AS slot, phase, start, kk, rem, w, list_sum(list_transform(w, lambda x, i: CASE WHEN rem[i] > 0 THEN x ELSE 0 END))::BIGINT AS total
                FROM st WHERE list_max(rem) > 0)))))
,
served AS (SELECT slot, own_phase, release, deadline, pick, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM st WHERE slot >= 0),
x AS (SELECT k.doc_id, k.source, v.own_phase AS phase, v.block, v.slot, v.release, v.deadline, row_number() OVER (ORDER BY v.slot, k.rk) - 1 AS position
      FROM k JOIN t ON k.s = t.s JOIN served v ON v.pick = t.i AND v.block = k.rk // {BLOCK_ROWS})
SELECT doc_id, source, CAST(phase AS INTEGER) AS phase, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
       CAST(release AS BIGINT) AS release, CAST(deadline AS BIGINT) AS deadline, CAST(position AS BIGINT) AS position FROM x
"""

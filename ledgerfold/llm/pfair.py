"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_rows`` documents.  A source whose
share of all weights is w gets its block k released at slot floor(k / w) and due
by slot ceil((k + 1) / w); in every slot the released block with the earliest
deadline goes next.  The share of each source then stays less than one block
away from its target at every slot before the first source runs out.

Weights are exact rational numbers and the schedule covers the whole horizon, so
no rounding repeats and no error adds up.  One task writes it as it goes, one row
per block.  With ``period`` the weights are first rounded to whole blocks of a
period (``blocks_per_period``), and the deviation is from the rounded weights.
No document is dropped: a source with more blocks than its share lasts simply
goes on after the others; ``on_target`` marks the slots before the first source
runs out.

A null source is a source of its own.  Rows with equal id keep separate places.
An empty table gives an empty schedule.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ledgerfold.session import materialize

BLOCK_ROWS, ROWS_PER_BUCKET, BATCH = 64, 5_000, 10_000


def blocks_per_period(weights: Mapping, period: int) -> dict:
    """Blocks of each source in a period: largest remainders, at least one each."""
    keys = sorted(weights, key=lambda s: (s is None, s))
    total = float(sum(weights.values()))
    if not keys:
        return {}
    if total <= 0 or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    if len(keys) > period:
        raise ValueError("more sources than slots in a period")
    spare = period - len(keys)
    exact = {s: spare * weights[s] / total for s in keys}
    blocks = {s: 1 + int(exact[s]) for s in keys}
    for s in sorted(keys, key=lambda s: (int(exact[s]) - exact[s], s is None, s))[:period - sum(blocks.values())]:
        blocks[s] += 1
    return blocks


def release(k: int, blocks: int, period: int) -> int:
    return k * period // blocks


def deadline(k: int, blocks: int, period: int) -> int:
    return -(-(k + 1) * period // blocks)


def period_slots(blocks: Mapping, period: int) -> list[tuple]:
    """(source, block, slot) of one period by earliest deadline first."""
    keys = list(blocks)
    waiting = [(0, n, 0) for n in range(len(keys))]
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, n, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(k, blocks[keys[n]], period), n, k))
        due, n, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("missed deadline")
        out.append((keys[n], k, slot))
        if k + 1 < blocks[keys[n]]:
            heapq.heappush(waiting, (release(k + 1, blocks[keys[n]], period), n, k + 1))
    return out


def exact_shares(weights: Mapping) -> tuple[dict, int]:
    """Integers in the exact proportions of ``weights``, and their sum."""
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*[w.denominator for w in exact.values()])
    parts = {s: int(w * scale) for s, w in exact.items()}
    return parts, sum(parts.values())


def schedule(parts: list[int], total: int, blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source number, block, release, deadline, slot) of the first ``blocks`` blocks of every source, earliest deadline first."""
    waiting = [(0, n, 0) for n in range(len(parts)) if blocks[n]]
    ready: list[tuple] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            free, n, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(k, parts[n], total), n, k, free))
        due, n, k, free = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("missed deadline")
        yield n, k, free, due, slot
        if k + 1 < blocks[n]:
            heapq.heappush(waiting, (release(k + 1, parts[n], total), n, k + 1))
        slot += 1


def numbered(docs: DataFrame, *, doc: str, source: str, rows: int) -> DataFrame:
    """(doc, source, number): places 0, 1, ... of each source in hash order.

    A source is dealt into hash buckets of a bounded number of rows; places
    inside a bucket come from a window, those before it from the bucket counts,
    so a source that holds a third of all rows is never one task.
    """
    buckets = 16 * max(1, -(-rows // ROWS_PER_BUCKET))
    keyed = docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source")).withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    keyed = keyed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id")) - 1
    counts = keyed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    return keyed.withColumn("place", place).join(
        counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "doc_id", "source", (F.col("before") + F.col("place")).alias("number"))


def mix(docs: DataFrame, *, doc: str = "doc_id", source: str = "source", weights: Mapping | None = None, alpha: float = 0.5,
        block_rows: int = BLOCK_ROWS, period: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, block, block_place, release, deadline, slot and on_target.

    Ordering by (slot, block_place) is the mix.  Without ``weights`` a source
    of n documents weighs n ** alpha, counted over all documents.
    """
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source).alias("s")).count().collect()}  # one row per source
    weights = {s: float(n) ** alpha for s, n in counts.items()} if weights is None else weights
    if missing := set(counts) - set(weights):
        raise ValueError(f"no weight for {sorted(map(str, missing))}")
    weights = {s: w for s, w in weights.items() if s in counts}
    keys = sorted(weights, key=lambda s: (s is None, s))
    parts, total = exact_shares(weights if period is None else blocks_per_period(weights, period))
    share, full = [parts[s] for s in keys], [counts[s] // block_rows for s in keys]

    def slots(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = schedule(share, total, [n + 1 for n in full])  # up to the first block that is not full
            while part := list(islice(rows, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["_n", "_k", "release", "deadline", "slot"])

    table = materialize(spark.range(1, numPartitions=1).mapInArrow(slots, "_n long, _k long, release long, deadline long, slot long"), "slots")
    names = spark.createDataFrame([(s, n, full[n]) for n, s in enumerate(keys)], T.StructType(  # one row per source
        [T.StructField("_s", docs.schema[source].dataType), T.StructField("_t", T.LongType()), T.StructField("_full", T.LongType())]))
    ends = table.join(F.broadcast(names), (F.col("_n") == F.col("_t")) & (F.col("_k") == F.col("_full")))
    horizon = ends.agg(F.min("slot")).first()[0] or 0
    rows = numbered(docs, doc=doc, source=source, rows=sum(counts.values()))
    rows = rows.withColumn("block", F.floor(F.col("number") / block_rows)).withColumn("block_place", F.pmod("number", F.lit(block_rows)))
    rows = rows.join(F.broadcast(names.drop("_full")), F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.join(table, (F.col("_t") == F.col("_n")) & (F.col("block") == F.col("_k")))
    return rows.select("doc_id", "source", "block", "block_place", "release", "deadline", "slot", (F.col("slot") < F.lit(horizon)).alias("on_target"))

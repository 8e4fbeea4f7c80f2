"""Exact top-k inner products by vector-approximation files.

Every vector is quantised to integers, ``floor(scale * c)``.  Two columns of a
table in the shared folder are the files: one byte a dimension names the cell a
component lies in, and the exact integers stand beside it.  A cell has a known
middle and half width, so ``q.middle +- |q|.half`` bounds every inner product.

1. The cells alone are scanned.  Each task returns the ``k`` best lower bounds
   of each query; the k-th best of all is a threshold that the result must reach.
2. The cells are scanned again.  Vectors whose upper bound reaches the threshold
   are read exactly, in falling order of that bound, until the k-th exact score
   is at least the next bound.  Each task returns at most ``k`` per query.
3. The best ``k`` of those are the result.

Equal vectors are one entry, with their smallest ``k + 1`` ids: a group of
copies, however large, is one candidate.  Queries are held in blocks of at most
``block_bytes``; more queries mean more passes, not larger broadcasts.

Cell borders are quantiles of a bounded sample (``SAMPLE`` vectors); the outer
cells end at the exact least and largest values of all rows, so bounds hold for
every row whatever the sample.

Edge cases: vectors that are null or hold null or non-finite components take no
part.  Vectors of different lengths have no inner product; empty vectors score 0
with each other.  A query's own row alone is left out, so a repeated row finds
its copy; rows without id are candidates, last among ties, and never queries.
Integers saturate at 2**62, scores at the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerfold.llm.graph import arrow_batches
from ledgerfold.llm.whiten import LONG, integers
from ledgerfold.session import materialize

SCALE, CELLS, SAMPLE, BLOCK_BYTES = 256, 64, 16_384, 16 << 20
ROWS, QUERY_ROWS = 2_048, 1_024


class Cells:
    """Cell borders of every dimension; a component's cell is one byte."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, largest: np.ndarray, cells: int = CELLS):
        at = np.linspace(0, 1, cells + 1)[1:-1]
        self.inner = [np.unique(np.quantile(s, at, method="lower")) for s in sample.T] if len(sample) else [np.empty(0, np.int64)] * len(least)
        widest = max((len(b) for b in self.inner), default=0) + 1
        self.middle, self.half = np.zeros((len(least), widest)), np.zeros((len(least), widest))
        for d, b in enumerate(self.inner):
            # cell k holds b[k - 1] <= x < b[k]; the first and last end at the extremes of all rows
            low = np.concatenate([[min(least[d], b[0] - 1) if len(b) else least[d]], b]).astype(np.float64)
            high = np.concatenate([b - 1, [max(largest[d], b[-1]) if len(b) else largest[d]]]).astype(np.float64)
            high = np.maximum(low, high)
            self.middle[d, :len(low)], self.half[d, :len(low)] = (low + high) / 2, (high - low) / 2

    def encode(self, y: np.ndarray) -> np.ndarray:
        out = np.empty(y.shape, dtype=np.uint8)
        for d, b in enumerate(self.inner):
            out[:, d] = np.searchsorted(b, y[:, d], side="right")
        return out

    def boxes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles and half widths of coded vectors."""
        d = np.arange(codes.shape[1])
        return self.middle[d, codes], self.half[d, codes]


class Queries:
    """One block of queries, shared with every task."""

    def __init__(self, rows: pa.Table, dim: int):
        self.number = rows["number"].to_numpy()
        self.ids, self.own = rows["vec_id"].to_pylist(), rows["node"].to_numpy()
        self.alone = rows["weight"].to_numpy() == 1
        self.y = long_matrix(rows["y"].combine_chunks(), dim)
        self.q, self.size = self.y.astype(np.float64), np.abs(self.y.astype(np.float64))
        self.threshold = np.full(len(self.number), -np.inf)

    def own_rows(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, column) places at which a query would meet nothing but its own row."""
        order = np.argsort(node)
        at = np.minimum(np.searchsorted(node[order], self.own), len(node) - 1)
        hit = self.alone & (node[order][at] == self.own)
        return np.flatnonzero(hit), order[at[hit]]

    def bounds(self, middle: np.ndarray, half: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that a vector in these cells can have.

        The slack covers the rounding of sums that a double does not hold exactly.
        """
        centre = self.q[rows] @ middle.T
        reach = self.size[rows] @ half.T
        slack = 1e-13 * self.size[rows].sum(1)[:, None] * (np.abs(middle).max(initial=0) + half.max(initial=0))
        reach += np.where(slack < 0.25, 0, slack)
        return (centre - reach).clip(-LONG, LONG), (centre + reach).clip(-LONG, LONG)


def long_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _scores(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of one query, as long; those that it cannot hold saturate."""
    if int(np.abs(q).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, len(q)) < LONG:
        return y @ q
    return np.array([max(-LONG, min(LONG - 1, v)) for v in y.astype(object) @ q.astype(object)], dtype=np.int64)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest values of every row (padded with minus infinity)."""
    if values.shape[1] > k:
        values = np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k:]
    return values


def _lower_bounds(codes: DataFrame, cells, queries, dim: int, k: int) -> DataFrame:
    """(number, bound): the ``k`` best lower bounds of each query in each task."""
    def work(batches):
        q, c = queries.value, cells.value
        best = np.full((len(q.number), k), -np.inf)
        for batch in _small(batches):
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, dim)
            middle, half = c.boxes(codes)
            row, column = q.own_rows(batch.column(0).to_numpy())
            for lo in range(0, len(q.number), QUERY_ROWS):
                part = slice(lo, lo + QUERY_ROWS)
                low, _ = q.bounds(middle, half, part)
                here = (row >= lo) & (row < lo + QUERY_ROWS)
                low[row[here] - lo, column[here]] = -np.inf
                best[part] = _best(np.concatenate([best[part], _best(low, k)], axis=1), k)
        at, place = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q.number[at]), pa.array(best[at, place])], names=["number", "bound"])

    return codes.mapInArrow(work, "number long, bound double")


def _visited(data: DataFrame, cells, queries, dim: int, k: int) -> DataFrame:
    """(number, score, node): the ``k`` best exact scores of each query in each task."""
    def work(batches):
        q, c = queries.value, cells.value
        kept: list[list[tuple]] = [[] for _ in q.number]  # (score, order of the first id, node), the k best
        for batch in _small(batches):
            node, first = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, dim)
            y = long_matrix(batch.column(3), dim)
            middle, half = c.boxes(codes)
            row, column = q.own_rows(node)
            for lo in range(0, len(q.number), QUERY_ROWS):
                part = slice(lo, lo + QUERY_ROWS)
                _, high = q.bounds(middle, half, part)
                here = (row >= lo) & (row < lo + QUERY_ROWS)
                high[row[here] - lo, column[here]] = -np.inf
                floor = np.array([x[-1][0] if len(x) == k else -np.inf for x in kept[part]], dtype=np.float64)
                reached = (high >= np.maximum(floor, q.threshold[part])[:, None]) & (high > -np.inf)
                for i in np.flatnonzero(reached.any(1)):
                    at = np.flatnonzero(reached[i])
                    at = at[np.argsort(-high[i, at], kind="stable")]
                    mine = kept[lo + i]
                    for s in range(0, len(at), 64):
                        some = at[s:s + 64]
                        if len(mine) == k and float(mine[-1][0]) > high[i, some[0]]:
                            break  # certain: no later vector can do better
                        found = _scores(q.y[lo + i], y[some])
                        mine += [(int(v), _order(first[j], q, lo + i, node[j]), int(node[j])) for v, j in zip(found, some)]
                        mine.sort(reverse=True)
                        del mine[k:]
        rows = [(int(q.number[i]), s, n) for i, mine in enumerate(kept) for s, _, n in mine]
        for lo in range(0, len(rows), 10_000):
            number, score, node = zip(*rows[lo:lo + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (number, score, node)], names=["number", "score", "node"])

    return data.select("node", "ids", "codes", "y").mapInArrow(work, "number long, score long, node long")


def _order(ids: list, q: Queries, i: int, node: int) -> tuple[int, int]:
    """Sorts entries of equal score: the smaller an entry's first id, the larger; null is the least."""
    rest = list(ids)
    if node == q.own[i] and q.ids[i] in rest:
        rest.remove(q.ids[i])
    return (0, 0) if rest[0] is None else (1, -rest[0])


def _cells(rows: DataFrame, dim: int, sample: int) -> Cells:
    """Borders from a bounded sample, extremes from all rows."""
    total = rows.count()
    bound = max(64, min(sample, BLOCK_BYTES // (8 * max(1, dim))))
    share = int(min(1.0, bound / max(1, total)) * 1_000_000) + 1
    train = rows.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < share).select("y").limit(bound).toArrow()

    def work(batches):
        low = high = None
        for batch in batches:
            if batch.num_rows:
                y = long_matrix(batch.column(0), dim)
                low = y.min(0) if low is None else np.minimum(low, y.min(0))
                high = y.max(0) if high is None else np.maximum(high, y.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    ends = rows.select("y").mapInArrow(work, "d long, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = sorted(tuple(r) for r in ends.collect())  # one row a dimension
    return Cells(long_matrix(train["y"].combine_chunks(), dim), np.array([r[1] for r in found]), np.array([r[2] for r in found]))


def _files(src: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: node, y, weight and the smallest ``k + 1`` ids (null last)."""
    by_id = Window.partitionBy("y").orderBy(F.col("vec_id").asc_nulls_last())
    ids = (src.select("y", "vec_id").withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
           .groupBy("y").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "vec_id"))), lambda x: x["vec_id"]).alias("ids")))
    weight = F.when(F.size("ids") == 1, 1).otherwise(2)  # one row or more
    return ids.select("y", "ids", weight.alias("weight"), F.size("y").alias("dim"))


def top_k(vectors: DataFrame, is_query: Column, *, vec: str = "vec_id", embedding: str = "embedding", k: int = 5, scale: int = SCALE,
          sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best rows of every query row: query_id, rank, vec_id and score.

    ``is_query`` is a condition on the id column, named ``vec_id``.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, ROWS)
    y = F.when(F.size(embedding) == 0, F.array().cast("array<long>")).otherwise(integers(F.col(embedding), scale))
    src = vectors.select(F.col(vec).cast("long").alias("vec_id"), y.alias("y")).where("y is not null")
    nodes = materialize(_files(src, k).withColumn("node", F.monotonically_increasing_id()), "va_nodes")
    asked = src.where(F.col("vec_id").isNotNull() & is_query).groupBy("vec_id", "y").agg(F.count(F.lit(1)).alias("times"))
    asked = materialize(asked.join(nodes.select("y", "node", "weight", "dim"), "y").withColumn("number", F.monotonically_increasing_id()), "va_queries")
    found = None
    for dim in sorted(r[0] for r in asked.select("dim").distinct().collect()):  # lengths of vectors: a handful
        part = _of_length(nodes.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), dim, k, sample, block_bytes)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # entries become rows: the ids of an entry without the query's own
    rows = (found.join(asked.select("number", F.col("vec_id").alias("query_id"), F.col("node").alias("own"), "times"), "number")
            .join(nodes.select("node", "ids"), "node")
            .select("number", "query_id", "times", "score", "own", "node", F.posexplode("ids").alias("at", "vec_id"),
                    F.array_position("ids", F.col("query_id")).alias("mine"))
            .where((F.col("node") != F.col("own")) | (F.col("mine") == 0) | (F.col("at") + 1 != F.col("mine"))))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    best = rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return best.select("query_id", "rank", "vec_id", "score", copies.alias("_copy")).drop("_copy")


def _of_length(nodes: DataFrame, asked: DataFrame, dim: int, k: int, sample: int, block_bytes: int) -> DataFrame:
    """(number, score, node): at most ``k`` entries per query and task, the best among them."""
    spark = nodes.sparkSession
    cells = spark.sparkContext.broadcast(_cells(nodes, dim, sample))

    def encode(batches):
        for batch in batches:
            codes = cells.value.encode(long_matrix(batch.column(2), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())],
                                             names=[*batch.schema.names, "codes"])

    files = materialize(nodes.select("node", "ids", "y").mapInArrow(encode, "node long, ids array<long>, y array<long>, codes binary"), "va_files")
    total = asked.count()
    blocks = -(-total * 8 * max(1, dim) // block_bytes)
    kept = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = mine.select("number", "node", "weight", "y", "vec_id").toArrow()  # about block_bytes
        if not rows.num_rows:
            continue
        block = Queries(rows, dim)
        shared = spark.sparkContext.broadcast(block)
        low = _lower_bounds(files.select("node", "codes"), cells, shared, dim, k)
        nth = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("bound")))
        certain = {r["number"]: r["bound"] for r in low.withColumn("_n", nth).where(F.col("_n") == k).collect()}  # one row a query of the block
        block.threshold = np.array([certain.get(int(n), -np.inf) for n in block.number])
        shared = spark.sparkContext.broadcast(block)
        part = materialize(_visited(files, cells, shared, dim, k), "va_found")
        kept = part if kept is None else kept.unionByName(part)
    return kept

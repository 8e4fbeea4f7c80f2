"""Embedding whitening by the exact characteristic polynomial of the scatter.

Components are quantised to integers, ``floor(scale * c) + offset``.  The fit
list holds each distinct integer vector once; its scatter ``n * sum(x x') - S S'``
is an exact integer matrix, added up by Spark in pieces of 32 bits.  Its
eigenvalues are the roots of its characteristic polynomial, its components null
vectors (``charpoly``).  The offset cancels in every difference, so it never
meets floating point.

What reaches the driver is one d x d matrix per vector length, whatever the
number of rows.

Edge cases: vectors that are null or hold null or non-finite entries are
dropped, as are empty ones (they have no component).  Integers saturate at
2**62.  Vectors of each length are a fit of their own.  Eigenvalues that are
zero have no component, so a constant fit list, and that of one vector, gives
no row; neither does an empty table.  Repeated rows count once in the fit and
are all returned; rows without an id keep their null.  ``deviation`` is null
where it does not fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerfold.llm.charpoly import top_components
from ledgerfold.llm.graph import arrow_batches
from ledgerfold.session import materialize

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
LIMIT = 1 << 62
LIMB, MASK = 16, (1 << 16) - 1
LONG = 1 << 63


@dataclass
class Whitening:
    """Fit of the vectors of one length.

    ``sums`` are those of the integers without their offset.
    """

    n: int
    offset: int
    scale: int
    sums: list[int]
    values: list[float]
    shares: list[float]
    components: np.ndarray
    identity_error: float = math.nan

    @property
    def dim(self) -> int:
        return len(self.sums)

    def mean(self) -> list[float]:
        """Mean of the quantised vectors."""
        return [self.offset + s / self.n for s in self.sums]

    def centred(self, y: np.ndarray) -> np.ndarray:
        """``n * x - S`` exactly: long, or Python integers where a long may not do."""
        top = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums))
        if top < LONG:
            return self.n * y - np.array(self.sums, dtype=np.int64)
        return self.n * y.astype(object) - np.array(self.sums, dtype=object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections of ``x - S/n``, each over the root of its variance."""
        deviation = np.array([math.sqrt(v) / self.n for v in self.values])
        return (centred.astype(np.float64) / self.n) @ (self.components.T / deviation)


def integers(embedding: Column, scale: int) -> Column:
    """``floor(scale * c)`` of every entry, as long; null unless all entries are finite."""
    c = F.transform(embedding.cast("array<double>"), lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LIMIT)), F.lit(-LIMIT)))
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(embedding) > 0)
    return F.when(finite, c)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def products(y: np.ndarray) -> np.ndarray:
    """``y' y`` as Python integers: exact products of 16-bit pieces."""
    if np.abs(y).max(initial=0) < 1 << 20 and len(y) <= 4096:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    pieces, rest, sign = [], np.abs(y), np.sign(y)
    while rest.any():
        pieces.append((sign * (rest & MASK)).astype(np.float64))
        rest = rest >> LIMB
    out = np.zeros((y.shape[1],) * 2, dtype=object)
    for lo in range(0, len(y), 1 << 20):
        part = [p[lo:lo + (1 << 20)] for p in pieces]
        for i, p in enumerate(part):
            for j, q in enumerate(part):
                out += (p.T @ q).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def limbs(i: int, j: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, k, v) with ``value = sum(v << 32 * k)``."""
    sign, rest, k = (1 if value >= 0 else -1), abs(value), 0
    while rest:
        yield i, j, k, sign * (rest & 0xFFFFFFFF)
        rest, k = rest >> 32, k + 1


def moments(rows: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Exact count, sums and sums of products of integer vectors of one length.

    Every task returns the pieces of its own totals; Spark adds them up by cell.
    """
    def work(batches):
        n, total, square = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in batches:
            y = matrix(batch.column(0), dim)
            n += len(y)
            total += (y >> 32).sum(0).astype(object) * (1 << 32) + (y & 0xFFFFFFFF).sum(0).astype(object)
            square += products(y)
        cells = [*limbs(-1, -1, n), *(c for i in range(dim) for c in limbs(-1, i, int(total[i]))),
                 *(c for i in range(dim) for j in range(i, dim) for c in limbs(i, j, int(square[i, j])))]
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cells)], names=["i", "j", "k", "v"])

    cells = rows.mapInArrow(work, "i long, j long, k long, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    n, total, square = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    for i, j, k, v in cells.collect():  # d * (d + 3) / 2 cells of a few pieces
        if j == -1:
            n += v << 32 * k
        elif i == -1:
            total[j] += v << 32 * k
        else:
            square[i][j] += v << 32 * k
            square[j][i] = square[i][j]
    return n, total, square


def covariance_error(fit_rows: DataFrame, model: Whitening) -> float:
    """Largest entry, by size, of the whitened fit list's covariance minus the identity."""
    k = len(model.values)

    def work(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(model.centred(matrix(batch.column(0), model.dim)))
            total += w.sum(0)
            square += w.T @ w
        cells = [(-1, i, total[i]) for i in range(k)] + [(i, j, square[i, j]) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.int64()),
             pa.array([float(c[2]) for c in cells], pa.float64())], names=["i", "j", "v"])

    total, square = np.zeros(k), np.zeros((k, k))
    for i, j, v in fit_rows.mapInArrow(work, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if i == -1:
            total[j] = v / model.n
        else:
            square[i, j] = v / model.n
    # rows are centred at S/n already; what is left of the mean is rounding
    return float(np.abs(square - np.outer(total, total) - np.eye(k)).max())


def fit(vectors: DataFrame, *, embedding: str = "embedding", scale: int = SCALE, offset: int = OFFSET,
        components: int = COMPONENTS) -> dict[int, Whitening]:
    """Whitening of the distinct quantised vectors, by vector length."""
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    y = vectors.select(integers(F.col(embedding), scale).alias("y")).where("y is not null")
    distinct = materialize(y.distinct().withColumn("dim", F.size("y")), "fit_list")
    out = {}
    for dim in sorted(r[0] for r in distinct.select("dim").distinct().collect()):  # lengths of vectors: a handful
        rows = distinct.where(F.col("dim") == dim).select("y")
        n, total, square = moments(rows, dim)
        scatter = [[n * square[i][j] - total[i] * total[j] for j in range(dim)] for i in range(dim)]
        values, shares, found = top_components(spark, scatter, components)
        model = out[dim] = Whitening(n, offset, scale, total, values, shares, found)
        if values:
            model.identity_error = covariance_error(rows, model)
    return out


def transform(vectors: DataFrame, models: dict[int, Whitening], *, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors of a length that has no fit have no row.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    shared = spark.sparkContext.broadcast({d: m for d, m in models.items() if m.values})  # d x components each
    scale = next((m.scale for m in models.values()), SCALE)
    rows = vectors.select(F.col(vec).cast("long").alias("vec_id"), integers(F.col(embedding), scale).alias("y")).where("y is not null")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def work(batches):
        for batch in batches:
            y, ids = batch.column(1), batch.column(0)
            lengths = np.asarray(y.value_lengths())
            for dim in np.unique(lengths):
                model = shared.value.get(int(dim))
                if model is None:
                    continue
                at = np.flatnonzero(lengths == dim)
                c = model.centred(matrix(y.take(pa.array(at)), model.dim))
                if c.dtype != object and int(np.abs(c).max(initial=0)) ** 2 * model.dim < LONG:
                    deviation = pa.array((c * c).sum(1))
                else:
                    squares = (c.astype(object) ** 2).sum(1)
                    deviation = pa.array([v if v < LONG else None for v in map(int, squares)], pa.int64())
                w, k = model.whitened(c), len(model.values)
                row = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(row), model.n, dtype=np.int64)), deviation.take(row), pa.array(w.ravel()),
                     pa.array(np.tile(np.array(model.shares), len(at))), pa.array(np.full(len(row), model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(work, schema)

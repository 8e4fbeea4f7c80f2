"""Embedding near-duplicates by product quantisation.

Coarse centroids and residual subspace codebooks are fitted on a bounded sample
(``SAMPLE`` vectors); every vector is indexed.  A vector lies in the inverted
list of its label and nearest centroid.  As a query it visits every list whose
bisector with its own list is nearer than ``MARGIN`` standard deviations of a
linked difference.  In a list, distances come from lookup tables of the query
against the codebooks; a candidate survives if its table distance is within the
link radius plus its own quantisation error (so the tables never lose a link),
and the exact cosine in double precision decides.

Equal vectors of a label are one node with a weight.  Lists are dealt into
blocks of bounded size on both sides.  A block reports link counts and the
local groups of its links, never the pairs.

Vectors that are null, zero or hold null or non-finite components, and rows with
a null label, link with nothing.  Vectors of different lengths never link.  A
row without id can only be a copy.  Rows that share an id count as copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerfold.llm.graph import arrow_batches, components, local_groups
from ledgerfold.session import materialize

SAMPLE, SUBSPACES, CODES, MARGIN = 16_384, 8, 256, 3.0
LIST_BLOCK, QUERY_BLOCK = 2_048, 4_096


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


class Index:
    """Coarse centroids and residual codebooks of one vector length."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, subspaces: int = SUBSPACES):
        self.centroids = kmeans(sample, lists).astype(np.float32)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.cuts = [s for s in np.array_split(np.arange(sample.shape[1]), subspaces) if len(s)]
        self.books = [kmeans(rest[:, s], CODES, 8).astype(np.float32) for s in self.cuts]
        self.radius = float(np.sqrt(2 - 2 * cosine))
        gap = ((self.centroids[:, None] - self.centroids[None]) ** 2).sum(-1)
        self.gaps = np.sqrt(np.maximum(gap, 0))

    def encode(self, x: np.ndarray, margin: float = MARGIN):
        """Own list, codes, quantisation error and the lists to visit of unit vectors."""
        own, codes = np.empty(len(x), dtype=np.int64), np.empty((len(x), len(self.cuts)), dtype=np.uint8)
        error, visit = np.empty(len(x)), []
        reach = 2 * margin * self.radius / np.sqrt(x.shape[1])
        for lo in range(0, len(x), 1024):
            part = x[lo:lo + 1024]
            d = 1 + (self.centroids ** 2).sum(1) - 2 * part @ self.centroids.T
            c = d.argmin(1)
            own[lo:lo + 1024] = c
            near = d - d[np.arange(len(part)), c][:, None] <= reach * self.gaps[c]
            near[np.arange(len(part)), c] = True
            visit += [np.flatnonzero(n) for n in near]
            rest = part - self.centroids[c]
            back = self.centroids[c].copy()
            for s, (cut, book) in enumerate(zip(self.cuts, self.books)):
                k = nearest(rest[:, cut], book)
                codes[lo:lo + 1024, s] = k
                back[:, cut] += book[k]
            error[lo:lo + 1024] = np.sqrt(((part - back) ** 2).sum(1))
        return own, codes, error, visit

    def table_distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of one list."""
        rest = queries - self.centroids[which]
        total = np.zeros((len(queries), len(codes)), dtype=np.float32)
        for s, (cut, book) in enumerate(zip(self.cuts, self.books)):
            q = rest[:, cut]
            table = (q * q).sum(1)[:, None] + (book * book).sum(1) - 2 * q @ book.T
            total += table[:, codes[:, s]]
        return np.sqrt(np.maximum(total, 0))


def exact_cosine(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for lo in range(0, len(i), 50_000):
        p, q = x[i[lo:lo + 50_000]].astype(np.float64), y[j[lo:lo + 50_000]].astype(np.float64)
        out[lo:lo + 50_000] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
    return out


def matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, dim)


def block_links(index: Index, dim: int, cosine: float, data: pa.Table, queries: pa.Table):
    """Counts and local groups of the links between one block of a list and one block of queries."""
    x, q = matrix(data["embedding"], dim), matrix(queries["embedding"], dim)
    nx, nq = data["node"].to_numpy(), queries["node"].to_numpy()
    weight, error = data["weight"].to_numpy(), data["error"].to_numpy()
    codes = np.frombuffer(b"".join(data["codes"].to_pylist()), dtype=np.uint8).reshape(len(nx), -1)
    which = int(data["list"][0].as_py())
    found_i, found_j = [], []
    step = max(1, 4_000_000 // max(1, len(x)))
    for lo in range(0, len(q), step):
        part = q[lo:lo + step].astype(np.float64)
        unit = (part / np.sqrt((part * part).sum(1))[:, None]).astype(np.float32)
        near = index.table_distances(unit, which, codes) <= index.radius + error + 1e-3
        i, j = np.nonzero(near)
        live = nq[lo + i] != nx[j]
        i, j = i[live] + lo, j[live]
        good = exact_cosine(q, x, i, j) >= cosine
        found_i.append(i[good])
        found_j.append(j[good])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    left, right = local_groups(i, j, nq, nx)
    count = np.bincount(i, weights=weight[j], minlength=len(nq)).astype(np.int64)
    hit_q, hit_x = np.unique(i), np.unique(j)
    return pa.table({"a": np.concatenate([nq[hit_q], nx[hit_x]]), "b": np.concatenate([left[hit_q], right[hit_x]]),
                     "n": np.concatenate([count[hit_q], np.zeros(len(hit_x), dtype=np.int64)])})


def _blocks(df: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """Number of blocks of at most about ``size`` rows per group."""
    return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def links_of_length(nodes: DataFrame, dim: int, cosine: float, sample: int) -> DataFrame:
    """(a, b, n) rows of :func:`block_links` for the nodes of one vector length."""
    spark = nodes.sparkSession
    total = nodes.count()
    bound = max(64, min(sample, (32 << 20) // (4 * dim)))
    share = min(1.0, bound / max(1, total))
    rows = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("embedding").limit(bound).toArrow()
    train = matrix(rows["embedding"], dim).astype(np.float64)
    train /= np.sqrt((train * train).sum(1))[:, None]
    lists = int(np.clip(np.sqrt(total / 4), 1, min(4096, max(1, len(train) // 8))))
    shared = spark.sparkContext.broadcast(Index(train.astype(np.float32), lists, cosine))

    def encode(batches):
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2), dim).astype(np.float64)
            x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
            own, codes, error, visit = index.encode(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float32()),
                 pa.array(visit, pa.list_(pa.int64()))], names=[*batch.schema.names, "list", "codes", "error", "visit"])

    coded = materialize(nodes.select("node", "label", "embedding", "weight").mapInArrow(
        encode, "node long, label string, embedding array<float>, weight long, list long, codes binary, error float, visit array<long>"), "coded")
    data = coded.select("node", "label", "embedding", "weight", "list", "codes", "error")
    visits = coded.select("node", "label", "embedding", F.explode("visit").alias("list"))
    queries = visits.select(*[F.col(c).alias(f"q_{c}") for c in visits.columns]).toDF(*visits.columns)
    key = ["label", "list"]
    grid = _blocks(data, key, LIST_BLOCK, "nb").join(_blocks(queries, key, QUERY_BLOCK, "nq"), key)

    def dealt(df, own, other, mine, theirs):
        part = F.pmod(F.xxhash64("node", F.lit(own)), F.col(mine)).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias(other)
        return df.join(grid, key).select(*df.columns, part, copies)

    names = ["label", "list", "db", "qb"]
    d = dealt(data, "db", "qb", "nb", "nq").groupBy(*names)
    q = dealt(queries, "qb", "db", "nq", "nb").select("node", "embedding", *[F.col(c).alias(f"q_{c}") for c in names]).groupBy(*[f"q_{c}" for c in names])

    def work(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return block_links(shared.value, dim, cosine, left, right)

    return d.cogroup(q).applyInArrow(work, "a long, b long, n long")


def near_vectors(vectors: DataFrame, *, vec: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93,
                 sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    arrow_batches(vectors.sparkSession)
    e = F.col("embedding")
    src = vectors.select(F.col(vec).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                         F.col(embedding).cast("array<float>").alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    src = src.withColumn("digest", F.when(valid, F.sha2(F.concat_ws("/", "label", F.array_join(e.cast("array<string>"), ",")), 256)))
    nodes = materialize(src.where("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.first(F.size(e)).alias("dim")), "vectors")
    usable = nodes.where("node is not null")
    found = None
    for dim in sorted(r[0] for r in usable.select("dim").distinct().collect()):  # lengths of vectors: a handful
        part = links_of_length(usable.where(F.col("dim") == dim), dim, cosine, sample)
        found = part if found is None else found.union(part)
    ids = src.select("vec_id", "digest")
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "vector_links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found)
    named = (usable.select("digest", "node", "weight").join(counts.withColumnRenamed("a", "node"), "node", "left").join(comp, "node", "left")
             .select("digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    out = ids.join(named, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))

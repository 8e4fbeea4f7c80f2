"""Near-duplicate groups with SetSketch registers.

A document is the set of its distinct word shingles.  Each of ``REGISTERS``
registers keeps a truncated minimum on an exponentially spaced scale, so two
sketches merge by a maximum and agree in a register with a probability that
grows with the overlap.  Bands of registers find candidates; the joint
likelihood of two sketches and their known set sizes estimates the overlap; the
full sets decide.

Groups are never expanded into pairs.  Equal sets are one node.  In a bucket
every node is first compared with one partner that differs from band to band,
those unlike it with a second one; of those estimates only the best of each node
is verified, then those that still join different groups.  The partners only
make groups large early, they rule nothing out: members outside the largest
group of their cluster of partners, and after that members outside the largest
group of each bucket, are compared by their full sets with all of the cluster or
bucket, block by block.  So two members of one bucket always end in one group if
their sets overlap enough.

Edge cases: a text without words has an empty set, links with nothing and is
its own component; a row without id can only be an exact copy; rows that share
an id are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerfold.llm.graph import arrow_batches, components, extended, local_groups
from ledgerfold.llm.text import NONSPACE, Words, pieces, runs_hash
from ledgerfold.session import materialize

BASE, RATE = 1.1, 20.0
BANDS, ROWS = 25, 5
PIVOTS = 2
X_BLOCK, Y_BLOCK = 256, 2_048
REGISTERS = BANDS * ROWS
_RNG = np.random.Generator(np.random.PCG64(917))
_MUL = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and their offsets."""
    counts = words.counts()
    m = np.where(counts > 0, np.maximum(1, counts - size + 1), 0)
    base = np.cumsum(m) - m
    start = np.arange(int(m.sum())) - np.repeat(base, m) + np.repeat(words.first[:-1], m)
    hashes = runs_hash(words.hashes, start, start + np.repeat(np.minimum(counts, size), m)) if len(start) else np.empty(0, np.uint64)
    sets = []
    for b, k in zip(base.tolist(), m.tolist()):
        own = np.sort(hashes[b:b + k])
        if k > 1:
            own = own[np.append(True, own[1:] != own[:-1])]
        sets.append(own)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), offsets


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch of each set: one byte per register, (sets x registers).  Empty sets get zeros."""
    size = np.diff(offsets)
    out = np.zeros((len(size), REGISTERS), dtype=np.uint8)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    at = offsets[:-1][full]
    for r in range(REGISTERS):
        low = np.minimum.reduceat(values * _MUL[r] + _ADD[r], at)
        x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[full, r] = np.clip(np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, 255)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches with known set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = score(x) < score(y)
        lo, hi = np.where(left, x, lo), np.where(left, hi, y)
    return (lo + hi) / 2


def sketches(docs: DataFrame, *, doc: str, text: str, size: int) -> DataFrame:
    """(id, n_shingles, digest of the set, sketch) for every row."""
    def rows(batches):
        for batch in batches:
            for lo, hi, words in pieces(batch.column(1), NONSPACE):
                values, offsets = shingle_sets(words, size)
                digest = [hashlib.blake2b(values[s:e].tobytes(), digest_size=16).digest() for s, e in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(digest, pa.binary()),
                     pa.array([r.tobytes() for r in registers(values, offsets)], pa.binary())], names=["id", "n_shingles", "digest", "sketch"])

    return docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(
        rows, "id long, n_shingles long, digest binary, sketch binary")


def shingle_table(docs: DataFrame, nodes: DataFrame, *, doc: str, text: str, size: int) -> DataFrame:
    """(node, sorted shingle hashes as bytes) of the wanted documents."""
    def rows(batches):
        for batch in batches:
            for lo, hi, words in pieces(batch.column(1), NONSPACE):
                values, offsets = shingle_sets(words, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([values[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])], pa.binary())],
                    names=["node", "shingles"])

    wanted = docs.select(F.col(doc).cast("long").alias("node"), F.col(text).alias("t")).join(nodes, "node", "left_semi")
    return wanted.mapInArrow(rows, "node long, shingles binary")


def estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose likelihood estimate is at least ``least``, with the estimate."""
    own = reps.select("node", "n_shingles", "sketch")
    rich = (pairs.join(own.withColumnsRenamed({"node": "a", "n_shingles": "n_a", "sketch": "s_a"}), "a")
            .join(own.withColumnsRenamed({"node": "b", "n_shingles": "n_b", "sketch": "s_b"}), "b")
            .select("a", "b", "n_a", "n_b", "s_a", "s_b"))

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
            s_a, s_b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS) for k in (4, 5))
            j = joint_estimate(s_a, s_b, n_a, n_b)
            keep = np.flatnonzero(j >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(j[keep])],
                                             names=["a", "b", "estimate"])

    return rich.mapInArrow(rows, "a long, b long, estimate double")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets overlap by at least ``percent`` percent."""
    rich = (pairs.select("a", "b").join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
            .join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b").select("a", "b", "x", "y"))

    def rows(batches):
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.uint64) for c in (2, 3))
                both = np.concatenate([x, y])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= percent * (len(x) + len(y) - inter):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return rich.mapInArrow(rows, "a long, b long")


def band_members(reps: DataFrame) -> DataFrame:
    """(band, node, n_shingles): the registers of a band and its number packed into one long."""
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.conv(
        F.hex(F.substring(F.col("sketch"), k * ROWS + 1, F.lit(ROWS))), 16, 10).cast("long") + F.shiftleft(k.cast("long"), 8 * ROWS))
    return reps.select(F.explode(key).alias("band"), "node", "n_shingles")


def overlapping(x_values, x_offsets, y_values, y_offsets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with enough overlap between two lists of sets."""
    universe, code = np.unique(np.concatenate([x_values, y_values]), return_inverse=True)
    x_code, y_code = code[:len(x_values)], code[len(x_values):]
    n_y = np.diff(y_offsets)
    flag = np.zeros(len(universe), dtype=np.int32)
    out_i, out_j = [], []
    for i in range(len(x_offsets) - 1):
        own = x_code[x_offsets[i]:x_offsets[i + 1]]
        flag[own] = 1
        inter = np.add.reduceat(flag[y_code], y_offsets[:-1])
        flag[own] = 0
        j = np.flatnonzero(100 * inter >= percent * (len(own) + n_y - inter))
        out_i.append(np.full(len(j), i))
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def cross_links(clusters: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between different groups of a cluster (cluster, node).

    Members outside the cluster's largest group meet all of the cluster, in
    blocks of bounded size on both sides.  A block reports the local groups of
    its links, not the pairs.  Clusters of the same members are compared once.
    None if no cluster holds two groups.
    """
    placed = materialize(clusters.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    share = placed.groupBy("cluster", "component").agg(
        F.count(F.lit(1)).alias("c"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (3, 4)])
    mixed = share.groupBy("cluster").agg(
        F.max(F.struct("c", "component")).alias("p"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"),
        *[F.bit_xor(f"x{k}").alias(f"x{k}") for k in (3, 4)]).where("k > 1")
    mixed = mixed.groupBy("n", "x3", "x4").agg(F.min(F.struct("cluster", "p")).alias("m")).select(
        "m.cluster", F.col("m.p.component").alias("main"), F.ceil((F.col("n") - F.col("m.p.c")) / X_BLOCK).cast("int").alias("nx"),
        F.ceil(F.col("n") / Y_BLOCK).cast("int").alias("ny"))
    # written, so that what follows is joined by measured sizes
    mixed = materialize(mixed, "mixed")
    if mixed.isEmpty():
        return None
    rich = placed.join(mixed, "cluster").join(sets, "node")
    x_own, y_own = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)).cast("int") for k, n in ((1, "nx"), (2, "ny")))
    outside = rich.where(F.col("component") != F.col("main")).select(
        "cluster", x_own.alias("xb"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("yb"), "node", "component", "shingles")
    inside = rich.select(F.col("cluster").alias("q"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("p"), y_own.alias("r"),
                         F.col("node").alias("m"), F.col("component").alias("c"), F.col("shingles").alias("s"))

    def flat(column):
        parts = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in column]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(v) for v in parts])]).astype(np.int64)

    def work(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = overlapping(*flat(left["shingles"]), *flat(right["s"]), percent)
        nx, ny = left["node"].to_numpy(), right["m"].to_numpy()
        new = left["component"].to_numpy()[i] != right["c"].to_numpy()[j]
        i, j = i[new], j[new]
        top_x, top_y = local_groups(i, j, nx, ny)
        hit_x, hit_y = np.unique(i), np.unique(j)
        return pa.table({"a": np.concatenate([nx[hit_x], ny[hit_y]]), "b": np.concatenate([top_x[hit_x], top_y[hit_y]])})

    found = outside.groupBy("cluster", "xb", "yb").cogroup(inside.groupBy("q", "p", "r")).applyInArrow(work, "a long, b long")
    return found.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_groups(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id and kept."""
    arrow_batches(docs.sparkSession, 1000)
    own = materialize(sketches(docs, doc=doc, text=text, size=size), "sketches")
    classes = own.where("n_shingles > 0").groupBy("digest", "n_shingles").agg(F.min("id").alias("node"), F.first("sketch").alias("sketch"))
    reps = materialize(classes.where("node is not null").select("node", "n_shingles", "sketch", "digest"), "classes")
    least = percent / 100 - 5.5 * float(np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS))

    def close(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    members = band_members(reps)
    pick = F.min(F.struct(F.xxhash64("node", "band").alias("h"), F.col("node").alias("top"), F.col("n_shingles").alias("n_top")))
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("c"), pick.alias("p")).where("c > 1").select("band", "p.top", "p.n_top")
    in_bucket = materialize(members.join(buckets, "band"), "buckets")
    star, left = None, in_bucket
    for turn in range(PIVOTS):
        pairs = left.where(F.col("node") != F.col("top"))
        near = (pairs.where(close(F.col("n_shingles"), F.col("n_top")))
                .select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")).distinct())
        near = materialize(estimated(near, reps, least), "star")
        star = near if star is None else star.union(near)
        if turn + 1 == PIVOTS:
            break
        # members unlike the first partner meet another one of their own
        pairs = pairs.withColumn("a", F.least("node", "top")).withColumn("b", F.greatest("node", "top"))
        rest = pairs.join(near.select("a", "b"), ["a", "b"], "left_anti").select("band", "node", "n_shingles")
        tops = rest.groupBy("band").agg(F.count(F.lit(1)).alias("c"), pick.alias("p")).where("c > 1").select("band", "p.top", "p.n_top")
        left = rest.join(tops, "band")
    star = star.groupBy("a", "b").agg(F.max("estimate").alias("estimate"))
    star = materialize(star, "star")
    nodes = in_bucket.select("node").distinct()
    sets = materialize(shingle_table(docs, nodes, doc=doc, text=text, size=size).dropDuplicates(["node"]), "sets")
    # the best partner of every node first
    ends = star.select(F.col("a").alias("x"), "a", "b", "estimate").union(star.select(F.col("b").alias("x"), "a", "b", "estimate"))
    best = ends.groupBy("x").agg(F.max(F.struct("estimate", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = materialize(verified(best, sets, percent), "links")
    tried = best

    def grouped(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs with the groups of both ends; a node without links is its own group."""
        return (pairs.join(comp.withColumnsRenamed({"node": "a", "component": "c_a"}), "a", "left")
                .join(comp.withColumnsRenamed({"node": "b", "component": "c_b"}), "b", "left")
                .where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"))

    comp = materialize(components(links), "groups")
    rest = grouped(star, comp).join(tried, ["a", "b"], "left_anti")
    comp = extended(comp, verified(rest, sets, percent))
    clusters = components(star.select("a", "b"), "clusters").withColumnRenamed("component", "cluster")
    comp = extended(comp, cross_links(clusters, comp, sets, percent))
    # whatever the partners said, members of a bucket in different groups meet
    buckets = in_bucket.select(F.col("band").alias("cluster"), "node")
    comp = extended(comp, cross_links(buckets, comp, sets, percent))
    named = reps.join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = own.join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc), "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, doc: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that are not the smallest id of their group; columns unchanged."""
    gone = near_groups(docs, doc=doc, **options).where(~F.col("kept")).select(F.col(doc).alias("_gone")).distinct()
    return docs.join(gone, docs[doc].cast("long").eqNullSafe(F.col("_gone")), "left_anti")

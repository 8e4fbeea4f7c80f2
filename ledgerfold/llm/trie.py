"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path: the digests (SHA-256 of role and text) of its turns.
Paths are compared as bytes, so those that share a prefix stand together.
Splitters cut the sorted (path, conv_id) rows into shards; a prefix that occurs
in two shards is a prefix of the path of a splitter between them.  The trie of
all splitter paths, the skeleton, is therefore all that shards have in common.

* It is broadcast.  Its size is bounded: splitters are left out until their paths
  take at most ``SKELETON_BYTES``; fewer splitters are fewer shards.
* A shard streams its sorted rows past a stack and finishes every node that is
  not in the skeleton.
* For a skeleton node it returns a partial aggregate; Spark reduces those, and
  totals are carried up the skeleton, which is bounded as above.
* Ids that end at a skeleton node travel as joined strings of bounded size, in
  order, and are hashed as a stream.

``conv_id`` breaks ties between equal paths, so a group of copies, however
large, is cut like any other range.

Edge cases: a null role or text is empty; a null turn comes first; turns with
equal numbers are ordered by the digest of their content, and a repeated row is a
turn of its own.  Rows without ``conv_id`` belong to no conversation.  An empty
table has no node.  ``c % 5`` has the sign of ``c``, as in SQL.  A conversation's
path, 32 bytes a turn, has to fit a row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerfold.llm.graph import arrow_batches
from ledgerfold.session import materialize

WIDTH = 32
SKELETON_BYTES = 16 << 20
SAMPLE, CHUNK = 20, 1 << 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SHARD = f"kind int, node long, ids binary, {NODE}"
FINISHED, BELOW, PARTIAL, ENDS = range(4)


def turns(conversations: DataFrame, base: Column, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(base, conv_id, turns): every conversation's turns in order, as (turn, digest, n_bytes).

    Rows are dealt by ``base``, an expression over ``conv_id``, which puts a
    conversation and its base in one place.  A content is digested as the length
    of the role, role and text, so no two contents run together.
    """
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(by).cast("string"), by, said), 256))
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.struct(
        F.col(turn).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("n_bytes")).alias("t"))
    rows = rows.where("conv_id is not null").withColumn("base", base).repartition("base")
    return rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, taken: Column) -> DataFrame:
    """(conv_id, path, n_bytes): the first ``taken`` turns of the base, then the own turns after as many."""
    own = convs.withColumn("taken", taken.cast("int"))
    heads = own.where("conv_id = base").select("base", F.col("turns").alias("head"))
    none = F.array().cast("array<struct<turn:bigint,digest:binary,n_bytes:bigint>>")
    joined = own.join(heads, "base", "left").withColumn("head", F.coalesce("head", none))
    whole = F.concat(F.slice("head", 1, F.col("taken")), F.slice("turns", F.col("taken") + 1, F.size("turns")))
    return joined.select("conv_id", whole.alias("t")).select(
        "conv_id", F.expr("aggregate(t, X'', (a, x) -> concat(a, x.digest))").alias("path"), F.transform("t", lambda x: x["n_bytes"]).alias("n_bytes"))


class Skeleton:
    """All prefixes of the splitters' paths, and the splitters in order."""

    def __init__(self, splitters: list[tuple[bytes, int, list[int]]]):
        self.cuts = [(path, conv) for path, conv, _ in splitters]
        self.number, self.parent, self.depth, self.size = {b"": 0}, [-1], [0], [0]
        for path, _, sizes in splitters:
            above = 0
            for d in range(1, len(path) // WIDTH + 1):
                key = path[:d * WIDTH]
                if key not in self.number:
                    self.number[key] = len(self.parent)
                    self.parent.append(above)
                    self.depth.append(d)
                    self.size.append(sizes[d - 1])
                above = self.number[key]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.cuts, (path, conv))


def skeleton(paths: DataFrame, shards: int, limit: int = SKELETON_BYTES) -> Skeleton:
    """Splitters of about equal shards from a bounded sample (``SAMPLE`` rows a shard, in hash order)."""
    rows = min(50_000, max(2_000, SAMPLE * shards))
    near = paths.orderBy(F.xxhash64("conv_id"), "conv_id").limit(rows).select(F.octet_length("path").alias("n"), "conv_id").collect()
    total, fits = 0, []
    for r in near:
        if total + r["n"] <= limit:
            fits.append(r["conv_id"])
            total += r["n"]
    if shards < 2 or not fits:
        return Skeleton([])
    rows = [(bytes(r["path"]), r["conv_id"], list(r["n_bytes"])) for r in paths.where(F.col("conv_id").isin(fits)).collect()]
    rows.sort(key=lambda r: r[:2])
    cut = sorted({len(rows) * i // shards for i in range(1, shards)})
    return Skeleton([rows[i] for i in cut])


class _Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "at", "depth", "size", "waiting")

    def __init__(self, depth: int, size: int, at: int | None):
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.depth, self.size, self.at = depth, size, at  # at: number in the skeleton
        self.ends = None
        self.waiting: list[tuple] = []  # finished children, until the smallest member here is known


class _Ends:
    """Digest of ascending ids; for skeleton nodes, their text in pieces."""

    def __init__(self, out: list | None):
        self.hash, self.out, self.text = hashlib.sha256(), out, []
        self.length, self.any = 0, False

    def add(self, conv: int, node: int | None) -> None:
        t = b"%d" % conv
        if node is None:
            self.hash.update(b"," + t if self.any else t)
            self.any = True
            return
        self.text.append(t)
        self.length += len(t) + 1
        if self.length >= CHUNK:
            self.flush(node)

    def flush(self, node: int) -> None:
        if self.text:
            self.out.append((ENDS, node, b",".join(self.text), *[None] * 8))
            self.text, self.length = [], 0


NO_ENDS = hashlib.sha256(b"").hexdigest()


def _finish(rows: Iterator[tuple[int, bytes, list[int]]], bone: Skeleton, out: list) -> Iterator[None]:
    """Stack pass over the sorted rows of one shard; yields now and then so that ``out`` can be emptied."""
    stack: list[_Node] = []
    before = None

    def pop() -> None:
        node = stack.pop()
        up = stack[-1] if stack else None
        if node.at is not None:
            if node.ends:
                node.ends.flush(node.at)
            out.append((PARTIAL, node.at, None, node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved, None))
            # children of the skeleton are counted in the skeleton
        else:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.size
            ends = node.ends.hash.hexdigest() if node.ends else NO_ENDS
            mine = (node.conv, node.depth, node.n, node.children, node.leaves, node.saved, ends)
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            if up.at is None:
                up.waiting.append(mine)
            else:
                out.append((BELOW, up.at, None, mine[0], mine[1], None, *mine[2:]))
            out.extend((FINISHED, None, None, c[0], c[1], node.conv, *c[2:]) for c in node.waiting)
        if up is not None:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)

    for conv, path, sizes in rows:
        depth, same = len(path) // WIDTH, 0
        if before is not None:
            top = min(depth, len(before) // WIDTH)
            while same < top and path[same * WIDTH:(same + 1) * WIDTH] == before[same * WIDTH:(same + 1) * WIDTH]:
                same += 1
        while len(stack) > same + 1:
            pop()
        if not stack:
            stack.append(_Node(0, 0, 0))
        for d in range(len(stack), depth + 1):
            stack.append(_Node(d, sizes[d - 1], bone.number.get(path[:d * WIDTH])))
        end = stack[-1]
        end.ends = end.ends or _Ends(out)
        end.ends.add(conv, end.at)
        end.n += 1
        end.conv = conv if end.conv is None else min(end.conv, conv)
        before = path
        if len(out) >= 10_000:
            yield
    while stack:
        pop()
    yield


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[int]]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns[1:]))


def nodes(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, path, n_bytes); one row per node."""
    spark = paths.sparkSession
    arrow_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = materialize(paths, "paths")
    bone = skeleton(paths, shards)
    shared = spark.sparkContext.broadcast(bone)  # at most SKELETON_BYTES of paths

    def deal(batches):
        for batch in batches:
            at = [shared.value.shard(p, c) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    def finish(batches):
        out: list[tuple] = []
        for _ in _finish(_shard_rows(batches), shared.value, out):
            for lo in range(0, len(out), 10_000):
                yield _batch(out[lo:lo + 10_000])
            out.clear()

    dealt = paths.select("conv_id", "path", "n_bytes").mapInArrow(deal, "shard int, conv_id long, path binary, n_bytes array<long>")
    dealt = dealt.repartitionById(len(bone.cuts) + 1, "shard").sortWithinPartitions("path", "conv_id")
    local = materialize(dealt.mapInArrow(finish, SHARD), "trie")

    columns = [c.split()[0] for c in NODE.split(", ")]
    top = _skeleton_rows(local, bone)
    below = (local.where(F.col("kind") == BELOW).drop("parent_conv_id")
             .join(top.select("node", F.col("conv_id").alias("parent_conv_id")), "node"))
    return (local.where(F.col("kind") == FINISHED).select(*columns)
            .unionByName(below.select(*columns)).unionByName(top.select(*columns)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SHARD.split(", ")])


def _skeleton_rows(local: DataFrame, bone: Skeleton) -> DataFrame:
    """The skeleton's nodes: partial aggregates reduced, then carried up the splitter paths."""
    spark = local.sparkSession
    parts = local.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])

    def digests(batches):
        node, total = None, None
        for batch in batches:
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != node:
                    if node is not None:
                        yield _digest(node, total)
                    node, total = at, hashlib.sha256(ids)
                else:
                    total.update(b",")
                    total.update(ids)
        if node is not None:
            yield _digest(node, total)

    ended = local.where(F.col("kind") == ENDS)
    # the ids of a node ascend from piece to piece and from shard to shard
    first = F.split_part(F.col("ids").cast("string"), F.lit(","), F.lit(1)).cast("long").alias("first")
    ends = ended.select("node", first, "ids").repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(
        digests, "node long, ends_sha256 string")
    found = {r["node"]: r for r in parts.collect()}  # the skeleton, bounded by SKELETON_BYTES
    children, leaves, saved, rows = {}, {}, {}, []
    for k in sorted(found, key=lambda k: -bone.depth[k]):
        r, up = found[k], bone.parent[k]
        n_children = r["n_children"] + children.get(k, 0)
        n_leaves = r["n_leaves"] + leaves.get(k, 0) or 1
        total = r["saved_tokens"] + saved.get(k, 0) + (r["n_convs"] - 1) * bone.size[k]
        for table, v in ((children, 1), (leaves, n_leaves), (saved, total)):
            table[up] = table.get(up, 0) + v
        rows.append((k, r["conv_id"], bone.depth[k], found[up]["conv_id"] if up >= 0 else None, r["n_convs"], n_children, n_leaves, total))
    schema = "node long, " + NODE.rpartition(", ")[0]
    top = spark.createDataFrame(rows, schema)
    return top.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def _digest(node: int, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([total.hexdigest()])], names=["node", "ends_sha256"])


def conversation_trie(conversations: DataFrame, base: Column, taken: Column, **columns: str) -> DataFrame:
    """Trie of the rebuilt conversations; see :func:`rebuilt` and :func:`nodes`."""
    return nodes(rebuilt(turns(conversations, base, **columns), taken))

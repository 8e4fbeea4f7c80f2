"""Benchmark decontamination by suffix arrays over the training text.

Every Arrow batch of training documents is a shard.  Its words become ranks in
the benchmark's vocabulary (0 for any other word), the suffixes that can match
are sorted into a suffix array, and every benchmark suffix is located in it by
binary search.  The range of equal suffixes gives all places of a window; the
neighbours of the insertion point give the longest verbatim match.

The benchmark is the stated query set.  It is held in blocks of at most
``block_bytes`` of text; every block is searched in all documents, so a large
benchmark means more passes, not larger broadcasts.

Edge cases: null and empty texts have no words; an item without words has no
window; rows that share an item id are one item; a null item id is the item
``''``; repeated document rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerfold.llm.graph import arrow_batches, fresh
from ledgerfold.llm.text import ALNUM, Words, buffers, pieces

WINDOW = 13
BLOCK_BYTES = 16 << 20


class Queries:
    """One block of benchmark items: words as ranks, suffixes and windows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        column = pa.array([t or "" for _, t in items], type=pa.large_string())
        raw, offsets = buffers(column)
        words = Words(raw, offsets, ALNUM)
        self.vocabulary, ranks = np.unique(words.hashes, return_inverse=True)
        self.items = [i for i, _ in items]
        self.first = words.first
        # ranks of all items, each item closed by a 0
        counts = words.counts()
        self.tokens = closed(ranks.astype(np.int64) + 1, words.first)
        self.begin = words.first[:-1] + np.arange(len(counts))
        starts, lengths, owner = [], [], []
        for k, n in enumerate(counts):
            if n:
                m = max(1, n - window + 1)
                starts.append(self.begin[k] + np.arange(m))
                lengths.append(np.full(m, min(n, window)))
                owner.append(np.full(m, k))
        none = [np.empty(0, dtype=np.int64)]
        starts, lengths, owner = (np.concatenate(x or none) for x in (starts, lengths, owner))
        # equal windows are searched once
        grid = np.zeros((len(starts), window), dtype=np.int64)
        for d in range(window):
            live = lengths > d
            grid[live, d] = self.tokens[starts[live] + d]
        _, at, same = np.unique(grid, axis=0, return_index=True, return_inverse=True) if len(starts) else (0, starts, starts)
        self.starts, self.lengths = starts[at], lengths[at]
        same = same.reshape(-1)
        order = np.argsort(same, kind="stable")
        self.owner = owner[order]
        self.owner_from = np.searchsorted(same[order], np.arange(len(at) + 1))
        self.longest = int(counts.max()) if len(counts) else 0

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def closed(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tokens of all texts with a 0 after each text, so that no suffix runs on."""
    out = np.zeros(len(tokens) + len(first) - 1, dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(tokens)) + doc] = tokens
    return out


def runs(tokens: np.ndarray) -> np.ndarray:
    """How many words from each place on lie in the vocabulary."""
    stop = np.flatnonzero(tokens == 0)
    return np.append(stop, len(tokens))[np.searchsorted(stop, np.arange(len(tokens)))] - np.arange(len(tokens))


def suffix_array(tokens: np.ndarray, places: np.ndarray, depth: int, step: int = 4) -> np.ndarray:
    """``places`` ordered by the words that follow them, ``depth`` words deep.

    Sorts by ``step`` words at a time and goes on only inside groups that are
    still equal and have not met the end of a run.
    """
    padded = np.concatenate([tokens, np.zeros(step + depth, dtype=np.int64)])
    order, group = places.copy(), np.zeros(len(places), dtype=np.int64)
    active = np.arange(len(places))
    at = 0
    while len(active) > 1 and at < depth:
        here = order[active]
        keys = [padded[np.minimum(here + at + d, len(padded) - 1)] for d in range(step)]
        for d in range(1, step):
            keys[d] = np.where(keys[d - 1] == 0, 0, keys[d])
        by = np.lexsort([*keys[::-1], group[active]])
        here, keys = here[by], [k[by] for k in keys]
        g = group[active][by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        order[active] = here
        head = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        group[active] = active[head]
        single = new & np.append(new[1:], True)
        active = active[~single & (keys[-1] != 0)]
        at += step
    return order


def bounds(tokens: np.ndarray, order: np.ndarray, query: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """First and last place in the suffix array whose suffix begins with each query."""
    out = []
    longest = int(lengths.max()) if len(lengths) else 0
    padded = np.concatenate([tokens, np.zeros(longest + 1, dtype=np.int64)])
    for upper in (False, True):
        lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(order), dtype=np.int64)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            place, start, size = order[mid], starts[live], lengths[live]
            sign = np.zeros(len(live), dtype=np.int64)
            open_ = np.arange(len(live))
            for d in range(longest):
                open_ = open_[(sign[open_] == 0) & (size[open_] > d)]
                if not len(open_):
                    break
                sign[open_] = np.sign(padded[place[open_] + d] - query[start[open_] + d])
            right = (sign <= 0) if upper else (sign < 0)
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
            live = live[lo[live] < hi[live]]
        out.append(lo)
    return out


def common(tokens, places, query, starts, limit) -> np.ndarray:
    """Length of the common beginning of each place and query, up to ``limit``."""
    size, live, d = np.zeros(len(places), dtype=np.int64), np.arange(len(places)), 0
    while len(live):
        live = live[limit[live] > d]
        a = np.where(places[live] + d < len(tokens), tokens[np.minimum(places[live] + d, len(tokens) - 1)], 0)
        live = live[(a != 0) & (a == query[starts[live] + d])]
        size[live] += 1
        d += 1
    return size


def shard_tokens(column, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of a batch's words (texts closed by 0) and where each text begins."""
    parts, sizes = [], []
    for _, _, words in pieces(column, ALNUM):
        ranks = queries.ranks(words.hashes) if len(words.starts) else np.empty(0, dtype=np.int64)
        parts.append(closed(ranks, words.first))
        sizes.append(words.counts())
    counts = np.concatenate(sizes) if sizes else np.empty(0, dtype=np.int64)
    tokens = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return tokens, np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)


def window_places(tokens: np.ndarray, queries: Queries) -> np.ndarray:
    """Places where one of the windows could begin: enough known words follow."""
    reach = runs(tokens)
    can = np.zeros(len(tokens), dtype=bool)
    for size in np.unique(queries.lengths):
        heads = np.unique(queries.tokens[queries.starts[queries.lengths == size]])
        hit = np.flatnonzero(reach >= size)
        can[hit[np.isin(tokens[hit], heads)]] = True
    return np.flatnonzero(can)


def locate(tokens: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """All (window, place) pairs of one shard."""
    order = suffix_array(tokens, window_places(tokens, queries), int(queries.lengths.max()) if len(queries.lengths) else 0)
    lo, hi = bounds(tokens, order, queries.tokens, queries.starts, queries.lengths)
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    return window, order[np.repeat(lo, n) + inside]


def shard_hits(column, queries: Queries) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Per text: number of words, hit spans [from, to, ...] and items found."""
    tokens, begin = shard_tokens(column, queries)
    n = len(begin) - 1
    counts = np.diff(begin) - 1
    spans: list = [np.empty(0, dtype=np.int64)] * n
    items: list = [[]] * n
    window, place = locate(tokens, queries) if len(queries.starts) and len(tokens) else (np.empty(0, int),) * 2
    if len(place):
        cover = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + queries.lengths[window], -1)
        hit = np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)
        edge = np.diff(hit)
        up, down = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(begin, up, side="right") - 1
        for d in np.unique(doc):
            k = doc == d
            spans[d] = np.stack([up[k], down[k]], axis=1).reshape(-1) - begin[d]
        pairs = np.unique(np.stack([np.searchsorted(begin, place, side="right") - 1, window], axis=1), axis=0)
        for d in np.unique(pairs[:, 0]):
            own = pairs[pairs[:, 0] == d, 1]
            found = {queries.items[k] for w in own for k in queries.owner[queries.owner_from[w]:queries.owner_from[w + 1]]}
            items[d] = sorted(found)
    return counts, spans, items


def merge_spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two span lists."""
    if not len(a) or not len(b):
        return a if len(a) else b
    both = np.concatenate([a, b]).reshape(-1, 2)
    both = both[np.argsort(both[:, 0], kind="stable")]
    top = np.maximum.accumulate(both[:, 1])
    new = np.append(True, both[1:, 0] > top[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(both) - 1)
    return np.stack([both[new, 0], top[last]], axis=1).reshape(-1)


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of about ``block_bytes`` of text, one at a time."""
    src = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(text, F.lit("")).alias("t"))
    total = src.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = src if n == 1 else src.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """Add n_words, hit spans and items to every document row; returns the frame and the three new names."""
    spark = docs.sparkSession
    arrow_batches(spark)
    names = [fresh(docs, n) for n in ("n_words", "spans", "items")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()),
                           T.StructField(names[1], T.ArrayType(T.LongType())), T.StructField(names[2], T.ArrayType(T.StringType()))])
    at, n_cols = docs.columns.index(text), len(docs.columns)
    out = docs
    for block in blocks(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(Queries(block, window))

        def search(batches, shared=shared):
            queries = shared.value
            for batch in batches:
                counts, spans, items = shard_hits(batch.column(at), queries)
                if batch.num_columns > n_cols:
                    old_s, old_i = batch.column(n_cols + 1).to_pylist(), batch.column(n_cols + 2).to_pylist()
                    spans = [merge_spans(np.array(o, dtype=np.int64), s) for o, s in zip(old_s, spans)]
                    items = [sorted({*o, *i}) for o, i in zip(old_i, items)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_cols], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                     pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names[:n_cols], *names])

        out = out.mapInArrow(search, schema)
    return out, names


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", share: float = 0.05, **options) -> DataFrame:
    """Contamination columns for every document row: n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if at least ``share`` of its words (and one
    word) lie inside a window of a benchmark item.  ``hit_spans`` holds the
    merged word ranges and ``hit_items`` the item ids.
    """
    found, (n_words, spans, items) = find_benchmark(docs, benchmark, text=text, **options)
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1), F.lit(0).cast("long"),
                        lambda acc, i: acc + F.when(i % 2 == 0, -F.get(spans, i)).otherwise(F.get(spans, i)))
    n_hit = F.when(F.size(spans) > 0, n_hit).otherwise(F.lit(0).cast("long"))
    own = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "hit_items")
    kept = [c for c in docs.columns if c not in own]
    out = found.select(*kept, F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), F.col(spans).alias("hit_spans"), F.col(items).alias("hit_items"))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words"))
    if share == 0.05:
        bad = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", bad)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    found, (n_words, spans, _) = find_benchmark(docs, benchmark, text=text, **options)
    n_hit = F.expr(f"aggregate(transform(`{spans}`, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col(n_words)))).select(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id",
                    item_text: str = "text", least: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim match of every benchmark suffix, of at least ``least`` words, with one place.

    Returns item_id, item_word (where the suffix begins), n_matched, doc_id and
    doc_word.  Shards report their best place for each suffix; a partial
    maximum over (length, smallest doc_id, word) leaves one row per suffix.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    schema = "item_id string, item_word long, n_matched long, doc_id string, doc_word long"
    parts = []
    for block in blocks(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(Queries(block))

        def search(batches, shared=shared):
            q = shared.value
            begins = np.flatnonzero(q.tokens)
            left = runs(q.tokens)[begins] if len(begins) else begins
            begins, left = begins[left >= least], left[left >= least]
            for batch in batches:
                tokens, begin = shard_tokens(batch.column(1), q)
                reach = runs(tokens) if len(tokens) else np.empty(0, dtype=np.int64)
                order = suffix_array(tokens, np.flatnonzero(reach >= least), q.longest)
                if not len(order) or not len(begins):
                    continue
                lo, _ = bounds(tokens, order, q.tokens, begins, left)
                best, where = np.zeros(len(begins), dtype=np.int64), np.zeros(len(begins), dtype=np.int64)
                for near in (np.maximum(lo - 1, 0), np.minimum(lo, len(order) - 1)):
                    size = common(tokens, order[near], q.tokens, begins, left)
                    where, best = np.where(size > best, order[near], where), np.maximum(size, best)
                k = np.flatnonzero(best >= least)
                owner = np.searchsorted(q.begin, begins[k], side="right") - 1
                d = np.searchsorted(begin, where[k], side="right") - 1
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q.items[o] for o in owner], pa.string()), pa.array(begins[k] - q.begin[owner]), pa.array(best[k]),
                     ids.take(pa.array(d)), pa.array(where[k] - begin[d])], names=["item_id", "item_word", "n_matched", "doc_id", "doc_word"])

        parts.append(docs.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t")).mapInArrow(search, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    best = F.max_by(F.struct("doc_id", "doc_word"), F.struct("n_matched", F.col("doc_id"), -F.col("doc_word")))
    return out.groupBy("item_id", "item_word").agg(F.max("n_matched").alias("n_matched"), best.alias("p")).select(
        "item_id", "item_word", "n_matched", "p.doc_id", "p.doc_word")

"""Toxicity by weak supervision.

1. *Voters.*  Word stems (character n-grams inside words) that mark toxic
   documents are found in a bounded labelled sample; stems that occur in the
   same documents form one lexicon voter, and the rarest beyond the number of
   voters form the last one.  Pattern voters look at how many
   lexicons fire and how densely.
2. *Label model.*  Over all documents the voters' means and covariances are
   counted in one pass.  If voters were independent given the class, the
   covariance of two would be the product of their strengths, so triplets of
   voters give every strength, and with it the chance to fire in either class.
   How much more often than by chance voters meet tells the toxic share that
   they can see, which may be less than the labels' share.
   What remains of the covariance is correlation; correlated voters share
   their weight.  A vote is a hit; silence abstains.
3. *Classifier.*  A linear model is trained on the posteriors of a bounded
   sample of training documents, with the stems as features, and scores every
   whole text.

Empty and null texts score like a text in which nothing fires.  Without
labelled documents of both classes nothing is known and every score is 0.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerfold.llm.graph import arrow_batches
from ledgerfold.llm.text import LETTER, _TABLE, Words, mix, pieces, powers

BITS = 21
GRAMS = (4, 5, 6)
SAMPLE, LONGEST, SHARDS, MOST_STEMS, MOST_VOTERS = 8_000, 20_000, 4, 2_048, 96
DENSITY = 0.005
RATIO, SURPRISE = 40, 25
AGREEING = 3
PATTERNS = 5


def stem_slots(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(byte position, slot) of every n-gram inside a word and of every whole word."""
    up, down = powers(len(words.data) + 1)
    sums = np.empty(len(words.data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[words.data] * up[:-1], out=sums[1:])
    size = words.ends - words.starts
    shift = np.uint64(64 - BITS)
    out = []
    for n in GRAMS:
        room = np.maximum(size - n + 1, 0)
        at = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room) + np.repeat(words.starts, room)
        out.append((at, (mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n)) >> shift).astype(np.int64)))
    out.append((words.starts, (mix((sums[words.ends] - sums[words.starts]) * down[words.starts]) >> shift).astype(np.int64)))
    return out


def stem_table(order: np.ndarray) -> np.ndarray:
    """Number of each wanted slot, -1 for the others."""
    table = np.full(1 << BITS, -1, dtype=np.int16)
    table[order] = np.arange(len(order))
    return table


def surprise(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of the split of counts over the classes against chance."""
    share = n_toxic / max(1, n_toxic + n_clean)
    both = toxic + clean

    def part(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(expected, 1e-12)), 0.0)

    return 2 * (part(toxic, both * share) + part(clean, both * (1 - share)))


def hits(words: Words, table: np.ndarray, places: bool = False):
    """(text, stem) of every place of a wanted slot, and the byte if asked; ``table`` maps slots to stems or -1."""
    doc, stem, byte = [], [], []
    for at, slot in stem_slots(words):
        own = table[slot]
        good = np.flatnonzero(own >= 0)
        doc.append(np.searchsorted(words.offsets, at[good], side="right") - 1)
        stem.append(own[good].astype(np.int64))
        byte.append(at[good])
    out = np.concatenate(doc), np.concatenate(stem)
    return (*out, np.concatenate(byte)) if places else out


@dataclass
class LabelModel:
    """What the voters are worth."""

    prior: float
    fire_toxic: np.ndarray
    fire_clean: np.ndarray
    weights: np.ndarray
    correlation: np.ndarray
    silent: float = 1e-3

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = votes @ self.weights + np.log(self.prior / (1 - self.prior))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return np.where(votes.any(1), p, self.silent)


def seen_share(n: int, ones: np.ndarray, both: np.ndarray, use: np.ndarray, prior: float) -> float:
    """Share of documents in the class that the voters can see, at most ``prior``.

    Voters that are silent in clean documents and independent in toxic ones meet
    1 / share times as often as chance would have it; firing in clean documents
    lowers that.  The middle pair counts, pairs weighted by their documents.
    """
    i, j = np.nonzero(np.triu(use, 1))
    share = ones[i] * ones[j] / (max(n, 1) * np.maximum(both[i, j], 1))
    order = np.argsort(share, kind="stable")
    if not len(order):
        return prior
    weight = np.cumsum(both[i, j][order])
    return float(np.clip(share[order[np.searchsorted(weight, weight[-1] / 2)]], 1e-4, prior))


def label_model(n: int, ones: np.ndarray, both: np.ndarray, prior: float, patterns: int = 0) -> LabelModel:
    """Fire rates of binary voters from their counts and pair counts over ``n`` documents.

    ``prior`` bounds the toxic share.  The model's class is what the voters can
    see of it: with the whole share as class, toxic documents in which no voter
    fires would be taken for voters firing in clean ones.  The last
    ``patterns`` voters follow from the others and don't tell the share.
    """
    m = len(ones)
    mean = ones / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    var = np.maximum(mean * (1 - mean), 1e-12)
    noise = 2 * np.sqrt(np.outer(var, var) / max(n, 1))
    strong = cov > noise
    own = np.arange(m) < m - patterns
    prior = seen_share(n, ones, both, strong & np.outer(own, own) & (cov < 0.6 * np.sqrt(np.outer(var, var))), prior)
    most = mean * np.sqrt((1 - prior) / prior)
    linked = np.zeros((m, m), dtype=bool)
    for _ in range(2):  # the second time without the pairs that proved correlated
        strength = np.zeros(m)
        for i in range(m):
            near = np.flatnonzero(strong[i] & ~linked[i] & (np.arange(m) != i))
            j, k = np.meshgrid(near, near, indexing="ij")
            use = (j < k) & strong[j, k] & ~linked[j, k]
            found = cov[i, j[use]] * cov[i, k[use]] / cov[j[use], k[use]]
            strength[i] = np.sqrt(np.median(found)) if len(found) else np.sqrt(var[i] * prior)
        strength = np.minimum(strength, most)
        rest = (cov - np.outer(strength, strength)) / np.sqrt(np.outer(var, var))
        rest[np.diag_indices(m)] = 0
        linked = rest > 0.2
    toxic = np.clip(mean + strength * np.sqrt((1 - prior) / prior), 1e-3, 0.999)
    clean = np.clip(mean - strength * np.sqrt(prior / (1 - prior)), 1e-5, 0.999)
    rest = np.where(rest > 0.05, np.minimum(rest, 1), 0)
    weights = np.log(toxic / clean) / (1 + rest.sum(1))
    return LabelModel(prior, toxic, clean, weights, rest)


def groups_of_stems(counts: np.ndarray, both: np.ndarray, most: int) -> np.ndarray:
    """Voter of each stem: stems that share most of their documents vote together, and
    what ``most - 1`` such groups leave over votes as one, so every stem has a vote."""
    voter = np.full(len(counts), -1)
    n = 0
    for i in range(len(counts)):
        if voter[i] >= 0:
            continue
        like = both[i] >= 0.6 * np.minimum(counts[i], counts) if n < most - 1 else np.ones(len(counts), dtype=bool)
        voter[like & (voter < 0)] = n
        n += 1
    return voter


def votes_of(doc: np.ndarray, stem: np.ndarray, voter: np.ndarray, n_docs: int, n_words: np.ndarray) -> np.ndarray:
    """Votes (texts x voters): one lexicon voter per stem group, then the pattern voters."""
    n = int(voter.max(initial=-1)) + 1
    good = voter[stem] >= 0
    pair, times = np.unique(doc[good] * len(voter) + stem[good], return_counts=True)
    cell = pair // max(1, len(voter)) * n + voter[pair % max(1, len(voter))]
    size = np.minimum(np.bincount(voter[voter >= 0], minlength=n), AGREEING)
    # a whole marking word brings several of its stems; one stem alone can be chance
    fired = np.bincount(cell, minlength=n_docs * n).reshape(n_docs, n) >= size if n else np.zeros((n_docs, 0), dtype=bool)
    places = np.zeros(n_docs * n)
    np.maximum.at(places, cell, times)
    places = places.reshape(n_docs, n) * fired
    kinds, total = fired.sum(1), places.sum(1)
    dense = total >= DENSITY * np.maximum(n_words, 1)
    patterns = np.stack([kinds >= 2, kinds >= 3, (kinds > 0) & (places.max(1, initial=0) >= 3), (kinds > 0) & dense, (kinds >= 2) & dense], axis=1)
    return np.concatenate([fired, patterns], axis=1)


@dataclass
class Detector:
    """Stems, voters, label model and linear weights."""

    table: np.ndarray
    voter: np.ndarray
    model: LabelModel | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0

    def features(self, doc, stem, n_docs: int, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once: stems, then voters."""
        pairs = np.unique(doc * len(self.voter) + stem)
        d, v = np.nonzero(votes)
        return (np.concatenate([pairs // max(1, len(self.voter)), d]), np.concatenate([pairs % max(1, len(self.voter)), len(self.voter) + v]))

    def score(self, words: Words) -> np.ndarray:
        doc, stem = hits(words, self.table)
        n = len(words.first) - 1
        votes = votes_of(doc, stem, self.voter, n, words.counts())
        d, f = self.features(doc, stem, n, votes)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(d, weights=self.weights[f], minlength=n), -30, 30)))


def bounded(rows: DataFrame, key: Column, bound: int, total: int) -> DataFrame:
    """About ``bound`` of ``total`` rows by hash."""
    return rows.where(F.pmod(key, F.lit(1_000_000)) < int(min(1.0, bound / max(1, total)) * 1_000_000) + 1)


def arrays(df: DataFrame) -> list[list[np.ndarray]]:
    """Binary columns of a few result rows as int64 arrays."""
    table = df.toArrow()
    return [[np.frombuffer(b, dtype=np.int64) for b in table[c].to_pylist()] for c in table.column_names]


def fit(docs: DataFrame, labels: DataFrame, *, train: Column, doc: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE) -> Detector | None:
    """Learn from the documents where ``train`` holds (a condition on the id) and their labels."""
    spark = docs.sparkSession
    arrow_batches(spark)
    src = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"), train.alias("train"))
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    # labelled ids of the training part, as many of either class
    labelled = src.where("train").select("id").join(marks, "id")
    count = {r.y: r["count"] for r in labelled.groupBy("y").count().collect()}
    if len(count) < 2:
        return None
    prior = count[1] / (count[0] + count[1])
    h = F.xxhash64("id", F.lit(11))
    wanted = None
    for y in (0, 1):
        part = bounded(labelled.where(F.col("y") == y), h, sample // 2, count[y]).distinct()
        wanted = part if wanted is None else wanted.union(part)
    known = (src.where(F.col("train") & (F.length("text") <= LONGEST)).join(wanted, "id")
             .select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SHARDS)).alias("shard"), "y", "text").repartition(SHARDS, "shard").coalesce(SHARDS).persist())

    def count_stems(batches):
        total = np.zeros((2, 1 << BITS), dtype=np.uint16)
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy()
            n += np.bincount(y, minlength=2)
            for lo, hi, words in pieces(batch.column(2), LETTER, limit=200_000):
                slots = stem_slots(words)
                doc_of = np.concatenate([np.searchsorted(words.offsets, at, side="right") - 1 for at, _ in slots])
                one = np.unique(doc_of * (1 << BITS) + np.concatenate([s for _, s in slots]))
                own = y[lo:hi][one >> BITS]
                for c in (0, 1):
                    total[c] += np.bincount(one[own == c] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["c", "n"])

    got = known.mapInArrow(count_stems, "c binary, n binary").toArrow()
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    for b in got["c"].to_pylist():
        counts += np.frombuffer(zlib.decompress(b), dtype=np.uint16).reshape(2, -1)
    n = sum(np.frombuffer(b, dtype=np.int64) for b in got["n"].to_pylist())
    order = np.flatnonzero(counts[1])
    seen = counts[:, order].astype(float)
    del counts, got
    rate = (seen + 0.5) / (n[:, None] + 1)
    keep = np.flatnonzero((rate[1] >= RATIO * rate[0]) & (surprise(seen[1], seen[0], n[1], n[0]) >= SURPRISE))
    keep = keep[np.argsort(-seen[1][keep] * np.log(rate[1][keep] / rate[0][keep]), kind="stable")][:MOST_STEMS]
    order = order[keep]
    table = stem_table(order)

    def contexts(batches):
        """(stem, hash of the word before, class): near copies of a text repeat their contexts."""
        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, _, words in pieces(batch.column(2), LETTER):
                doc_of, stem, at = hits(words, table, places=True)
                if len(at):
                    before = words.hashes[np.maximum(np.searchsorted(words.starts, at, side="right") - 2, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(stem), pa.array(before.view(np.int64)), pa.array(y[lo + doc_of].astype(np.int64))], names=["s", "c", "y"])

    met = known.mapInArrow(contexts, "s long, c long, y long").distinct().groupBy("s").agg(
        F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).toArrow()  # a row per stem
    seen = np.zeros((2, len(order)))
    seen[:, met["s"].to_numpy()] = met["n0"].to_numpy(), met["n1"].to_numpy()
    rate = (seen + 0.5) / (n[:, None] + 1)
    order = order[(rate[1] >= RATIO * rate[0]) & (surprise(seen[1], seen[0], n[1], n[0]) >= SURPRISE)]
    table, k = stem_table(order), len(order)

    def pair_stems(batches):
        total = np.zeros((k, k), dtype=np.int64)
        for batch in batches:
            for _, _, words in pieces(batch.column(2), LETTER):
                doc_of, stem = hits(words, table)
                here = np.zeros((len(words.first) - 1, k), dtype=np.float32)
                here[doc_of, stem] = 1
                total += (here.T @ here).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["c"])

    both = sum(arrays(known.mapInArrow(pair_stems, "c binary"))[0], np.zeros(k * k, dtype=np.int64)).reshape(k, k)
    known.unpersist()
    detector = Detector(table, groups_of_stems(np.diag(both), both, MOST_VOTERS))
    shared = spark.sparkContext.broadcast(detector)

    def moments(batches):
        """Counts of votes and of pairs of votes of all documents of a task."""
        own, ones, pairs, n = shared.value, 0, 0, 0
        for batch in batches:
            for _, _, words in pieces(batch.column(0), LETTER):
                doc_of, stem = hits(words, own.table)
                votes = votes_of(doc_of, stem, own.voter, len(words.first) - 1, words.counts()).astype(np.float64)
                ones, pairs, n = ones + votes.sum(0), pairs + votes.T @ votes, n + len(votes)
        if n:
            flat = np.concatenate([[n], ones, pairs.reshape(-1)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "n"])

    flat = src.select("text").mapInArrow(moments, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    value = np.zeros(flat.num_rows, dtype=np.int64)
    value[flat["k"].to_numpy()] = flat["n"].to_numpy()
    m = int(detector.voter.max(initial=-1)) + 1 + PATTERNS
    ones, pairs = value[1:1 + m], value[1 + m:].reshape(m, m)
    detector.model = label_model(int(value[0]), ones, pairs, prior, PATTERNS)
    # the classifier's training rows: a bounded sample of the training part, labelled or not
    total = src.where("train").count()
    rows = bounded(src.where(F.col("train")), F.xxhash64("id", F.lit(23)), 4 * sample, total).select("text")
    shared = spark.sparkContext.broadcast(detector)

    def examples(batches):
        own = shared.value
        for batch in batches:
            for _, _, words in pieces(batch.column(0), LETTER):
                n = len(words.first) - 1
                doc_of, stem = hits(words, own.table)
                votes = votes_of(doc_of, stem, own.voter, n, words.counts())
                d, f = own.features(doc_of, stem, n, votes)
                order = np.argsort(d, kind="stable")
                cuts = np.searchsorted(d[order], np.arange(1, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.split(f[order], cuts), pa.list_(pa.int64())), pa.array(own.model.posterior(votes.astype(float)))],
                                                 names=["f", "p"])

    table = rows.mapInArrow(examples, "f array<long>, p double").toArrow()
    table = table.take(np.argsort(table["p"].to_numpy(), kind="stable"))
    p = table["p"].to_numpy()
    fired = np.array([len(f) > 0 for f in table["f"].to_pylist()])
    # documents in which nothing fires hold what the prior leaves over
    left = max(prior * len(p) - p[fired].sum(), 0.0)
    detector.model.silent = float(np.clip(left / max(1, (~fired).sum()), 1e-4, 0.2))
    p = np.where(fired, p, detector.model.silent)
    detector.weights, detector.bias = logistic(table["f"].to_pylist(), p, k + m)
    pa.default_memory_pool().release_unused()
    return detector


def logistic(features: list[list[int]], p: np.ndarray, size: int, rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear weights for soft labels ``p`` by full-batch AdaGrad."""
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    col = np.array([x for f in features for x in f], dtype=np.int64)
    w, b = np.zeros(size), float(np.log(max(p.mean(), 1e-6) / max(1 - p.mean(), 1e-6))) if len(p) else 0.0
    acc_w, acc_b = np.full(size, 1e-8), 1e-8
    for _ in range(rounds if len(p) else 0):
        z = b + np.bincount(row, weights=w[col], minlength=len(p))
        g = p - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gw, gb = np.bincount(col, weights=g[row], minlength=size) / len(p) - decay * w / size, g.mean()
        acc_w += gw * gw
        acc_b += gb * gb
        w += 0.3 * gw / np.sqrt(acc_w)
        b += 0.3 * gb / np.sqrt(acc_b)
    return w, b


def with_score(docs: DataFrame, detector: Detector | None, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1; an existing column of that name is replaced."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select([c for c in docs.columns if c != name])
    if detector is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = spark.sparkContext.broadcast(detector)
    at = docs.columns.index(text)

    def work(batches):
        own = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, words in pieces(batch.column(at), LETTER):
                out[lo:hi] = own.score(words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))

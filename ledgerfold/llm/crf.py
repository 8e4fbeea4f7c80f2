"""Language of every word by a linear-chain conditional random field.

A word's score for a language is the sum of the weights of its features:
prefixes and suffixes, character n-grams, the word itself, and whether it is in
the lexicon of a language.  Transition weights between neighbouring words are
learned with them.  Forward-backward gives the posterior of every word's
language in its context, so code-switched texts get several languages; a
document's language has the largest share of its words' posteriors.

Training uses at most about ``SAMPLE`` whole documents of up to ``LONGEST``
characters (the documented bound), spread over the languages by hash.  Each of ``SHARDS`` tasks runs AdaGrad on its share and
the weights are averaged, ``ROUNDS`` times.  Prediction reads whole texts.

Texts that are null or have no letter get ``und`` and score 0.  Without any
labelled document everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerfold.llm.graph import arrow_batches
from ledgerfold.llm.text import LETTER, Words, mix, pieces

BUCKETS = 1 << 16
SAMPLE, LONGEST, SHARDS, ROUNDS, EPOCHS, SEGMENT = 2_000, 20_000, 4, 2, 3, 80
BLOCK = 64
UNDETERMINED = "und"


def features(words: Words) -> list[np.ndarray]:
    """Feature numbers per word (prefix, suffix, word), and per byte (bigram, trigram)."""
    data = words.data.astype(np.uint64)
    s, e = words.starts, words.ends

    def slot(x, kind):
        return (mix(x * np.uint64(8) + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int64)

    def byte(i):
        return np.where((i >= s) & (i < e), data[np.clip(i, 0, max(len(data) - 1, 0))], 32).astype(np.uint64)

    c = np.uint64(256)
    head, tail = byte(s), byte(e - 1)
    p2 = head * c + byte(s + 1)
    p3 = p2 * c + byte(s + 2)
    t2 = byte(e - 2) * c + tail
    t3 = byte(e - 3) * c * c + t2
    whole = slot(words.hashes, 7)
    return [slot(p2, 1), slot(p3, 2), slot(t2, 3), slot(t3, 4), whole]


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and trigram features of every byte of every word, blanks around the word."""
    size = words.ends - words.starts
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(words.starts, size)
    data = words.data.astype(np.uint64)
    first = np.zeros(len(at), dtype=bool)
    first[np.cumsum(size) - size] = True
    last = np.zeros(len(at), dtype=bool)
    last[np.cumsum(size) - 1] = True
    here = data[at]
    before = np.where(first, np.uint64(32), data[np.maximum(at - 1, 0)])
    after = np.where(last, np.uint64(32), data[np.minimum(at + 1, max(len(data) - 1, 0))])
    c = np.uint64(256)
    two = (mix((before * c + here) * np.uint64(8) + np.uint64(5)) % np.uint64(BUCKETS)).astype(np.int64)
    three = (mix(((before * c + here) * c + after) * np.uint64(8) + np.uint64(6)) % np.uint64(BUCKETS)).astype(np.int64)
    return two, three


class Model:
    """Weights: features x languages, lexicon x languages, transitions."""

    def __init__(self, languages: list[str], lexicon: tuple[np.ndarray, np.ndarray]):
        k = len(languages)
        self.languages, self.known, self.member = languages, lexicon[0], lexicon[1]
        self.w = np.zeros((BUCKETS, k), dtype=np.float32)
        self.lex = np.zeros((k, k), dtype=np.float32)
        self.trans = np.zeros((k, k), dtype=np.float32)

    def lexicon_rows(self, hashes: np.ndarray) -> np.ndarray:
        """Indicator per word and language: the word is in its lexicon."""
        if not len(self.known):
            return np.zeros((len(hashes), len(self.languages)), dtype=np.float32)
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return np.where((self.known[at] == hashes)[:, None], self.member[at], np.float32(0))

    def emissions(self, words: Words) -> tuple[np.ndarray, tuple]:
        own = features(words)
        two, three = grams(words)
        size = words.ends - words.starts
        begin = np.cumsum(size) - size
        lex = self.lexicon_rows(words.hashes)
        score = lex @ self.lex
        for f in own:
            score += self.w[f]
        # n-gram scores are averaged by the square root of the word's length
        norm = (1 / np.sqrt(size)).astype(np.float32)[:, None]
        score += np.add.reduceat(self.w[two] + self.w[three], begin, axis=0) * norm
        return score, (own, two, three, size, norm, lex)


def chain_posteriors(score: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Forward-backward over chains of words that lie one after the other.

    Chains are cut into blocks of ``BLOCK`` words.  The product of a block's
    transfer matrices carries the state over it, so all blocks of all chains
    advance together and a very long text costs no more steps than a short one.
    Returns posteriors (words x states) and, if asked, expected transitions.
    """
    n, k = score.shape
    t = np.exp(trans - trans.max()).astype(np.float32)
    e = np.exp(score - score.max(1, keepdims=True)).astype(np.float32)
    counts = np.diff(first)
    nb = -(-counts // BLOCK)
    of = np.repeat(np.arange(len(counts)), nb)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(nb) - nb, nb)
    start = first[:-1][of] + inside * BLOCK
    size = np.minimum(BLOCK, first[1:][of] - start)
    depth = int(size.max()) if len(size) else 0
    order = np.argsort(-size, kind="stable")
    start, size, of, inside = start[order], size[order], of[order], inside[order]
    live = [int(np.searchsorted(-size, -d, side="left")) for d in range(depth)]  # blocks with more than d words
    product = np.broadcast_to(np.eye(k, dtype=np.float32), (len(start), k, k)).copy()
    for d in range(depth):
        m = live[d]
        step = (product[:m] @ t) * e[start[:m] + d][:, None, :]
        product[:m] = step / step.sum((1, 2), keepdims=True)
    # states at the block borders, chain by chain but all chains at once
    enter = np.full((len(start), k), 1 / k, dtype=np.float32)
    leave = np.ones((len(start), k), dtype=np.float32)
    place = np.empty(len(start), dtype=np.int64)
    base = np.cumsum(nb) - nb
    place[base[of] + inside] = np.arange(len(start))
    for j in range(1, int(nb.max()) if len(nb) else 0):
        docs = np.flatnonzero(nb > j)
        prev, here = place[base[docs] + j - 1], place[base[docs] + j]
        a = (enter[prev][:, None, :] @ product[prev])[:, 0]
        enter[here] = a / a.sum(1, keepdims=True)
    for j in range(int(nb.max()) - 2 if len(nb) else -1, -1, -1):
        docs = np.flatnonzero(nb > j + 1)
        here, nxt = place[base[docs] + j], place[base[docs] + j + 1]
        b = (product[nxt] @ leave[nxt][:, :, None])[:, :, 0]
        leave[here] = b / b.sum(1, keepdims=True)
    alpha = np.empty((n, k), dtype=np.float32)
    state = enter.copy()
    for d in range(depth):
        m = live[d]
        a = (state[:m] @ t) * e[start[:m] + d]
        state[:m] = a / a.sum(1, keepdims=True)
        alpha[start[:m] + d] = state[:m]
    gamma = np.empty((n, k), dtype=np.float32)
    moves = np.zeros((k, k))
    back = leave.copy()
    for d in range(depth - 1, -1, -1):
        m = live[d]
        at = start[:m] + d
        g = alpha[at] * back[:m]
        gamma[at] = g / g.sum(1, keepdims=True)
        b = e[at] * back[:m]
        if pairs:
            before = alpha[at - 1] if d else enter[:m]
            xi = before[:, :, None] * t[None] * b[:, None, :]
            xi /= xi.sum((1, 2), keepdims=True)
            moves += xi[(d > 0) | (inside[:m] > 0)].sum(0)
        b = b @ t.T
        back[:m] = b / b.sum(1, keepdims=True)
    return (gamma, moves) if pairs else gamma


def train_shard(model: Model, texts: list[str], labels: np.ndarray, epochs: int, rate: float = 0.25) -> None:
    """AdaGrad on the conditional likelihood, in batches of segments; changes ``model``."""
    k = len(model.languages)
    sums = [np.full_like(x, 1e-4) for x in (model.w, model.lex, model.trans)]
    column = pa.array(texts, pa.large_string())
    batches = [(words, labels[lo:hi]) for lo, hi, words in pieces(column, LETTER, limit=60_000) if len(words.starts)]
    for _ in range(epochs):
        for words, own in batches:
            # a chain of a single segment: whole texts would make the languages' borders too rare
            truth = np.repeat(own, words.counts())
            seg = np.unique(np.concatenate([words.first, *[np.arange(a, b, SEGMENT) for a, b in zip(words.first[:-1], words.first[1:])]]))
            score, (feats, two, three, size, norm, lex) = model.emissions(words)
            gamma, moves = chain_posteriors(score, seg, model.trans, pairs=True)
            grad = -gamma
            grad[np.arange(len(truth)), truth] += 1
            known = np.zeros((k, k))
            inner = np.ones(len(truth), dtype=bool)
            inner[seg[:-1]] = False
            np.add.at(known, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
            slots = np.concatenate([*feats, two, three])
            spread = np.repeat(grad * norm, size, axis=0)
            values = np.concatenate([*[grad] * len(feats), spread, spread])
            total = np.stack([np.bincount(slots, weights=values[:, c], minlength=BUCKETS) for c in range(k)], axis=1)
            # most texts hold one language: without a strong prior the transitions would outweigh every word
            for weight, acc, g, decay in zip((model.w, model.lex, model.trans), sums, (total, lex.T @ grad, known - moves), (1e-4, 1e-4, 0.1)):
                g = g / len(own)
                acc += g * g
                weight += rate * g / np.sqrt(acc) - decay * weight


def sampled(docs: DataFrame, lang: str, text: str, doc: str, bound: int) -> DataFrame:
    """At most about ``bound`` labelled documents, as many of each language, by hash of the id."""
    have = docs.where(F.col(lang).isNotNull() & (F.length(text) <= LONGEST))
    counts = {r[0]: r[1] for r in have.groupBy(lang).count().collect()}  # one row per language
    if not counts:
        return have.limit(0)
    each = bound / len(counts)
    part = F.lit(0)
    for name, n in counts.items():
        part = F.when(F.col(lang) == name, F.lit(min(1.0, each / n))).otherwise(part)
    return have.where(F.pmod(F.xxhash64(doc), F.lit(1_000_000)) < part * 1_000_000)


def lexicons(texts: list[str], labels: np.ndarray, k: int, least: int = 5, share: float = 0.8):
    """Words of the sample that belong to one language: hash and indicator rows."""
    hashes, truth = [], []
    for lo, hi, words in pieces(pa.array(texts, pa.large_string()), LETTER):
        hashes.append(words.hashes)
        truth.append(np.repeat(labels[lo:hi], words.counts()))
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    table = np.zeros((len(known), k))
    np.add.at(table, (at, np.concatenate(truth)), 1)
    total = table.sum(1)
    keep = (total >= least) & (table.max(1) >= share * total)
    return known[keep], (table[keep] >= share * total[keep, None]).astype(np.float32)


def fit(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Train on a bounded sample of the labelled documents."""
    spark = docs.sparkSession
    arrow_batches(spark)
    chosen = sampled(docs, lang, text, doc, sample).select(
        F.pmod(F.xxhash64(doc, F.lit(3)), F.lit(SHARDS)).alias("shard"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    table = chosen.toArrow()  # bounded by ``sample`` and LONGEST
    if not table.num_rows:
        return None
    names = sorted(set(table["lang"].to_pylist()))
    labels = np.searchsorted(np.array(names), np.array(table["lang"].to_pylist()))
    texts = table["text"].to_pylist()
    model = Model(names, lexicons(texts, labels, len(names)))
    keep = spark.createDataFrame(table).repartition(SHARDS, "shard")
    order = F.xxhash64("text")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def work(batches):
            own, rows = shared.value, []
            for batch in batches:
                rows += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            if rows:
                at = np.searchsorted(np.array(own.languages), np.array([r[0] for r in rows]))
                train_shard(own, [r[1] for r in rows], at, EPOCHS)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (own.w, own.lex, own.trans)], names=["w", "l", "t"])

        got = keep.sortWithinPartitions(order).mapInArrow(work, "w binary, l binary, t binary").toArrow()
        k = len(names)
        mean = [np.mean([np.frombuffer(b, dtype=np.float32) for b in got[c].to_pylist()], axis=0) for c in ("w", "l", "t")]
        model.w, model.lex, model.trans = mean[0].reshape(-1, k), mean[1].reshape(k, k), mean[2].reshape(k, k)
    return model


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of one text."""
    out = []
    for _, _, words in pieces(pa.array([text], pa.large_string()), LETTER):
        if len(words.starts):
            gamma = chain_posteriors(model.emissions(words)[0], words.first, model.trans)
            out += [(words.word(i), model.languages[g.argmax()], float(g.max())) for i, g in enumerate(gamma)]
    return out


def predict(docs: DataFrame, model: Model | None, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, lang_pred, score and the share of words per language."""
    spark = docs.sparkSession
    arrow_batches(spark, 1000)
    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return src.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                          F.lit(None).cast("map<string,double>").alias("shares"))
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[doc].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("letters", T.BooleanType()), T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def work(batches):
        own = shared.value
        k = len(own.languages)
        for batch in batches:
            total = np.zeros((batch.num_rows, k))
            for lo, hi, words in pieces(batch.column(2), LETTER, limit=1_000_000):
                if len(words.starts):
                    full = np.flatnonzero(words.counts())
                    gamma = chain_posteriors(own.emissions(words)[0], words.first, own.trans)
                    total[lo + full] = np.add.reduceat(gamma, words.first[:-1][full], axis=0)
            total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(total), pa.list_(pa.float64()))],
                                             names=["doc_id", "letters", "shares"])

    out = src.select("doc_id", letters.alias("letters"), "text").mapInArrow(work, schema)
    names = F.array(*[F.lit(n) for n in model.languages])
    top = F.array_max("shares")
    sure = F.col("letters") & (top > 0)
    return out.select("doc_id", F.when(sure, F.get(names, F.array_position("shares", top).cast("int") - 1)).otherwise(UNDETERMINED).alias("lang_pred"),
                      F.when(sure, F.least(top, F.lit(1.0))).otherwise(0.0).alias("score"),
                      F.map_from_arrays(names, "shares").alias("shares"))

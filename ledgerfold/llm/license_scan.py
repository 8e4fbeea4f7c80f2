"""Licence notices: exact phrases and a fuzzy search for short notices.

Words are runs of letters and digits, joined by single blanks, so punctuation
and line breaks inside a notice do not matter.  *Base* places are where the
words of a phrase stand consecutively.  The fuzzy search follows the pigeonhole
rule: a notice with at most k edits leaves one of its k + 1 pieces intact, so
exact hits of the pieces give every candidate; a regular expression with
bounded errors then verifies the edits and reports the span.  A span is whole
words: what a word has beyond the notice counts as edits.

Null and empty texts have no words, no places and a score of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerfold.llm.graph import arrow_batches, fresh
from ledgerfold.llm.text import ALNUM, Words, hash_words, pieces

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices of the fuzzy search: label, words, most edits.
NOTICES = [
    ("mit", "licensed under the mit license", 2),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "gnu general public license", 3),
    ("lgpl", "gnu lesser general public license", 2),
    ("agpl", "gnu affero general public license", 2),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("bsd", "bsd 3 clause license", 1),
    ("mpl", "mozilla public license", 2),
    ("cc", "licensed under a creative commons", 3),
    ("cc", "creative commons attribution", 2),
    ("cc", "licensed under cc by nc 4 0", 2),
    ("epl", "eclipse public license", 2),
    ("isc", "permission to use copy modify and or distribute this software", 5),
]


class Notice:
    """One notice: its pieces with their offsets, and the verifying pattern."""

    def __init__(self, label: str, words: str, edits: int):
        self.label, self.words, self.edits = label, words, edits
        cuts = [round(i * len(words) / (edits + 1)) for i in range(edits + 2)]
        self.pieces = [(a, words[a:b].encode()) for a, b in zip(cuts, cuts[1:])]
        self.slack = 4 * edits + 1  # bytes that the edits and the blank before or after can take up
        self.pattern = regex.compile(rf"(?b) (?:{regex.escape(words, literal_spaces=True)}){{e<={edits}}}(?= |\Z)")


def normal_form(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words with one blank before each, as bytes; offset of each text and first byte of each word."""
    size = words.ends - words.starts
    start = np.cumsum(size + 1) - size
    out = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    at = np.arange(int(size.sum()))
    base = np.cumsum(size) - size
    out[at + np.repeat(start - base, size)] = words.data[at + np.repeat(words.starts - base, size)]
    ends = np.append(0, np.cumsum(size + 1))
    return out.tobytes(), ends[words.first], start


def matches(pattern, text: str) -> list:
    """Matches from left to right: the best of all, then those in the parts left and right of it."""
    out, parts = [], [(0, len(text))]
    while parts:
        lo, hi = parts.pop()
        m = pattern.search(text, lo, hi)
        if m and m.end() > m.start():
            out.append(m)
            parts += [(lo, m.start()), (m.end(), hi)]
    return sorted(out, key=lambda m: m.start())


def fuzzy(blob: bytes, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray, notices: list[Notice]) -> list[tuple]:
    """(text, label, first word, words, edits, share of equal characters) of every verified notice."""
    seeds: dict[bytes, list[int]] = {}
    for notice in notices:
        for _, piece in notice.pieces:
            if piece not in seeds:
                found, p = [], blob.find(piece)
                while p >= 0:
                    found.append(p)
                    p = blob.find(piece, p + 1)
                seeds[piece] = found
    out = []
    for notice in notices:
        lo = np.sort(np.array([p - a - notice.slack for a, piece in notice.pieces for p in seeds[piece]], dtype=np.int64))
        if not len(lo):
            continue
        width = len(notice.words.encode()) + 2 * notice.slack
        new = np.append(True, lo[1:] > np.maximum.accumulate(lo + width)[:-1])
        for a, b in zip(lo[new], np.append(lo[np.flatnonzero(new)[1:] - 1], lo[-1]) + width):
            # a window may touch several texts; each is searched on its own
            d, last = (int(np.searchsorted(offsets, x, side="right")) - 1 for x in (max(a, 0), min(b, len(blob)) - 1))
            for doc in range(d, last + 1):
                end = int(offsets[doc + 1])
                s, e = blob.find(b" ", max(int(a), int(offsets[doc])), end), min(int(b), end)
                if e < end:  # a word cut by the window is none
                    e = blob.rfind(b" ", s, e)
                if s < 0 or e <= s:
                    continue
                part = blob[s:e].decode()
                for m in matches(notice.pattern, part):
                    edits = sum(m.fuzzy_counts)
                    w0, w1 = (int(np.searchsorted(starts, s + len(part[:x].encode()))) for x in (m.start() + 1, m.end()))
                    out.append((doc, notice.label, w0 - int(first[doc]), w1 - w0, edits, 1 - edits / len(notice.words)))
    return out


def base_places(words: Words, phrases: dict[str, str]) -> list[tuple[int, str, int]]:
    """(text, label, first word) of every place of a phrase."""
    hashes, out = words.hashes, []
    doc = words.doc_of()
    for phrase, label in phrases.items():
        parts = phrase.split(" ")
        keys = hash_words(parts)
        n = len(hashes) - len(parts) + 1
        if n <= 0:
            continue
        hit = np.flatnonzero(hashes[:n] == keys[0])
        for d in range(1, len(parts)):
            hit = hit[hashes[hit + d] == keys[d]]
        for w in hit[doc[hit] == doc[hit + len(parts) - 1]].tolist():
            if all(words.word(w + d) == parts[d] for d in range(len(parts))):
                out.append((int(doc[w]), label, w - int(words.first[doc[w]])))
    return out


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("base", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
    T.StructField("notices", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("edits", T.LongType()), T.StructField("similarity", T.DoubleType())]))),
])


def scan(docs: DataFrame, *, text: str = "text", phrases: dict[str, str] | None = None, notices: list[tuple[str, str, int]] | None = None,
         name: str | None = None) -> tuple[DataFrame, str]:
    """Add one struct (n_words, base places, verified notices with spans) to every row."""
    arrow_batches(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices
    name = name or fresh(docs, "licenses")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, FIELDS)])
    at = docs.columns.index(text)

    def rows(batches):
        compiled = [Notice(*n) for n in notices]
        for batch in batches:
            n = batch.num_rows
            counts, base, found = np.zeros(n, dtype=np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            for lo, hi, words in pieces(batch.column(at), ALNUM):
                counts[lo:hi] = words.counts()
                for d, label, w in base_places(words, phrases):
                    base[lo + d].append({"label": label, "word": w})
                blob, offsets, starts = normal_form(words)
                for d, label, w, size, edits, like in fuzzy(blob, offsets, starts, words.first, compiled):
                    found[lo + d].append({"label": label, "word": w, "n_words": size, "edits": edits, "similarity": like})
            value = [{"n_words": int(c), "base": b, "notices": f} for c, b, f in zip(counts, base, found)]
            kind = pa.struct([("n_words", pa.int64()), ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                              ("notices", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()),
                                                              ("edits", pa.int64()), ("similarity", pa.float64())])))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(rows, schema), name


def license_report(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score and the notices found."""
    found, s = scan(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), name="_licenses", **options)
    base, notices = F.col(f"{s}.base"), F.col(f"{s}.notices")
    labels = F.array_union(base["label"], notices["label"])
    return found.select(
        "doc_id", f"{s}.n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"), F.array_max(base["word"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(notices["similarity"]), F.lit(0.0))).alias("score"),
        notices.alias("notices"))

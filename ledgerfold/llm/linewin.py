"""Line deduplication with overlapping windows of three lines.

A text is cut into lines at newlines and after words that end in ``.``, ``!``
or ``?`` (an unwrapped paragraph is a single physical line, so passages inside
it could not be seen otherwise).  A window begins at every line and takes three
lines, or more until it has ``min_words`` words.  Words decide, not the white
space between them.  Windows are hashed (128 bits), counted over the whole
corpus, and every occurrence but the first by (doc id, line) is removed: the
lines that removed windows cover are merged and cut out of the text.

With ``passages`` two further kinds of windows are counted the same way.  *Pieces*
see repeats that begin in mid-sentence or have no sentence ends: a piece begins
at each word with the smallest hash of some ``SPAN`` words in a row, so pieces
depend on near words only and have at most ``SPAN`` words; a window takes whole
pieces until it has ``min_words`` words.  Any repeat of 3 * SPAN + min_words - 2
(51) words then holds an equal window wherever it begins; up to SPAN - 1 words
of it may stay at either end.  There a wide (CJK) character is a word of its own.
*Short rows* are three physical lines of fewer than ``min_words`` words.

Texts of fewer than three lines or ``min_words`` words have no window and stay.
Null texts stay null.  Rows that share id and text count as one occurrence and
are treated alike.  A null id sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerfold.llm.graph import arrow_batches, fresh
from ledgerfold.llm.text import NONSPACE, Words, as_long, buffers, pieces, runs_hash
from ledgerfold.session import materialize

LINES, MIN_WORDS, SPAN = 3, 20, 11
STEP = 1 << 29  # numbers of pieces and of physical lines begin here and at twice this
SEEDS = [(0, 0x51ED270B), (0x2545F491, 0x6C078965), (0x19660D, 0x3C6EF35F)]


class Lines:
    """Lines of the texts of one piece: first word of each and the texts' line ranges."""

    def __init__(self, words: Words):
        self.words = words
        newline = np.concatenate([[0], np.cumsum(words.raw == 10)])
        n = len(words.starts)
        last = np.zeros(n, dtype=bool)
        if n:
            tail = words.raw[words.ends - 1]
            last = (tail == ord(".")) | (tail == ord("!")) | (tail == ord("?"))
            last[:-1] |= newline[words.starts[1:]] > newline[words.ends[:-1]]
        head = np.zeros(n + 1, dtype=bool)
        head[1:] = last
        head[words.first] = True
        self.begin = np.flatnonzero(head[:n])
        self.first = np.searchsorted(self.begin, words.first)

    def whole(self, begin: np.ndarray) -> "Lines":
        """The same words with lines that begin at other words."""
        out = object.__new__(Lines)
        out.words, out.begin = self.words, begin
        out.first = np.searchsorted(begin, self.words.first)
        return out

    def windows(self, lines: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per line: text, last line of its window (exclusive), and whether the window exists."""
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.arange(len(self.begin))
        ends = np.append(self.begin, len(self.words.starts))
        stop = np.maximum(at + lines, np.searchsorted(ends, self.begin + min_words))
        return doc, stop, stop <= self.first[doc + 1]


def fine_words(words: Words) -> Words:
    """Words that also end before and after every wide character (three bytes, E3-ED or EF in front)."""
    lead = ((words.raw >= 0xE3) & (words.raw <= 0xED)) | (words.raw == 0xEF)
    if not lead.any():
        return words
    inside = NONSPACE[words.raw]
    at = np.flatnonzero(lead & inside)
    edge = np.zeros(len(words.raw) + 1, dtype=bool)
    edge[at] = True
    edge[np.minimum(at + 3, len(words.raw))] = True
    out = object.__new__(Words)
    out.raw, out.data, out.offsets = words.raw, words.data, words.offsets
    edge[words.starts] = True
    out.starts = np.flatnonzero(edge[:-1] & inside)
    after = edge.copy()
    after[words.ends] = True
    out.ends = np.flatnonzero(after[1:] & inside) + 1
    out.first = np.searchsorted(out.starts, words.offsets)
    return out


def piece_starts(words: Words) -> np.ndarray:
    """First words of the pieces: smallest hash of some ``SPAN`` words of one text."""
    n = len(words.starts)
    head = np.zeros(n + 1, dtype=bool)
    head[words.first] = True
    if n >= SPAN:
        low = np.lib.stride_tricks.sliding_window_view(words.hashes, SPAN).argmin(axis=1)
        at = np.arange(n - SPAN + 1)
        doc = words.doc_of()
        one = doc[at] == doc[at + SPAN - 1]
        head[(at + low)[one]] = True
    return np.flatnonzero(head[:n])


def families(cut: Lines, lines: int, min_words: int, passages: bool):
    """(number of the first line, seeds, lines, ends of the windows, text of each line, whether its window exists)."""
    yield 0, SEEDS[0], cut, *cut.windows(lines, min_words)
    if passages:
        fine = Lines(fine_words(cut.words)) if len(cut.words.starts) else cut
        fine = fine.whole(piece_starts(fine.words))
        yield STEP, SEEDS[1], fine, *fine.windows(1, min_words)
        words = cut.words
        newline = np.concatenate([[0], np.cumsum(words.raw == 10)])
        head = np.zeros(len(words.starts) + 1, dtype=bool)
        head[words.first] = True
        head[1:-1] |= newline[words.starts[1:]] > newline[words.ends[:-1]]
        rows = cut.whole(np.flatnonzero(head[:-1]))
        doc, stop, live = rows.windows(lines, 0)
        ends = np.append(rows.begin, len(words.starts))
        short = ends[np.minimum(stop, len(rows.begin))] - rows.begin < min_words
        yield 2 * STEP, SEEDS[2], rows, doc, stop, live & short


def window_rows(ids, keys, column, lines: int, min_words: int, names, passages: bool = False):
    for lo, _, words in pieces(column, NONSPACE, lower=False):
        for number, seeds, cut, doc, stop, live in families(Lines(words), lines, min_words, passages):
            if not live.any():
                continue
            doc, stop, at = doc[live], stop[live], np.flatnonzero(live)
            ends = np.append(cut.begin, len(cut.words.starts))
            hashes = cut.words.hashes
            keyed = [runs_hash(hashes, ends[at], ends[stop], seed) for seed in seeds]
            rows = pa.array(doc + lo)
            place = pa.array((at - cut.first[doc] + number).astype(np.int32))
            yield pa.RecordBatch.from_arrays([as_long(keyed[0]), as_long(keyed[1]), ids.take(rows), keys.take(rows), place], names=names)


def cut_text(raw: bytes, marked: list[int] | None, lines: int, min_words: int, passages: bool = False) -> tuple[str | None, int, int]:
    """Text without the windows that begin at the marked lines; lines before, lines of which something was removed."""
    buffer = np.frombuffer(raw, dtype=np.uint8)
    cut = Lines(Words(buffer, np.array([0, len(buffer)]), NONSPACE, lower=False))
    n = len(cut.begin)
    if not marked:
        return None, n, 0
    cover = np.zeros(len(raw) + 1, dtype=np.int64)
    marks, bounds = np.array(marked), []
    for number, _, own, _, stop, _ in families(cut, lines, min_words, passages):
        at = own.words.starts[own.begin]
        at[0] = 0
        at = np.append(at, len(raw))
        bounds.append(at)
        k = marks[(marks >= number) & (marks < number + STEP)] - number
        np.add.at(cover, at[k], 1)
        np.add.at(cover, at[stop[k]], -1)
    covered = np.cumsum(cover[:-1]) > 0
    starts = bounds[0][:-1]
    touched = np.logical_or.reduceat(covered, starts)
    at = np.unique(np.concatenate(bounds))
    gone = covered[at[:-1]]
    out = bytearray()
    for k in range(len(gone)):
        part = raw[at[k]:at[k + 1]]
        if not gone[k]:
            out += part
        elif b"\n" in part and out and not out.endswith(b"\n"):
            out = bytearray(out.rstrip(b" ")) + b"\n"
    return bytes(out).rstrip().decode("utf-8", "replace"), n, int(touched.sum())


def repeated_windows(docs: DataFrame, *, doc: str, text: str, lines: int, min_words: int, passages: bool = False) -> DataFrame:
    """(id, key, line) of every window that is not the first of its kind."""
    names = ["h1", "h2", "id", "rk", "line"]
    kind = docs.schema[doc].dataType
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("id", kind),
                           T.StructField("rk", T.IntegerType()), T.StructField("line", T.IntegerType())])

    def rows(batches):
        for batch in batches:
            yield from window_rows(batch.column(0), batch.column(1), batch.column(2), lines, min_words, names, passages)

    windows = docs.select(F.col(doc).alias("id"), F.hash(doc, text).alias("rk"), F.col(text).alias("t")).mapInArrow(rows, schema)
    place = F.struct("id", "rk", "line")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    # written, so that both sides of the join are plain exchanges, of which Spark splits the skewed ones
    first = materialize(first, "first")
    return windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "rk", "line").distinct()


def remove_repeats(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lines: int = LINES, min_words: int = MIN_WORDS,
                   passages: bool = False) -> DataFrame:
    """``docs`` with later repeats cut out of ``text``, plus n_lines and n_removed.

    Other columns pass unchanged (existing columns of those two names are replaced).
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select([c for c in docs.columns if c not in ("n_lines", "n_removed")])
    later = repeated_windows(docs, doc=doc, text=text, lines=lines, min_words=min_words, passages=passages).groupBy("id", "rk").agg(
        F.collect_list("line").alias("marked"))
    rk, marked = fresh(docs, "rk"), fresh(docs, "marked")
    keyed = docs.withColumn(rk, F.hash(doc, text))
    joined = keyed.join(later.withColumnsRenamed({"id": "_later_id", "rk": "_later_rk", "marked": marked}),
                        F.col(doc).eqNullSafe(F.col("_later_id")) & (F.col(rk) == F.col("_later_rk")), "left")
    joined = joined.select(*docs.columns, marked)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    names = schema.fieldNames()

    def cut(batches):
        for batch in batches:
            column = batch.column(at)
            marks = batch.column(batch.num_columns - 1)
            raw, offsets = buffers(column)
            n_lines = np.zeros(len(column), dtype=np.int64)
            n_gone = np.zeros(len(column), dtype=np.int64)
            for lo, hi, words in pieces(column, NONSPACE, lower=False):
                n_lines[lo:hi] = np.diff(Lines(words).first)
            hit = np.flatnonzero(np.asarray(marks.is_valid()))
            if len(hit):
                texts = column.to_pylist()
                for k in hit:
                    texts[k], n_lines[k], n_gone[k] = cut_text(raw[offsets[k]:offsets[k + 1]].tobytes(), marks[int(k)].as_py(), lines, min_words, passages)
                column = pa.array(texts, type=column.type)
            columns = list(batch.columns[:-1])
            columns[at] = column
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_gone)], names=names)

    return joined.mapInArrow(cut, schema)

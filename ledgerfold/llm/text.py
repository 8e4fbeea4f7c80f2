"""Array-at-a-time tokenising and hashing of Arrow text columns.

A batch of texts is one byte buffer.  Words, word numbers and 64-bit word
hashes of the whole buffer come from a few array operations, so no Python
object is made per word.  Texts are taken whole; a batch is cut between texts
only, into pieces of about ``CHUNK`` bytes, to keep temporary arrays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20260)).integers(1, 1 << 64, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(skip) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(skip)] = False
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: ``[^\x20\x09-\x0D]+``.
NONSPACE = _class([0x20, *range(0x09, 0x0E)])
#: Letters: a-z after lower-casing, and every non-ASCII character.
LETTER = _class([*range(0x00, 0x61), *range(0x7B, 0x80)])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INV)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i (mod 2^64) for i < n."""
    size = 1 << max(21, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of some texts that lie one after the other in ``data``.

    ``starts``/``ends`` are byte positions, ``first[d]:first[d+1]`` are the
    words of text ``d`` and ``hashes`` their 64-bit hashes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool = True):
        self.raw, self.offsets = raw, offsets
        self.data = LOWER[raw] if lower else raw
        inside = word[self.data]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(raw), dtype=bool)
        before[:1] = False
        np.logical_not(inside[:-1], out=before[1:])
        before[1:] |= edge[1:-1]
        if len(raw):
            before[0] = True
        after = np.empty(len(raw), dtype=bool)
        after[-1:] = True
        after[:-1] = ~inside[1:]
        after[:-1] |= edge[1:-1]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "replace")

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    if not len(column):
        return raw[:0], np.zeros(1, dtype=np.int64)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, word: np.ndarray, lower: bool = True, limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """Yield (from row, to row, words) over a text column, whole texts at a time."""
    raw, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, n)
        lo, hi = offsets[row], offsets[stop]
        yield row, stop, Words(raw[lo:hi], offsets[row:stop + 1] - lo, word, lower)
        row = stop


def runs_hash(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the word sequences ``start:stop`` from one running sum."""
    up, down = powers(len(hashes) + 1)
    values = hashes if not seed else mix(hashes ^ np.uint64(seed))
    sums = np.empty(len(hashes) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words, equal to those of :class:`Words`."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    encoded = [w.encode() for w in words]
    raw = np.frombuffer(b"".join(encoded), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])])
    return Words(raw, offsets, np.ones(256, dtype=bool)).hashes


def as_long(x: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark longs."""
    return pa.array(x.view(np.int64))

"""Columnar text helpers that run inside Spark tasks, on one Arrow batch at a time.

A batch is cut into chunks of about ``CHUNK_BYTES`` of UTF-8 (a longer document is a chunk of its own). Bytes and words are hashed
in blocks, so that the numpy temporaries stay small whatever the length of a text: what grows with a long text is a few numbers
for each of its words. All word and window hashes are 64 bit and depend on the words alone, never on the partition, the chunk,
the block or the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
#: Bytes or words that are hashed at a time.
BLOCK = 1 << 18

#: Fixed odd multipliers of the polynomial hashes (64 bit).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64. The kept tables never grow beyond what a block needs."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def _table(self, base: int, n: int) -> np.ndarray:
        row = np.full(n, base, U64)
        row[0] = 1
        return np.cumprod(row)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > BLOCK + 1:  # a single very long word or span
            return self._table(self.base, n), self._table(self.inverse, n)
        if len(self.up) < n:
            self.up, self.down = self._table(self.base, BLOCK + 1), self._table(self.inverse, BLOCK + 1)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of a chunk of documents: byte ranges, the document (row of the chunk) and the first word of each."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # n_docs + 1

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def _range_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers, offset: int) -> np.ndarray:
    """The polynomial value of each range of values. Ranges come in order of their start."""
    out = np.zeros(len(start), U64)
    i = 0
    while i < len(start):
        origin = int(start[i])
        stop = max(i + 1, int(np.searchsorted(start, origin + BLOCK - 128)))
        while stop > i + 1 and int(end[stop - 1]) - origin > BLOCK:
            stop = i + (stop - i) // 2
        a, b = start[i:stop] - origin, end[i:stop] - origin
        n = int(b.max())
        up, down = powers.to(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((values[origin : origin + n].astype(U64) + U64(offset)) * up[:n], out=sums[1:])
        out[i:stop] = (sums[b] - sums[a]) * down[a]
        i = stop
    return out


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges come in order."""
    return mix(_range_sums(data, start, end, _BYTES, 1) ^ (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows that hold about ``limit`` bytes."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n, row + 50_000)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of word bytes, never across documents."""
    n = len(data)
    inside = is_word[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    before[cut] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    return Words(data, offsets, start, end, doc, first)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes (also across documents: see ``inside_document``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    start = np.arange(n)
    return mix(_range_sums(words, start, start + k, _WORDS, 0) + U64(k))


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of word hashes; the ranges come in order."""
    return mix(_range_sums(words, start, end, _WORDS, 0) + (end - start).astype(U64))


def inside_document(doc: np.ndarray, k: int) -> np.ndarray:
    """For each run of k consecutive words, whether it lies in one document."""
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    if len(x) < w:
        return x[:0]
    size, low = 1, x
    while size * 2 <= w:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < w:
        gap = w - size
        low = np.minimum(low[: len(low) - gap], low[gap:])
    return low


#: Low bits that carry a position in a winnowing key.
POSITION_BITS = 26


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """For each run of w gram hashes, the position of the smallest, the leftmost of equals. Long inputs go in overlapping parts."""
    part = (1 << POSITION_BITS) - w
    found = []
    for at in range(0, max(len(grams) - w + 1, 1), part):
        own = grams[at : at + part + w - 1]
        key = (own >> U64(POSITION_BITS) << U64(POSITION_BITS)) | np.arange(len(own), dtype=U64)
        found.append((sliding_min(key, w) & U64((1 << POSITION_BITS) - 1)).astype(np.int64) + at)
    return np.concatenate(found)


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + lengths, n), -1)
    return np.cumsum(marks[:-1]) > 0


def sum_by(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + lengths[i] - 1 for all i, in order."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(first - (ends - lengths), lengths)


def long_column(x) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int64))

"""Tokenising Arrow string columns with numpy, many documents at a time.

A column arrives as one byte buffer with offsets; words, lines and n-grams are found over the whole
buffer at once, never across a document's edge. Everything is identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15

#: The ASCII white space of `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but digits and letters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCTUATION[_a:_b] = False
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the multiplier modulo 2**64; the table grows to the longest word seen."""
    global _powers
    while len(_powers) < n:
        step = U64(pow(_MULTIPLIER, len(_powers), 2**64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Buffers:
    """Consecutive rows of a text column: bytes, offsets of the rows, and the first row's number."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def buffers(column: pa.Array, limit: int = 2 << 20) -> Iterator[Buffers]:
    """Cuts a string column (null: empty) into runs of rows of about ``limit`` bytes; a longer row stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield Buffers(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    """Maximal runs of non-separator bytes: where they are, whose they are, and what they hash to."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)


def words(part: Buffers, separators: np.ndarray, fold: bool = False) -> Words:
    data = FOLD[part.data] if fold else part.data
    inside = ~separators[data]
    n = len(data)
    if not n or not inside.any():
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, U64))
    edge = np.zeros(n + 1, bool)
    edge[part.offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    value = (data[inside].astype(U64) + U64(1)) * powers(int(length.max()))[place]
    hashed = mix(np.add.reduceat(value, first) ^ (length.astype(U64) << U64(40)))
    row = np.searchsorted(part.offsets, start, side="right") - 1
    return Words(start, end, row, hashed)


def ngrams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of every n consecutive words of one row."""
    if len(found.hash) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    many = len(found.hash) - n + 1
    total = np.zeros(many, U64)
    for j in range(n):
        total = (total * U64(_MULTIPLIER)) + found.hash[j : j + many]
    same = found.row[:many] == found.row[n - 1 :]
    return mix(total[same]), found.row[:many][same]


def within(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes made different for different rows, to find repeats inside a row."""
    return mix(hashes ^ mix(rows.astype(U64) + U64(1)))

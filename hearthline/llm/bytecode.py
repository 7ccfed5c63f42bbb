"""Vectorised work on the UTF-8 bytes of whole Arrow text columns, for functions that run inside tasks.

Texts are taken in chunks of whole rows, so that memory follows the chunk and not the batch. Substrings are
hashed in constant time each: with G[i] = sum of T[byte j] * BASE^j for j < i (modulo 2^64), the substring
[s, e) has (G[e] - G[s]) * BASE^-s, wherever it stands. Words are runs of bytes of a class and never cross rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: one random odd number for each byte
BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE)) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: classes of bytes after lower-casing A-Z
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
WORDY = np.zeros(256, dtype=bool)
WORDY[48:58] = WORDY[97:123] = WORDY[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for name, step in (("up", _BASE), ("down", pow(_BASE, -1, _MASK + 1))):
            out = np.full(n, step, dtype=U64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


class Chunk:
    """Some whole rows: `data` (bytes), `offsets` (rows + 1), `first` (number of the first row in its batch)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.rows = data, offsets, first, len(offsets) - 1

    def lower(self) -> Chunk:
        return Chunk(LOWER[self.data], self.offsets, self.first)

    def sums(self) -> np.ndarray:
        """G, of one more entry than there are bytes."""
        up, _ = powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum(BYTE_CODES[self.data] * up[:len(self.data)], out=out[1:])
        return out

    def words(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each row the number of its first word (rows + 1 entries)."""
        inside = kind[self.data]
        edges = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def pieces(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Well-spread hashes of the substrings [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a text column, nulls as empty texts, in chunks of about `limit` bytes or one row."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield Chunk(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], at)
        at = to


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive entries, order included; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    out = hashes[:len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= U64(_BASE)
        out ^= out >> U64(29)
        out += hashes[i:len(hashes) - n + 1 + i]
    return mix(out ^ U64(n))


def inside_row(first_word: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the sequences of n words, by number of their first word, stay in one row."""
    row_end = np.repeat(first_word[1:], np.diff(first_word))
    return row_end[:max(0, total - n + 1)] >= np.arange(max(0, total - n + 1)) + n


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of every item, from the number of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose row i holds values[first[i]:first[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))

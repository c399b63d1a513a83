"""Words of whole Arrow text columns as numpy arrays: found and hashed on the column's own bytes, without a Python object for each word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is taken alone.
SLICE = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: ASCII characters other than letters and digits; bytes of other scripts count as letters.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in these bytes and their end) for runs of rows of about ``SLICE`` bytes. Nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, at, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def find_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): each word's place in the bytes, and the number of the first word of each row, with the total at the end."""
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = True, True
        before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
        before |= edge[:-1]
        after |= edge[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))


def block_at(wide: np.ndarray, starts: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, or the first ``rest`` of them where that is fewer."""
    x = wide[starts].astype(np.uint64)
    short = np.flatnonzero(rest < 8)
    x[short] &= (np.uint64(1) << (np.uint64(8) * rest[short].astype(np.uint64))) - np.uint64(1)
    return x


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, mixed after each block of eight bytes; words of one length up to eight bytes never share one."""
    wide, n = blocks(data), ends - starts
    h = mix(n.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    live, k = np.flatnonzero(n <= LONG_WORD), 0
    while len(live):
        h[live] = mix(h[live] ^ block_at(wide, starts[live] + k, n[live] - k))
        k += 8
        live = live[n[live] > k]
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def hashed(column, breaks: np.ndarray = SPACES, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row and the total) for runs of rows."""
    for i, j, data, offsets in slices(column):
        if lower:
            data = LOWER[data]
        starts, ends, first = find_words(data, offsets, breaks)
        yield i, j, hash_words(data, starts, ends), first


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


class Table:
    """A fixed map from 64-bit keys to numbers that is looked up for whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing=0):
        size = 1 << max(4, int(len(keys) * 2.5).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.used = np.zeros(size, np.uint64), np.zeros(size, bool)
        self.values = np.full(size, missing, np.asarray(values).dtype)
        self.missing, taken = missing, np.full(size, -1, np.int64)
        keys, left = np.asarray(keys, np.uint64), np.arange(len(keys))
        at = (mix(keys) & self.mask).astype(np.int64)
        while len(left):
            free = ~self.used[at]
            taken[at[free]] = left[free]  # the last to claim a place gets it
            won = free & (taken[at] == left)
            self.keys[at[won]], self.values[at[won]], self.used[at[won]] = keys[left[won]], values[left[won]], True
            left, at = left[~won], (at[~won] + 1) & int(self.mask)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.missing, self.values.dtype)
        more, at = np.arange(len(keys)), (mix(keys) & self.mask).astype(np.int64)
        while len(more):
            used, hit = self.used[at], self.keys[at] == keys[more]
            hit &= used
            out[more[hit]] = self.values[at[hit]]
            go = used & ~hit
            more, at = more[go], (at[go] + 1) & int(self.mask)
        return out

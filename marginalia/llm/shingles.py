"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

from .words import hashed, mix

_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]


def sets(column, size: int):
    """For runs of rows: (first row, end row, the rows' distinct shingle hashes sorted by row and hash, first of each row and the total).

    A row with fewer than ``size`` words has its whole sequence as one shingle; a row without words has none.
    """
    for i, j, h, first in hashed(column):
        n = np.diff(first)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(j - i), count)
        place = first[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        wide = np.concatenate([h, np.zeros(size, np.uint64)])
        s = np.zeros(len(row), np.uint64)
        for k in range(size):
            inside = k < n[row]
            s = mix(s + np.where(inside, wide[place + k] * _SALTS[k] + np.uint64(k + 1), np.uint64(0)))
        order = np.lexsort((s, row))
        s, row = s[order], row[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        yield i, j, s[fresh], np.searchsorted(row[fresh], np.arange(j - i + 1))

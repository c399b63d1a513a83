"""Arrow batches in portions of a bounded size, so that what a Python worker holds doesn't depend on how long the rows of a batch are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a portion, about; a longer text is a portion of its own.
PORTION = 1 << 20


def portions(texts: pa.Array, size: int = PORTION) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows with about ``size`` bytes of text at most, of one row at least."""
    ends = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield i, j
        i = j

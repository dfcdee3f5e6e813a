"""Arrow batches in pieces, for functions that make Python objects of their rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(column: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of pieces of at most so many rows and so many bytes of the column, a row at least."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        upto = min(max(int(np.searchsorted(ends, before + size, "right")), at + 1), at + rows)
        upto = min(upto, len(column))
        yield at, upto - at
        at = upto

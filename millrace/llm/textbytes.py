"""Texts of an Arrow batch as one byte array, and the words in it, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about this many bytes, so memory doesn't follow the batch.
RUN_BYTES = 1 << 21
RUN_ROWS = 512


def text_runs(column: pa.Array, most: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of at most so many rows; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
        last = min(last, n, first + most)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lower-cased and each run of white space made one space: (bytes, word starts, word ends, words before each row).

    The words of row i are those from index before[i] to before[i + 1]; what lies between two words
    of a row is exactly one space, so any run of words is a slice of the bytes.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    space = _SPACES[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    after_space = np.empty(len(data), bool)
    after_space[0], after_space[1:] = True, space[:-1]
    after_space |= first
    kept = np.flatnonzero(~(space & after_space))
    low = _LOWER[data[kept]]
    gap = space[kept]
    low[gap] = 0x20
    start = np.flatnonzero(~gap & after_space[kept])
    last = np.empty(len(kept), bool)
    last[-1:] = True
    last[:-1] = gap[1:] | first[kept[1:]] | after_space[kept[1:]]
    end = np.flatnonzero(~gap & last) + 1
    before = np.searchsorted(kept[start], offsets, "left")
    return low, start, end, before

"""Arrow batches in pieces of bounded bytes, and memory given back after a task: what Python holds follows from these bounds, not from the rows of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a piece of a batch holds; a longer row is a piece by itself.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices, in order, each of at most so many bytes of this string or binary column, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives what its task freed back to the system: a worker waits for its next task with little memory."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped

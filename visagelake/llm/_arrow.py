"""Arrow batches in slices of bounded size."""

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return memory that is not in use to the system, where the C library can: workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds at most so many bytes or elements, of one row at least. Memory that earlier
    slices left unused goes back to the system, as workers outlive their stage."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    total = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(total):
        upto = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, upto - at)
        at, before = upto, int(total[upto - 1])
    give_back()

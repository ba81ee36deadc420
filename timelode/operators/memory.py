"""What a Python worker holds: batches bounded in bytes, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def give_back() -> None:
    """A worker outlives its task and waits for the next one beside others: memory that it has no
    more use for, of Arrow and of the C library's heap (NumPy's arrays), goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes in the column ``text``; a longer text is a
    run of its own. A batch is counted in rows, so its texts as Python's strings have no bound."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end

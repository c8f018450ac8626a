"""Bounded slices of Arrow batches, and memory given back at the end of a task."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text handled at a time inside one Arrow batch; bounds a worker's memory.
SLICE_CHARS = 500_000


def release() -> None:
    """Gives memory that a task freed back to the system: workers live on for other tasks, and the allocator would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # an allocator without it
        pass


def lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """Consecutive runs of a string array as Python strings, each of about ``most`` characters."""
    for start, end in runs(lengths(texts), most):
        yield texts.slice(start, end - start).to_pylist()


def runs(lengths: np.ndarray, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive runs of lengths that sum to ``most`` at most; a longer one is a run of its own."""
    start, total = 0, len(lengths)
    while start < total:
        end, size = start, 0
        while end < total and (end == start or size + lengths[end] <= most):
            size += int(lengths[end])
            end += 1
        yield start, end
        start = end

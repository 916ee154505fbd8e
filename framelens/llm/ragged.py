"""Arrow columns of lists and bytes as joined values and offsets, and blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of the joined values begins, and the end."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def spread(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs of these sizes, one run after another."""
    return np.repeat(places - starts(sizes)[:-1], sizes) + np.arange(sizes.sum())


def binaries(offsets: np.ndarray, data: bytes | np.ndarray | memoryview) -> pa.LargeBinaryArray:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def raw(values: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """Offsets of the values and their joined bytes."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return ends - ends[0], memoryview(data or b"").cast("B")[ends[0] : ends[-1]]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of lists (null: empty) one after another, and where those of each row begin, and the end."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), starts(sizes)


def blocks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about ``size`` bytes of a column of texts at a time."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = held[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(held, before + size, "right")))
        yield batch.slice(start, end - start)
        start = end

"""Arrow text columns as flat bytes, for kernels that work on whole batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel gets at once, about; a longer text comes alone.
SLICE_BYTES = 4 << 20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other, and where each begins (and, last, where all end). The column has no nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of consecutive rows with about ``limit`` bytes of text in ``column``, and one row at least."""
    for batch in batches:
        at = flat(batch[column])[1]
        row = 0
        while row < batch.num_rows:
            after = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, after - row)
            row = after

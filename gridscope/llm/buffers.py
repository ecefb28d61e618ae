"""Texts of Arrow batches as one byte buffer, for work by numpy on whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a Python task works on at once; a longer text is one piece by itself.
PIECE_BYTES = 2_000_000


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(places, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    found = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    if column.null_count:
        # A null may still span bytes; Arrow allows it.
        sizes = np.diff(offsets)
        empty = column.is_null().to_numpy(zero_copy_only=False)
        found = found[np.repeat(~empty, sizes)]
        offsets = np.concatenate([[0], np.cumsum(np.where(empty, 0, sizes))])
    return found, offsets


def byte_pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of slices of batches whose texts (the last column) take up to limit bytes.

    A longer text is a slice by itself.
    """
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.num_columns - 1))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def text_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from bytes and offsets."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())

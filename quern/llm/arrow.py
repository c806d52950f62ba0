"""Helpers for operators that run over Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time, whatever the batch.
PIECE_BYTES = 1_000_000


_held: dict = {}


def kept(key: tuple, make: Callable):
    """What make gives, kept by the Python worker for later batches and tasks; a worker keeps one such thing, that of the operator at work."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of the string column, of one row at least."""
    n = batch.num_rows
    if not n:
        return
    offsets = string_offsets(batch.column(column))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def string_offsets(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = array.buffers()[1]
    if raw is None or not len(array):
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(raw, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array and the offsets of its rows in them; a null has no bytes."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    offsets = string_offsets(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def over_pieces(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: int, most: int = PIECE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, called with a slice of bounded size at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, most):
                yield fn(piece)

    return run


def lists(values: np.ndarray, counts: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)

"""Small helpers for functions that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


#: Rows of a batch whose texts are Python objects at one time.
SLICE = 256


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, a slice of its rows at a time."""
    for start in range(0, len(column), SLICE):
        yield from column.slice(start, SLICE).cast(pa.large_binary()).to_pylist()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal non-null integer keys, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            key = tuple(int(c[start]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Rows of a binary column of equal width as a matrix."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, 0), dtype=dtype)
    return np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1)

"""Reading vector columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    found, triangle = np.linalg.qr(np.random.default_rng([seed, size]).normal(size=(size, size)))
    return found * np.sign(np.diag(triangle))


def usable(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Position and components of every vector that is not null, zero, empty or partly undefined."""
    for i, row in enumerate(column.to_pylist()):
        if not row or any(x is None for x in row):
            continue
        values = np.array(row, dtype=np.float64)
        if np.isfinite(values).all() and values.any():
            yield i, values + 0.0  # no negative zero


def parsed(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, vec) per row; dim and vec (little-endian doubles) are null for unusable vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims: list = [None] * batch.num_rows
            raw: list = [None] * batch.num_rows
            for i, values in usable(batch.column(1)):
                dims[i], raw[i] = len(values), values.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, type=pa.int32()), pa.array(raw, type=pa.binary())],
                names=["id", "dim", "vec"],
            )

    rows = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("v"))
    return rows.mapInArrow(task, "id long, dim int, vec binary")


def fixed(column: Column) -> Column:
    """A key of a vector's bytes that equal vectors share and no others (128 bits)."""
    return F.md5(column)

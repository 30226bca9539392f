"""Normal equations and their solution.

Two forms of the per-entity system (A, v, n):

* wide: scalar columns ``a{i}_{j}`` (i <= j) and ``v{i}``. The sums run inside
  whole-stage codegen with map-side combine. Used up to ``EXPR_MAX_RANK``.
* packed: ``a ARRAY<DOUBLE>`` (row-major k*k) and ``v ARRAY<DOUBLE>``, built from
  Arrow batches. Used above it, where generated code would get too large.

The kernels below see one Arrow batch at a time and never hold a whole group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest rank for which ``kernel="auto"`` takes the wide form.
EXPR_MAX_RANK = 12
KERNELS = ("auto", "sums", "batches")
FACTOR_SCHEMA = "id int, features array<double>"
COUNTED_SCHEMA = f"{FACTOR_SCHEMA}, n bigint"
_OUTER_DOUBLES = 8_000_000  # bound on the temporary of one Gram step (64 MB)


def uses_batches(kernel: str, rank: int) -> bool:
    """Whether systems are built from Arrow batches: asked for, or by rank under ``auto``."""
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {KERNELS}, got {kernel!r}")
    return kernel == "batches" or (kernel == "auto" and rank > EXPR_MAX_RANK)


def gram_names(rank: int) -> list[str]:
    return [f"a{i}_{j}" for i in range(rank) for j in range(i, rank)]


def rhs_names(rank: int) -> list[str]:
    return [f"v{i}" for i in range(rank)]


def sum_systems(joined: DataFrame, keys: list[str], rank: int) -> DataFrame:
    """count, sum(f_i * f_j) for i <= j and sum(f_i * rating) per key.

    A row with a ``weight`` stands for that many ratings of one pair, whose sum
    is ``rating``. One SQL text is analysed much faster than a column at a time.
    """
    weighted = "weight" in joined.columns
    w = "weight * " if weighted else ""
    sums = ["sum(weight) as n" if weighted else "count(1) as n"]
    for i in range(rank):
        sums += [f"sum({w}f{i} * f{j}) as a{i}_{j}" for j in range(i, rank)]
    sums += [f"sum(f{i} * rating) as v{i}" for i in range(rank)]
    return _grouped(joined, keys, sums)


def merge_systems(partials: DataFrame, rank: int) -> DataFrame:
    """Add up partial systems of one entity."""
    names = ["n", *gram_names(rank), *rhs_names(rank)]
    return _grouped(partials, ["id"], [f"sum({c}) as {c}" for c in names])


def _grouped(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    by = ", ".join(keys)
    text = f"select {by}, {', '.join(sums)} from {{rows}} group by {by}"
    return rows.sparkSession.sql(text, rows=rows)


def packed_schema() -> str:
    return "id int, n bigint, a array<double>, v array<double>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _list_array(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))


def _run_starts(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])


# --- batch kernels: generators over Arrow batches ------------------------------


def _gram_batches(batches, rank: int):
    """(id, weight, rating, features) rows -> packed partial systems per batch and id."""
    step = max(1, _OUTER_DOUBLES // (rank * rank))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            x = _matrix(part.column("features"), rank)
            r = part.column("rating").to_numpy(zero_copy_only=False)
            w = part.column("weight").to_numpy(zero_copy_only=False)
            starts = _run_starts(ids)
            a = np.add.reduceat((w[:, None] * x)[:, :, None] * x[:, None, :], starts, axis=0)
            v = np.add.reduceat(x * r[:, None], starts, axis=0)
            n = np.add.reduceat(w, starts)
            yield _packed(ids[starts], n, a.reshape(len(starts), rank * rank), v)


def _merge_batches(batches, rank: int):
    """Add up runs of the same id; a batch and one open id is all that is held."""
    open_run = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        a = _matrix(batch.column("a"), rank * rank)
        v = _matrix(batch.column("v"), rank)
        if open_run is not None:
            ids = np.r_[open_run[0], ids]
            n = np.r_[open_run[1], n]
            a = np.vstack([open_run[2], a])
            v = np.vstack([open_run[3], v])
        if (ids[1:] < ids[:-1]).any():
            raise ValueError("rows of the batch kernels must be sorted by id")
        starts = _run_starts(ids)
        ids = ids[starts]
        n = np.add.reduceat(n, starts)
        a = np.add.reduceat(a, starts, axis=0)
        v = np.add.reduceat(v, starts, axis=0)
        open_run = (ids[-1:], n[-1:], a[-1:], v[-1:])
        if len(ids) > 1:
            yield _packed(ids[:-1], n[:-1], a[:-1], v[:-1])
    if open_run is not None:
        yield _packed(*open_run)


def _solve_batches(batches, rank: int, reg: float, packed: bool, counts: bool = False):
    """x = (A + reg * n * I)^-1 v for all entities of a batch at once; with ``counts``, n too."""
    upper = np.triu_indices(rank)
    diagonal = np.arange(rank)
    for batch in batches:
        m = batch.num_rows
        if m == 0:
            continue
        n = batch.column("n").to_numpy(zero_copy_only=False)
        if packed:
            a = _matrix(batch.column("a"), rank * rank).reshape(m, rank, rank).copy()
            v = _matrix(batch.column("v"), rank)
        else:
            a = np.empty((m, rank, rank))
            for name, i, j in zip(gram_names(rank), *upper):
                a[:, i, j] = batch.column(name).to_numpy(zero_copy_only=False)
                a[:, j, i] = a[:, i, j]
            v = np.column_stack(
                [batch.column(c).to_numpy(zero_copy_only=False) for c in rhs_names(rank)]
            )
        a[:, diagonal, diagonal] += reg * n[:, None]
        try:
            x = np.linalg.solve(a, v[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError as exc:
            raise ValueError("singular system: use reg > 0") from exc
        columns = {"id": batch.column("id"), "features": _list_array(x)}
        if counts:
            columns["n"] = batch.column("n").cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _packed(ids, n, a, v):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array(n, pa.int64()), _list_array(a), _list_array(v)],
        ["id", "n", "a", "v"],
    )


# --- the same as DataFrame steps -----------------------------------------------


def _gram_input(joined: DataFrame) -> DataFrame:
    weight = F.col("weight") if "weight" in joined.columns else F.lit(1).cast("bigint")
    return joined.select(
        "id", weight.alias("weight"), F.col("rating").cast("double").alias("rating"), "features"
    )


def packed_systems(joined: DataFrame, rank: int, merge_over: int | None) -> DataFrame:
    """Packed systems of joined rows that are sorted by id within partitions.

    Without ``merge_over`` all rows of an id must be in one partition. With it,
    partial systems are brought together over that many partitions.
    """
    rows = _gram_input(joined)
    partials = rows.mapInArrow(
        lambda batches: _merge_batches(_gram_batches(batches, rank), rank), packed_schema()
    )
    if merge_over is None:
        return partials
    placed = partials.repartition(merge_over, "id").sortWithinPartitions("id")
    return placed.mapInArrow(lambda batches: _merge_batches(batches, rank), packed_schema())


def solve_joined(joined: DataFrame, rank: int, reg: float, counts: bool = False) -> DataFrame:
    """Systems and solution in one pass, for rows as in ``packed_systems``."""

    def kernel(batches):
        systems = _merge_batches(_gram_batches(batches, rank), rank)
        return _solve_batches(systems, rank, reg, True, counts)

    return _gram_input(joined).mapInArrow(kernel, COUNTED_SCHEMA if counts else FACTOR_SCHEMA)


def solve_factors(systems: DataFrame, rank: int, reg: float, counts: bool = False) -> DataFrame:
    """x = (A + reg * n * I)^-1 v for every entity; with ``counts``, its number of ratings n too."""
    packed = "a" in systems.columns
    return systems.mapInArrow(
        lambda batches: _solve_batches(batches, rank, reg, packed, counts), COUNTED_SCHEMA if counts else FACTOR_SCHEMA
    )

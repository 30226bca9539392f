"""Half-steps by conjugate gradients: an entity's system is multiplied, never formed.

A step multiplies every entity's matrix F'F + reg * n * I with its search direction p as the sum
of f * (f . p) over its ratings, so ``rank`` numbers per entity (and part or block) cross the
network where a formed system has ``rank * rank``. As with formed systems, the sums run inside generated
code up to ``linalg.EXPR_MAX_RANK`` and over Arrow batches above it. The ratings and their layout stay where they
are: directions are sent to them, partial products come back, and no joined row moves.

The state of a step is a table; an entity whose residual is small enough stays in the table of
that step and its ratings are not multiplied again. In exact arithmetic ``rank`` steps solve a system;
with a start near the solution, such as the factors of the iteration before, a few do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.functions.columns import block_of, dot_columns, features_to_columns
from ridgeline.functions.linalg import EXPR_MAX_RANK, _OUTER_DOUBLES, _list_array, _matrix, _run_starts
from ridgeline.operators import skew
from ridgeline.operators.layout import Layout, block_partitioning, build_layout
from ridgeline.operators.quality import checked_ratings

#: Residual, relative to the right side, at which an entity is solved.
TOLERANCE = 1e-10
STATE_SCHEMA = (
    "id int, n bigint, x array<double>, residual array<double>, direction array<double>, square double, goal double"
)
_PRODUCT_SCHEMA = "id int, n bigint, product array<double>"


def _products(batches, rank: int, first: bool):
    """Sums over runs of one id: f * (f . p), or at first f * (r - f . p) next to f * r."""
    step = max(1, _OUTER_DOUBLES // rank)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            x = _matrix(part.column("features"), rank)
            w = part.column("weight").to_numpy(zero_copy_only=False)
            dots = np.einsum("ij,ij->i", x, _matrix(part.column("direction"), rank)) * w
            if first:
                r = part.column("rating").to_numpy(zero_copy_only=False)
                values = np.hstack([x * (r - dots)[:, None], x * r[:, None]])
            else:
                values = x * dots[:, None]
            starts = _run_starts(ids)
            yield ids[starts], np.add.reduceat(w, starts), np.add.reduceat(values, starts, axis=0)


def _product_batches(batches, rank: int, first: bool):
    """One row per id and run of batches; the last id of a batch waits for the next."""
    held = None
    for ids, n, values in _products(batches, rank, first):
        if held is not None:
            ids, n, values = np.r_[held[0], ids], np.r_[held[1], n], np.vstack([held[2], values])
            starts = _run_starts(ids)
            ids, n, values = ids[starts], np.add.reduceat(n, starts), np.add.reduceat(values, starts, axis=0)
        held = ids[-1:], n[-1:], values[-1:]
        if len(ids) > 1:
            yield _product_batch(ids[:-1], n[:-1], values[:-1])
    if held is not None:
        yield _product_batch(*held)


def _product_batch(ids, n, values):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array(n, pa.int64()), _list_array(values)], ["id", "n", "product"]
    )


def _whole(batches):
    """Add up the products of each id, whose rows follow each other; other columns from its first row."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)  # fields that may be null, as below
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        ids = table.column("id").to_numpy()
        starts = _run_starts(ids)
        products = table.column("product").combine_chunks()
        sums = np.add.reduceat(_matrix(products, len(products.flatten()) // len(products)), starts, axis=0)
        counts = np.add.reduceat(table.column("n").to_numpy(), starts)
        table = table.take(pa.array(starts))
        for name, values in (("n", pa.array(counts, pa.int64())), ("product", _list_array(sums))):
            table = table.set_column(table.schema.get_field_index(name), name, values)
        (last,) = table.slice(table.num_rows - 1).combine_chunks().to_batches()
        held = last
        yield from table.slice(0, table.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield held


def _state(ids, n, x, residual, direction, square, goal):
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), *[_list_array(m) for m in (x, residual, direction)], pa.array(square), pa.array(goal)],
        ["id", "n", "x", "residual", "direction", "square", "goal"],
    )


def _first_states(batches, rank: int, reg: float, tolerance: float):
    for batch in _whole(batches):
        n = batch.column("n").to_numpy(zero_copy_only=False)
        found = _matrix(batch.column("product"), 2 * rank)
        x = _matrix(batch.column("direction"), rank)
        residual = found[:, :rank] - reg * n[:, None] * x
        goal = tolerance**2 * np.square(found[:, rank:]).sum(axis=1)
        yield _state(batch.column("id"), n, x, residual, residual, np.square(residual).sum(axis=1), goal)


def _next_states(batches, rank: int, reg: float):
    for batch in _whole(batches):
        n = batch.column("n").to_numpy(zero_copy_only=False)
        x, residual, p = (_matrix(batch.column(c), rank) for c in ("x", "residual", "direction"))
        square = batch.column("square").to_numpy(zero_copy_only=False)
        product = _matrix(batch.column("product"), rank) + reg * n[:, None] * p
        length = (square / np.einsum("ij,ij->i", p, product))[:, None]
        x, residual = x + length * p, residual - length * product
        after = np.square(residual).sum(axis=1)
        p = residual + (after / square)[:, None] * p
        yield _state(batch.column("id"), n, x, residual, p, after, batch.column("goal").to_numpy(zero_copy_only=False))


def _sent(layout: Layout, directions: DataFrame) -> tuple[DataFrame, list[str]]:
    """Directions (id, direction) where the ratings of their ids are, and the keys to meet them by."""
    if layout.strategy == "blocks":
        home = F.col("id").cast("bigint")
        if layout.hot is not None:
            parts = F.least(F.coalesce(F.col("parts"), F.lit(1)), F.lit(layout.partitions))  # one copy a block
            directions = directions.join(layout.hot, "id", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
            home = home + F.col("part")
        directions = directions.withColumn("block", block_of(home, layout.partitions).cast("int"))
        sent = directions.select("block", "id", "direction").repartitionById(layout.partitions, F.col("block"))
    else:
        if layout.hot is not None:
            directions = skew.replicate(directions, layout.hot, "id", "part")
        sent = directions.repartition(layout.partitions, *layout.group_keys)
    return sent.hint("merge"), layout.group_keys


def _summed(joined: DataFrame, keys: list[str], rank: int, first: bool) -> DataFrame:
    """What ``_product_batches`` adds up, as plain sums per key inside generated code."""
    vectors = [*features_to_columns("features", rank, "f"), *features_to_columns("direction", rank, "p")]
    rows = joined.select(*dict.fromkeys([*keys, "id"]), "weight", "rating", *vectors)
    rows = rows.withColumn("dot", dot_columns("f", "p", rank) * F.col("weight"))
    factor = "(rating - dot)" if first else "dot"
    terms = [f"f{q} * {factor}" for q in range(rank)] + [f"f{q} * rating" for q in range(rank if first else 0)]
    sums = rows.groupBy(*keys).agg(F.sum("weight").alias("n"), *[F.expr(f"sum({x})").alias(f"s{q}") for q, x in enumerate(terms)])
    return sums.select("id", "n", F.array(*[f"s{q}" for q in range(len(terms))]).alias("product"))


def products(layout: Layout, factors: DataFrame, directions: DataFrame | None, rank: int, first: bool) -> DataFrame:
    """(id, n, product) partial products per id and task, for the ids that have a direction.

    At first every id is multiplied, with zeros where there is no direction.
    """
    joined = layout.joined(factors, rank)
    zeros = F.array_repeat(F.lit(0.0), rank)
    if directions is None:
        joined = joined.withColumn("direction", zeros)
    else:
        sent, keys = _sent(layout, directions)
        joined = joined.join(sent, keys, "left" if first else "inner")
        if first:
            joined = joined.withColumn("direction", F.coalesce("direction", zeros))
    weight = F.col("weight") if "weight" in joined.columns else F.lit(1)
    values = {"weight": weight.cast("bigint"), "rating": F.col("rating").cast("double")}
    if rank <= EXPR_MAX_RANK:
        return _summed(joined.withColumns(values), layout.group_keys, rank, first)
    rows = joined.withColumns(values).sortWithinPartitions("id").select("id", "weight", "rating", "features", "direction")
    return rows.mapInArrow(lambda batches: _product_batches(batches, rank, first), _PRODUCT_SCHEMA)


def solve(
    layout: Layout,
    factors: DataFrame,
    rank: int,
    reg: float,
    path: str,
    start: DataFrame | None = None,
    steps: int | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(id, features, n) of the layout's side for fixed counterpart ``factors``.

    ``start`` (id, features) is where the search begins, zero for ids that it lacks. It ends for an
    entity when its residual is at most ``tolerance`` times its right side, and for all after
    ``steps`` (twice the rank by default). The result reads the tables of the steps in ``path``.
    """
    if layout.strategy == "shuffle" or not layout.batches:
        raise ValueError("conjugate gradients need a layout of batches by entity or block")
    if steps is not None and steps < 1:
        raise ValueError("steps must be at least 1")
    spark = factors.sparkSession
    most = 2 * rank if steps is None else steps

    def by_id(rows: DataFrame) -> DataFrame:  # a fixed number: adaptive execution must not cut an id's rows apart
        return rows.repartition(layout.partitions, "id")

    def kept(state: DataFrame, step: int) -> tuple[DataFrame, int]:
        seen = Observation()
        open_ = F.coalesce(F.sum((F.col("square") > F.col("goal")).cast("int")), F.lit(0)).alias("open")
        table = workdir.write_table(state.observe(seen, open_), f"{path}/step={step}")
        return table, seen.get["open"]

    begin = None if start is None else start.select("id", F.col("features").alias("direction"))
    with block_partitioning(spark):
        found = by_id(products(layout, factors, begin, rank, first=True))
        if begin is None:
            found = found.withColumn("direction", F.array_repeat(F.lit(0.0), rank))
        else:
            found = found.hint("merge").join(by_id(begin), "id", "left").withColumn(
                "direction", F.coalesce("direction", F.array_repeat(F.lit(0.0), rank))
            )
        first = found.sortWithinPartitions("id").mapInArrow(
            lambda batches: _first_states(batches, rank, reg, tolerance), STATE_SCHEMA
        )
        state, open_ = kept(first, 0)
        step = 0
        while open_ and step < most:
            step += 1
            searching = state.where("square > goal")
            found = by_id(products(layout, factors, searching.select("id", "direction"), rank, first=False))
            both = found.hint("merge").join(by_id(searching.drop("n")), "id").sortWithinPartitions("id")
            state, open_ = kept(both.mapInArrow(lambda batches: _next_states(batches, rank, reg), STATE_SCHEMA), step)
    states = spark.read.schema(STATE_SCHEMA + ", step int").parquet(path)
    return states.where((F.col("square") <= F.col("goal")) | (F.col("step") == step)).select(
        "id", F.col("x").alias("features"), "n"
    )


def half_step(
    ratings: DataFrame,
    factors: DataFrame,
    side: str,
    rank: int,
    reg: float,
    strategy: str = "auto",
    num_blocks: int | None = None,
    start: DataFrame | None = None,
    steps: int | None = None,
    tolerance: float = TOLERANCE,
    **options,
) -> DataFrame:
    """One half-step: new factors of ``side`` for fixed counterpart ``factors``, without their systems."""
    layout = build_layout(checked_ratings(ratings), side, rank, strategy, num_blocks, kernel="batches", **options).persist()
    try:
        path = workdir.new_run_dir(ratings.sparkSession, "gradient")
        return solve(layout, factors, rank, reg, path, start, steps, tolerance).select("id", "features")
    finally:
        layout.unpersist()

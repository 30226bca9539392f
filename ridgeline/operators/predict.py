"""Pair predictions, the dense prediction matrix and top-k recommendations.

Predicting every cell is inherently |users| x |items| work. It is done as
matrix products of bounded tiles inside Arrow batches:

* item factors under the size limit are broadcast once as a matrix, users
  stream past it, and nothing else moves;
* above it, users and items meet in a grid of (user block, item block) cells of
  fixed size. A task has a rectangle of cells: its items are as many as ``GRID_BYTES``
  hold, its users stream past them. So a user vector is sent once per that many items,
  and an item vector once per task of its column, however small the cells are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.linalg import _list_array, _matrix
from ridgeline.operators.evaluate import predicted_pairs
from ridgeline.operators.index import dense_index
from ridgeline.operators.prune import SCHEMA as FOUND
from ridgeline.operators.prune import finder, recommend_pruned

BROADCAST_LIMIT = 64 << 20
TILE_CELLS = 2_000_000
CELLS_PER_TASK = 50_000_000
USER_BLOCK = 1024
ITEM_BLOCK = 4096
#: Ids and vectors of the items that one task of the grid holds.
GRID_BYTES = 32 << 20
TASKS_PER_CORE = 4
USERS_PER_SEARCH = 16_384


def predict_pairs(model, pairs: DataFrame, cold_start: str = "nan", **options) -> DataFrame:
    """Predictions for given (user_id, item_id) pairs.

    A pair with an id that has no vector gets NaN, or is left out with
    ``cold_start='drop'``.
    """
    if cold_start not in ("nan", "drop"):
        raise ValueError(f"cold_start must be 'nan' or 'drop', got {cold_start!r}")
    how = "left" if cold_start == "nan" else "inner"
    found = predicted_pairs(pairs, model.user_factors, model.item_factors, model.rank, how, **options)
    if cold_start == "nan":
        found = found.withColumn("prediction", F.coalesce("prediction", F.lit(float("nan"))))
    return found


def unrated_pairs(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Those of the given cells that hold no rating."""
    return pairs.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def rated_pairs(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Those of the given cells that hold a rating."""
    return pairs.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")


def unrated_counts(ratings: DataFrame) -> DataFrame:
    """Per user the number of empty cells: (user_id, rated, unrated), no cell listed."""
    per_user = (
        ratings.groupBy("user_id", "item_id")
        .agg(F.lit(1).alias("seen"))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("rated"))
    )
    items = ratings.agg(F.countDistinct("item_id")).first()[0]
    return per_user.select("user_id", "rated", (F.lit(items) - F.col("rated")).alias("unrated"))


# --- kernels -----------------------------------------------------------------


def _tiles(rows: int, width: int):
    step = max(1, TILE_CELLS // max(width, 1))
    return ((start, min(start + step, rows)) for start in range(0, rows, step))


def _long_rows(user_ids, item_ids, scores):
    users, items = scores.shape
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(user_ids, items), pa.int32()),
            pa.array(np.tile(item_ids, users), pa.int32()),
            pa.array(scores.ravel()),
        ],
        ["user_id", "item_id", "prediction"],
    )


def _wide_rows(user_ids, block, scores):
    return pa.RecordBatch.from_arrays(
        [
            pa.array(user_ids, pa.int32()),
            pa.array(np.full(len(user_ids), block), pa.int32()),
            _list_array(scores),
        ],
        ["user_id", "item_block", "predictions"],
    )


def _best(user_ids, item_ids, scores, k):
    """Exact k best per row, ties to the lower item id; -inf marks excluded cells.

    ``item_ids`` are ascending, so a stable sort breaks ties by id.
    """
    items = scores.shape[1]
    if k < items:
        threshold = np.partition(scores, items - k, axis=1)[:, items - k]
        row, col = np.nonzero((scores >= threshold[:, None]) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    value = scores[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, row, side="left")
    rank = np.arange(len(row)) - first + 1
    best = rank <= k
    return pa.RecordBatch.from_arrays(
        [
            pa.array(user_ids[row[best]], pa.int32()),
            pa.array(item_ids[col[best]], pa.int32()),
            pa.array(value[best]),
            pa.array(rank[best], pa.int32()),
        ],
        ["user_id", "item_id", "prediction", "rank"],
    )


_LONG = "user_id int, item_id int, prediction double"
_WIDE = "user_id int, item_block int, predictions array<double>"


# --- item factors small enough to broadcast ----------------------------------


def _fits(items: int, rank: int, limit: int) -> bool:
    return items * (8 * rank + 4) <= limit


def _item_matrix(model, items: DataFrame):
    """Sorted item ids and their factor matrix, broadcast. Size checked by the caller."""
    local = items.select("id", "features").toArrow()
    ids = local.column("id").to_numpy()
    order = np.argsort(ids)
    features = local.column("features").combine_chunks()
    matrix = _matrix(features, model.rank)[order] if len(ids) else np.empty((0, model.rank))
    return model.spark.sparkContext.broadcast((ids[order], np.ascontiguousarray(matrix)))


def _tasks(users: int, items: int) -> int:
    return max(1, min(users, -(-users * items // CELLS_PER_TASK)))


def _num_tasks(model, users: int, items: int) -> int:
    cores = model.spark.sparkContext.defaultParallelism
    return max(_tasks(users, items), min(cores, -(-users * items // TILE_CELLS), users), 1)


def _search_tasks(model) -> int:
    """Tasks of a search that leaves most cells out: enough users each to be worth arranging the items."""
    cores = model.spark.sparkContext.defaultParallelism
    return min(_num_tasks(model, model.users, model.items), max(cores, -(-model.users // USERS_PER_SEARCH)))


def _stream_past(users: DataFrame, shared, rank: int, schema: str, emit) -> DataFrame:
    def kernel(batches):
        item_ids, matrix = shared.value
        for batch in batches:
            if batch.num_rows == 0 or len(item_ids) == 0:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            x = _matrix(batch.column("features"), rank)
            for start, stop in _tiles(len(ids), len(item_ids)):
                scores = x[start:stop] @ matrix.T
                yield emit(batch, start, stop, ids[start:stop], item_ids, scores)

    return users.mapInArrow(kernel, schema)


# --- grid of cells for item factors of any size ------------------------------


def _spans(item_blocks: int, item_block: int, rank: int, grid_bytes: int) -> int:
    """Columns of rectangles: runs of item blocks that one task can hold."""
    return max(1, -(-item_blocks * item_block * (8 * rank + 4) // grid_bytes))


def _grid(users: DataFrame, items: DataFrame, n_users: int, spans: int, user_block: int, rank: int, schema: str, kernel) -> DataFrame:
    """Rows that ``kernel`` makes of every rectangle of cells.

    ``users``: id, features, span and maybe seen, one row per span; ``items``: id, features, span.
    ``kernel(span, item_ids, matrix)`` is called once per rectangle, with ascending ids, and
    returns a function from (user ids, vectors, seen or None) to batches.
    """
    cores = users.sparkSession.sparkContext.defaultParallelism
    rows = max(1, min(-(-n_users // user_block), -(-TASKS_PER_CORE * cores // spans)))
    cell = lambda row: (F.col("span") * rows + row).cast("int").alias("cell")
    has_seen = "seen" in users.columns
    seen = lambda known: [F.col("seen") if known else F.lit(None).cast("array<int>").alias("seen")] if has_seen else []
    left = users.select(
        cell(F.pmod(F.xxhash64("id"), F.lit(rows))), F.lit(1).alias("kind"), "id", "features", *seen(True)
    )
    right = items.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).select(
        cell(F.col("row")), F.lit(0).alias("kind"), "id", "features", *seen(False)
    )
    placed = left.unionByName(right).repartitionById(rows * spans, F.col("cell")).sortWithinPartitions("cell", "kind", "id")

    def past_items(batches):
        held, here, emit = [], None, None
        for batch in batches:
            marks = batch.column("cell").to_numpy(zero_copy_only=False) * 2 + batch.column("kind").to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(np.diff(marks)) + 1, len(marks)] if len(marks) else []
            for start, stop in zip(edges[:-1], edges[1:]):
                part, mark = batch.slice(start, stop - start), int(marks[start])
                ids = part.column("id").to_numpy(zero_copy_only=False)
                x = _matrix(part.column("features"), rank)
                if here != mark // 2:
                    held, here, emit = [], mark // 2, None
                if mark % 2 == 0:
                    held.append((ids.copy(), x.copy()))
                elif held:  # users of a rectangle without items meet nothing
                    if emit is None:
                        emit = kernel(here // rows, np.concatenate([i for i, _ in held]), np.vstack([m for _, m in held]))
                    yield from emit(ids, x, part.column("seen") if has_seen else None)

    return placed.mapInArrow(past_items, schema)


def _every_span(factors: DataFrame, spans: int) -> DataFrame:
    return factors.select("id", "features", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"))


# --- operators ---------------------------------------------------------------


def _restrict(factors: DataFrame, ids, key: str) -> DataFrame:
    if ids is None:
        return factors
    return factors.join(ids.select(F.col(key).alias("id")).distinct(), "id", "left_semi")


def _spanned_items(items: DataFrame, width: int, ordered: bool, n_items: int, rank: int, grid_bytes: int):
    """Items with the column of rectangles they are in, by sorted position or by hash, and how many there are."""
    blocks = max(1, -(-n_items // width))
    spans = min(blocks, _spans(blocks, width, rank, grid_bytes))
    if not ordered:
        return items.select("id", "features", _hashed_span("id", blocks, spans).alias("span")), spans
    position = dense_index(items, "id", "position")
    block = F.floor(F.col("position") / width)
    span = F.floor(block * spans / blocks).cast("int")
    return items.join(position, "id").select("id", "features", span.alias("span")), spans


def _hashed_span(col: str, blocks: int, spans: int):
    return (F.pmod(F.xxhash64(col), F.lit(blocks)) % spans).cast("int")


def predict_all(
    model, users=None, items=None, broadcast_limit=BROADCAST_LIMIT,
    user_block=USER_BLOCK, item_block=ITEM_BLOCK, grid_bytes=GRID_BYTES,
) -> DataFrame:
    """Every cell of the prediction matrix as (user_id, item_id, prediction)."""
    people = _restrict(model.user_factors, users, "user_id")
    things = _restrict(model.item_factors, items, "item_id")
    n_users = model.users if users is None else people.count()
    n_items = model.items if items is None else things.count()
    rank = model.rank
    if _fits(n_items, rank, broadcast_limit):
        shared = _item_matrix(model, things)
        people = people.repartition(_num_tasks(model, n_users, n_items), "id")
        emit = lambda batch, start, stop, ids, item_ids, scores: _long_rows(ids, item_ids, scores)
        return _stream_past(people, shared, rank, _LONG, emit)
    blocked, spans = _spanned_items(things, item_block, False, n_items, rank, grid_bytes)

    def kernel(span, item_ids, matrix):
        def emit(user_ids, x, _):
            for u in range(0, len(user_ids), user_block):
                for i in range(0, len(item_ids), item_block):
                    scores = x[u : u + user_block] @ matrix[i : i + item_block].T
                    yield _long_rows(user_ids[u : u + user_block], item_ids[i : i + item_block], scores)

        return emit

    return _grid(_every_span(people, spans), blocked, n_users, spans, user_block, rank, _LONG, kernel)


def predict_rows(
    model, broadcast_limit=BROADCAST_LIMIT, user_block=USER_BLOCK, item_block=ITEM_BLOCK, grid_bytes=GRID_BYTES,
) -> DataFrame:
    """The prediction matrix row by row: (user_id, predictions), items in id order.

    Users come out in ascending order across and within partitions. With
    broadcast items only the user vectors are sorted, never the rows.
    """
    rank = model.rank
    if _fits(model.items, rank, broadcast_limit):
        shared = _item_matrix(model, model.item_factors)
        tasks = _num_tasks(model, model.users, model.items)
        people = model.user_factors.repartitionByRange(tasks, "id").sortWithinPartitions("id")
        emit = lambda batch, start, stop, ids, item_ids, scores: _wide_rows(ids, 0, scores)
        return _stream_past(people, shared, rank, _WIDE, emit).select("user_id", "predictions")
    blocked, spans = _spanned_items(model.item_factors, item_block, True, model.items, rank, grid_bytes)

    def kernel(span, item_ids, matrix):
        def emit(user_ids, x, _):
            for start, stop in _tiles(len(user_ids), len(item_ids)):
                yield _wide_rows(user_ids[start:stop], span, x[start:stop] @ matrix.T)

        return emit

    people = _every_span(model.user_factors, spans)
    pieces = _grid(people, blocked, model.users, spans, user_block, rank, _WIDE, kernel)
    # A row of the matrix is as wide as the item table by definition of the format.
    whole = F.array_sort(F.collect_list(F.struct("item_block", "predictions")))
    rows = pieces.repartitionByRange("user_id").groupBy("user_id").agg(whole.alias("pieces"))
    return rows.sortWithinPartitions("user_id").select(
        "user_id", F.flatten(F.transform("pieces", lambda p: p["predictions"])).alias("predictions")
    )


def recommend(
    model, k: int = 10, exclude_rated: bool = True, ratings: DataFrame | None = None,
    broadcast_limit=BROADCAST_LIMIT, user_block=USER_BLOCK, item_block=ITEM_BLOCK, prune: bool = False,
    grid_bytes=GRID_BYTES,
) -> DataFrame:
    """The k best items per user: (user_id, item_id, prediction, rank).

    Order: prediction descending, item id ascending. With ``exclude_rated`` the
    items a user has rated are left out; ``ratings`` defaults to those fitted.
    Repeated pairs are combined before anything is gathered per user.
    A user reads the blocks of items that can hold one of its best and no others (``prune``);
    with ``prune`` and broadcast items the result has ``blocks_read`` besides.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if exclude_rated:
        if ratings is not None:
            ratings = ratings.select("user_id", "item_id").distinct()
        elif model.ratings is not None:
            ratings = model.ratings.select("user_id", "item_id")  # one row per pair
        else:
            raise ValueError("exclude_rated needs the ratings")
    rank = model.rank
    if _fits(model.items, rank, broadcast_limit):
        shared = _item_matrix(model, model.item_factors)
        tasks = _search_tasks(model)
        people = model.user_factors.repartition(tasks, "id")
        if exclude_rated:
            # Distinct items per user: never longer than the broadcast item table.
            seen = (
                ratings.repartition(tasks, "user_id")
                .groupBy(F.col("user_id").alias("id"))
                .agg(F.collect_set("item_id").alias("seen"))
            )
            people = people.join(seen, "id", "left")
        found = recommend_pruned(people, shared, rank, k)
        return found if prune else found.drop("blocks_read")

    blocked, spans = _spanned_items(model.item_factors, item_block, False, model.items, rank, grid_bytes)
    people = _every_span(model.user_factors, spans)
    if exclude_rated:
        span = _hashed_span("item_id", max(1, -(-model.items // item_block)), spans).alias("span")
        # Distinct items per user and span: never longer than the items that one task holds.
        seen = ratings.groupBy(F.col("user_id").alias("id"), span).agg(F.collect_set("item_id").alias("seen"))
        people = people.join(seen, ["id", "span"], "left")

    def kernel(span, item_ids, matrix):
        return finder(item_ids, matrix, k, item_block)

    found = _grid(people, blocked, model.users, spans, user_block, rank, FOUND, kernel).drop("blocks_read")
    if spans == 1:
        return found
    best = Window.partitionBy("user_id").orderBy(F.desc("prediction"), "item_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

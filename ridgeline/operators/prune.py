"""Exact top-k without forming every cell.

Items are laid into blocks of vectors that lie close together. No prediction of a block exceeds
the user's length times that of the block's longest vector, nor the product with the block's
centre plus the user's length times the block's radius. Each user takes the blocks with the
highest bounds first, keeps the k best so far, and leaves out every block whose bound is below the
k-th. A tie with the k-th can still win by its lower id, so only a smaller bound leaves a
block out. At most k rows per user leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.linalg import _matrix

ITEM_BLOCK = 512
USER_TILE = 4096
#: Bounds (users x blocks) that are held at once.
_BOUNDS = 2_000_000
#: Blocks that each user takes by its own order before all go through the blocks together.
_FIRST = 3
#: Room for rounding between a bound and a computed product, relative to the vectors' lengths.
_SLACK = 1e-9
SCHEMA = "user_id int, item_id int, prediction double, rank int, blocks_read int"


def arranged(matrix: np.ndarray, lengths: np.ndarray, width: int = ITEM_BLOCK) -> np.ndarray:
    """An order of the vectors in which every ``width`` of them lie close together.

    Vectors are halved along their widest column, or by length if that differs most.
    """
    columns = np.column_stack([matrix, lengths])
    order = np.arange(len(matrix))
    waiting = [(0, len(matrix))]
    while waiting:
        start, stop = waiting.pop()
        if stop - start <= width:
            continue
        cut = -(-(stop - start) // width) // 2 * width
        part = order[start:stop]
        values = columns[part]
        by = np.argmax(np.ptp(values, axis=0))
        order[start:stop] = part[np.argpartition(values[:, by], cut)]
        waiting += [(start, start + cut), (start + cut, stop)]
    return order


def outlines(matrix: np.ndarray, lengths: np.ndarray, width: int = ITEM_BLOCK):
    """(centre, radius, longest) of every run of ``width`` vectors."""
    starts = np.arange(0, len(matrix), width)
    sizes = np.diff(np.r_[starts, len(matrix)])
    if len(starts) == 0:
        return matrix, lengths, lengths
    centres = np.add.reduceat(matrix, starts, axis=0) / sizes[:, None]
    away = np.linalg.norm(matrix - np.repeat(centres, sizes, axis=0), axis=1)
    return centres, np.maximum.reduceat(away, starts), np.maximum.reduceat(lengths, starts)


def top_k(
    x: np.ndarray,
    ids: np.ndarray,
    matrix: np.ndarray,
    lengths: np.ndarray,
    rated: tuple[np.ndarray, np.ndarray],
    k: int,
    width: int = ITEM_BLOCK,
    outline=None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, value, rank) of the k best per row of ``x``, and the blocks each row read.

    Every ``width`` of ``ids``, ``matrix`` and ``lengths`` are a block, whatever their order;
    ``rated`` holds the (row, position) cells that are left out.
    """
    centres, radius, longest = outlines(matrix, lengths, width) if outline is None else outline
    k = min(k, len(ids))
    reach = np.linalg.norm(x, axis=1)
    slack = _SLACK * np.outer(reach, longest)
    highest = np.minimum(np.outer(reach, longest), x @ centres.T + np.outer(reach, radius)) + slack
    read = np.zeros(len(x), dtype=np.int32)
    values, places = np.full((len(x), k), -np.inf), np.full((len(x), k), -1)
    if k == 0:
        return (*np.zeros((4, 0), dtype=np.int64), read)
    kth = values[:, -1]
    by_place = np.argsort(rated[1], kind="stable")
    rated_rows, rated_places = rated[0][by_place], rated[1][by_place]
    slot = np.full(len(x), -1)

    def visit(block, active):
        start, stop = block * width, min((block + 1) * width, len(ids))
        read[active] += 1
        scores = x[active] @ matrix[start:stop].T
        slot[active] = np.arange(len(active))
        a, b = np.searchsorted(rated_places, [start, stop])
        out = slot[rated_rows[a:b]]
        scores[out[out >= 0], rated_places[a:b][out >= 0] - start] = -np.inf
        slot[active] = -1
        floor = kth[active] - slack[active, block]
        near = np.flatnonzero(scores.max(axis=1) >= floor)
        active, scores, floor = active[near], scores[near], floor[near]
        if len(active) and stop - start > k:
            best = np.partition(scores, stop - start - k, axis=1)[:, stop - start - k]
            floor = np.maximum(floor, best - slack[active, block])
        row, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        if len(row) == 0:
            return
        # The product of the block is a first sight; values are summed alike for every cell.
        found_rows, found = active[row], start + col
        value = x[found_rows, 0] * matrix[found, 0]
        for q in range(1, x.shape[1]):
            value += x[found_rows, q] * matrix[found, q]
        touched = np.unique(found_rows)
        rows = np.r_[np.repeat(touched, k), found_rows]
        at = np.r_[places[touched].ravel(), found]
        value = np.r_[values[touched].ravel(), value]
        rows, at, value = rows[at >= 0], at[at >= 0], value[at >= 0]
        order = np.lexsort((ids[at], -value, rows))
        rows, at, value = rows[order], at[order], value[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        kept = rank < k
        values[touched], places[touched] = -np.inf, -1
        values[rows[kept], rank[kept]], places[rows[kept], rank[kept]] = value[kept], at[kept]

    rows = np.arange(len(x))
    for _ in range(min(_FIRST, len(longest))):
        block = highest[rows].argmax(axis=1)
        bound = highest[rows, block]
        rows, block = (part[(bound >= kth[rows]) & (bound > -np.inf)] for part in (rows, block))
        if len(rows) == 0:
            break
        order = np.argsort(block, kind="stable")
        chosen, starts = np.unique(block[order], return_index=True)
        for one, active in zip(chosen, np.split(rows[order], starts[1:])):
            visit(one, active)
        highest[rows, block] = -np.inf
    left = np.flatnonzero(((highest >= kth[:, None]) & (highest > -np.inf)).any(axis=0)) if len(x) else []
    for one in sorted(left, key=lambda b: -highest[:, b].max()):
        active = np.flatnonzero((highest[:, one] >= kth) & (highest[:, one] > -np.inf))
        if len(active):
            visit(one, active)
    rows, rank = np.nonzero(places >= 0)
    return rows, places[rows, rank], values[rows, rank], rank + 1, read


def finder(ids: np.ndarray, matrix: np.ndarray, k: int, width: int = ITEM_BLOCK):
    """Function from (user ids, vectors, lists of rated items or None) to batches of ``SCHEMA``.

    ``ids`` are ascending.
    """
    lengths = np.linalg.norm(matrix, axis=1)
    order = arranged(matrix, lengths, width)
    place_of = np.empty(len(ids), dtype=np.int64)
    place_of[order] = np.arange(len(ids))
    placed_ids, placed, placed_lengths = ids[order], matrix[order], lengths[order]
    outline = outlines(placed, placed_lengths, width)
    tile = max(1, min(USER_TILE, _BOUNDS // max(len(outline[2]), 1)))

    def find(user_ids, x, seen):
        for start in range(0, len(user_ids) if len(ids) else 0, tile):
            stop = min(start + tile, len(user_ids))
            cells = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            if seen is not None:
                lists = seen.slice(start, stop - start)
                counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                items = lists.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, items), len(ids) - 1)
                known = ids[at] == items
                cells = np.repeat(np.arange(stop - start), counts)[known], place_of[at[known]]
            rows, places, values, ranks, read = top_k(
                x[start:stop], placed_ids, placed, placed_lengths, cells, k, width, outline
            )
            columns = [
                pa.array(user_ids[start:stop][rows], pa.int32()), pa.array(placed_ids[places], pa.int32()),
                pa.array(values, pa.float64()), pa.array(ranks, pa.int32()), pa.array(read[rows], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["user_id", "item_id", "prediction", "rank", "blocks_read"])

    return find


def recommend_pruned(people: DataFrame, shared, rank: int, k: int, width: int = ITEM_BLOCK) -> DataFrame:
    """(user_id, item_id, prediction, rank, blocks_read) for users (id, features, and maybe seen).

    ``shared`` is the broadcast (item ids ascending, matrix) whose size the caller has checked.
    """
    exclude = "seen" in people.columns

    def kernel(batches):
        find = None
        for batch in batches:
            if batch.num_rows:
                find = find or finder(*shared.value, k, width)
                user_ids = batch.column("id").to_numpy(zero_copy_only=False)
                yield from find(user_ids, _matrix(batch.column("features"), rank), batch.column("seen") if exclude else None)

    return people.mapInArrow(kernel, SCHEMA)


def blocks_read(found: DataFrame, items: int, width: int = ITEM_BLOCK) -> DataFrame:
    """(users, read, all_blocks): blocks that were multiplied, and what all cells would take."""
    per_user = found.groupBy("user_id").agg(F.max("blocks_read").alias("read"))
    blocks = -(-items // width)
    return per_user.agg(
        F.count(F.lit(1)).alias("users"), F.sum("read").alias("read"), (F.count(F.lit(1)) * blocks).alias("all_blocks")
    )

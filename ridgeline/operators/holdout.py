"""Cells held out of a fit, and when their error says that it has converged."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.columns import FEATURE_STEP, ID_STEP, MODULUS
from ridgeline.operators.evaluate import predicted_pairs

TRACE_SCHEMA = "iteration int, train_mse double, held_out_mse double, improved boolean"


def split_cells(ratings: DataFrame, share: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(kept, held out): about ``share`` of the cells of each user are held out.

    A cell's side follows from its two ids alone, so all ratings of a pair, every run and
    every partitioning agree on it.
    """
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    place = F.col("user_id").cast("bigint") * ID_STEP + F.col("item_id").cast("bigint") * FEATURE_STEP + F.lit(seed)
    held = F.pmod(place, F.lit(MODULUS)) < F.lit(int(share * MODULUS))
    return ratings.where(~held), ratings.where(held)


@dataclass(frozen=True)
class Stop:
    """Stop a fit when the error on ``held_out`` cells has ceased to fall.

    An iteration improves if it lowers the least error so far by more than ``gain`` times that;
    after ``patience`` iterations in a row that do not, the fit ends and its model is the last one
    that did. Held-out cells without both vectors have no prediction and are not scored.
    """

    held_out: DataFrame
    gain: float = 1e-3
    patience: int = 1

    def __post_init__(self):
        if not 0 <= self.gain < 1:
            raise ValueError("gain must be at least 0 and below 1")
        if self.patience < 1:
            raise ValueError("patience must be at least 1")


class Progress:
    """Errors of the iterations of one fit, both sets scored in one pass."""

    def __init__(self, stop: Stop, kept: DataFrame, held_out: DataFrame, rank: int, broadcast_limit: int):
        self.stop = stop
        self.rank = rank
        self.broadcast_limit = broadcast_limit
        columns = ("user_id", "item_id", F.col("rating").cast("double").alias("rating"))
        self.cells = kept.select(*columns, F.lit(False).alias("held")).unionByName(
            held_out.select(*columns, F.lit(True).alias("held"))
        )
        self.rows: list[tuple[int, float, float, bool]] = []
        self.best = 0

    def score(self, iteration: int, user: DataFrame, item: DataFrame) -> bool:
        """Whether to stop after this iteration."""
        scored = predicted_pairs(self.cells, user, item, self.rank, broadcast_limit=self.broadcast_limit)
        error = F.col("rating") - F.col("prediction")
        found = {r["held"]: r["mse"] for r in scored.groupBy("held").agg(F.avg(error * error).alias("mse")).collect()}
        if True not in found:
            raise ValueError("no held-out cell has a vector on both sides")
        held = found[True]
        least = next((row[2] for row in self.rows if row[0] == self.best), math.inf)
        improved = held < least * (1 - self.stop.gain)
        self.rows.append((iteration, found[False], held, improved))
        if improved:
            self.best = iteration
        return iteration - self.best >= self.stop.patience

"""Initial user factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.columns import pseudo_random


def initial_features(mean_rating, id_col, rank: int, seed: int = 0):
    """Feature 0 is the mean rating (1.0 if there is none), the rest lie in (0, 1)."""
    first = F.coalesce(mean_rating, F.lit(1.0))
    return F.array(first, *[pseudo_random(id_col, q, seed) for q in range(1, rank)])


def init_user_factors(ratings: DataFrame, rank: int, seed: int = 0) -> DataFrame:
    means = ratings.groupBy(F.col("user_id").alias("id")).agg(F.avg("rating").alias("mean"))
    return means.select("id", initial_features(F.col("mean"), F.col("id"), rank, seed).alias("features"))

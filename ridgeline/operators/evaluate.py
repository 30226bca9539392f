"""Scoring: squared errors on rated cells, and the regularised objective."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.functions.columns import dot_columns, features_to_columns
from ridgeline.operators import layout
from ridgeline.operators.skew import join_vectors


def attach_vectors(pairs: DataFrame, factors: DataFrame, side: str, rank: int, rows=None, how="inner", **options):
    """Add the entity's vector to each pair as columns u0.. (user) or m0.. (item)."""
    key, by, prefix = ("user_id", "item_id", "u") if side == "user" else ("item_id", "user_id", "m")
    vectors = factors.select(F.col("id").alias(key), *features_to_columns("features", rank, prefix))
    return join_vectors(pairs, vectors, key, by, how, rows, 8 * rank + 16, **options)


def _moved(factors: dict[str, DataFrame], rank: int, broadcast_limit: int = layout.BROADCAST_LIMIT, **_) -> tuple[dict[str, int], list[str]]:
    """Counted vectors by side, and the sides whose vectors are too many to be broadcast."""
    counts = {side: vectors.count() for side, vectors in factors.items()}
    return counts, [side for side, n in counts.items() if n * (8 * rank + 16) > broadcast_limit]


def _with_vectors(pairs: DataFrame, factors: dict[str, DataFrame], rank: int, how: str, sizes, written: bool = False, **options) -> DataFrame:
    """``pairs`` with the vectors of both sides as columns u0.. and m0...

    Pairs that are shuffled are a table before, without vectors, and hot keys are counted there. A side that
    is broadcast comes last, so that no vector is shuffled again with its pair.
    """
    counts, moved = sizes
    if moved and not written:
        pairs = workdir.write_table(pairs, workdir.new_run_dir(pairs.sparkSession, "spread-rows"))
    narrow = pairs
    for side in [*moved, *(s for s in factors if s not in moved)]:
        pairs = attach_vectors(pairs, factors[side], side, rank, counts[side], how, counted=narrow, **options)
    return pairs


def predicted_pairs(pairs: DataFrame, user_factors, item_factors, rank: int, how="inner", **options) -> DataFrame:
    """``pairs`` plus a prediction column (null where a vector is missing)."""
    factors = {"user": user_factors, "item": item_factors}
    joined = _with_vectors(pairs, factors, rank, how, _moved(factors, rank, **options), **options)
    return joined.select(*pairs.columns, dot_columns("u", "m", rank).alias("prediction"))


def in_passes(rows: DataFrame, key: str, passes: int) -> list[DataFrame]:
    """``rows`` in groups of whole ids."""
    if passes == 1:
        return [rows]
    group = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(passes))
    return [rows.where(group == p) for p in range(passes)]


def vector_passes(rows: int, rank: int) -> int:
    """Passes over that many rows if each of them is shuffled with a vector."""
    return layout.passes_for(layout.vector_bytes(rows, rank))


def _summed(pairs: DataFrame, user_factors, item_factors, rank: int, sums: dict, **options) -> DataFrame:
    """One row of sums over all pairs and their vectors.

    Where the vectors of neither side can be broadcast every pair is shuffled with a vector; of many pairs
    that is done for a group of users at a time, whose sums are kept.
    """
    factors = {"user": user_factors, "item": item_factors}
    sizes = _moved(factors, rank, **options)
    named = [value.alias(name) for name, value in sums.items()]
    if len(sizes[1]) < 2:
        return _with_vectors(pairs, factors, rank, "inner", sizes, **options).agg(*named)
    spark = pairs.sparkSession
    path = workdir.new_run_dir(spark, "scored")
    pairs = workdir.write_table(pairs, f"{path}/pairs")
    passes = vector_passes(pairs.count(), rank)
    joined = [
        _with_vectors(rows, factors | {"user": users}, rank, "inner", sizes, written=True, **options).agg(*named)
        for rows, users in zip(in_passes(pairs, "user_id", passes), in_passes(user_factors, "id", passes))
    ]
    if passes == 1:
        return joined[0]
    with layout.shuffle_cleanup(spark):
        for part in joined:
            part.write.mode("append").parquet(f"{path}/sums")
    workdir.delete_dir(spark, f"{path}/pairs")
    return spark.read.parquet(f"{path}/sums").agg(*[F.sum(name).alias(name) for name in sums])


def error_summary(predictions: DataFrame) -> DataFrame:
    """(n, mse, rmse) of rows with columns rating and prediction."""
    error = F.col("rating").cast("double") - F.col("prediction")
    return predictions.agg(
        F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse")
    ).select("n", "mse", F.sqrt("mse").alias("rmse"))


def evaluate(user_factors, item_factors, ratings: DataFrame, rank: int, **options) -> DataFrame:
    """MSE and RMSE on the rated cells; a rating of 0 counts like any other."""
    pairs = ratings.select("user_id", "item_id", "rating")
    error = F.col("rating").cast("double") - dot_columns("u", "m", rank)
    sums = {"n": F.count(F.lit(1)), "scored": F.count(error), "se": F.sum(error * error)}
    mse = F.col("se") / F.nullif("scored", F.lit(0))
    return _summed(pairs, user_factors, item_factors, rank, sums, **options).select("n", mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def evaluate_predictions(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Score a (user_id, item_id, prediction) table against the ratings."""
    rated = ratings.select("user_id", "item_id", "rating")
    return error_summary(rated.join(predictions, ["user_id", "item_id"]))


def objective(user_factors, item_factors, ratings: DataFrame, rank: int, reg: float, **options) -> DataFrame:
    """sum of squared errors + reg * (sum n_u |u|^2 + sum n_m |m|^2), as one row.

    Every rating contributes its user's and item's norm once, which weights the
    norms by the rating counts without a second pass.
    """
    pairs = ratings.select("user_id", "item_id", "rating")
    error = F.col("rating").cast("double") - dot_columns("u", "m", rank)
    penalty = dot_columns("u", "u", rank) + dot_columns("m", "m", rank)
    sums = {"n": F.count(F.lit(1)), "sse": F.sum(error * error), "penalty": F.sum(penalty)}
    return _summed(pairs, user_factors, item_factors, rank, sums, **options).select(
        "n",
        (F.col("sse") / F.col("n")).alias("mse"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sse") + F.lit(float(reg)) * F.col("penalty")).alias("objective"),
    )

"""Duplicate handling, rejects and the ratings profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ON_DUPLICATE = ("error", "last", "keep")


def resolve_duplicates(ratings: DataFrame, on_duplicate: str = "error") -> DataFrame:
    """Decide what a second rating of the same (user, item) means.

    ``last`` keeps the latest ``rated_on`` (highest rating on a tie), ``keep``
    treats both as observations, ``error`` leaves the check to ``assert_unique``.
    ``last`` is an aggregate, so a pair that repeats without bound is combined
    before it is shuffled.
    """
    if on_duplicate not in ON_DUPLICATE:
        raise ValueError(f"on_duplicate must be one of {ON_DUPLICATE}, got {on_duplicate!r}")
    if on_duplicate != "last":
        return ratings
    order = ["rated_on", "rating"] if "rated_on" in ratings.columns else ["rating"]
    latest = F.max(F.struct(*order)).alias("latest")
    return ratings.groupBy("user_id", "item_id").agg(latest).select(
        "user_id", "item_id", *[F.col(f"latest.{c}").alias(c) for c in reversed(order)]
    )


def checked_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings with ids as INT; a null or an id that does not fit fails with one clear error.

    The check is part of the projection, so it costs no pass of its own.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    row = F.concat_ws(", ", text("user_id"), text("item_id"), text("rating"))

    def checked(column, usable, message: str):
        return F.when(usable, column).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), row)))

    out = ratings
    for name in ("user_id", "item_id"):
        fits = F.coalesce(F.col(name).between(-(1 << 31), (1 << 31) - 1), F.lit(False))
        out = out.withColumn(name, checked(F.col(name).cast("int"), fits, f"{name} must be an INT"))
    usable = F.col("rating").isNotNull()
    if dict(ratings.dtypes)["rating"] in ("double", "float"):
        usable = usable & ~F.isnan("rating")
    return out.withColumn("rating", checked(F.col("rating"), usable, "rating must be a number"))


def combine_repeats(ratings: DataFrame) -> DataFrame:
    """One row per pair that stands for all its ratings: their number and sum.

    The normal equations need no more than that, and the combining happens
    before the shuffle, however often a pair repeats.
    """
    return ratings.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("weight"), F.sum("rating").alias("rating")
    )


def duplicated_pairs(ratings: DataFrame) -> DataFrame:
    """(user_id, item_id, n) of pairs rated more than once."""
    return (
        ratings.groupBy("user_id", "item_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Separate a raw scan into (ratings, rejects(line, reason)).

    ``raw`` comes from ``scan_headered_lines``: parsed columns, a position that
    is unique per line, and a reason for lines that cannot be ratings. Of the
    ratings of one pair the latest ``rated_on`` survives (the later line on a
    tie); the others are rejected as ``duplicate``. The survivors are picked by
    an aggregate and matched back on the unique position, so a pair with very
    many copies does not gather in one task.
    """
    parsed = raw.filter(F.col("reason").isNull() & ~F.col("is_header"))
    bad = raw.filter(F.col("reason").isNotNull()).select("line", "reason")
    day = F.coalesce("rated_on", F.lit("0001-01-01").cast("date"))
    kept = F.max(
        F.struct(day.alias("day"), "split_file", "split_start", "pos", "rating", "rated_on")
    ).alias("kept")
    survivors = parsed.groupBy("user_id", "item_id").agg(kept)
    good = survivors.select("user_id", "item_id", "kept.rating", "kept.rated_on")
    lost = parsed.select("pos", "line").join(survivors.select("kept.pos"), "pos", "left_anti")
    return good, bad.unionByName(lost.select("line", F.lit("duplicate").alias("reason")))


def profile(ratings: DataFrame, approximate: bool = False) -> DataFrame:
    """(users, items, ratings, sparsity): the extent of the ratings matrix."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    counted = ratings.agg(
        distinct("user_id").alias("users"),
        distinct("item_id").alias("items"),
        F.count(F.lit(1)).alias("ratings"),
    )
    cells = F.col("users").cast("double") * F.col("items")
    return counted.withColumn("sparsity", F.lit(1.0) - F.col("ratings") / cells)

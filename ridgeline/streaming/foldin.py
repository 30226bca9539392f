"""Folding changed ratings into a standing model.

A few new ratings do not need a fit: the ids they touch are solved again, each from all its
ratings, for the counterpart's vectors as they stand. Only those rows are written:

    <table>/factors/version=<id>     a model fitted on everything up to that batch
    <table>/folds/user/batch=<id>    vectors of the users that batch touched
    <table>/folds/item/batch=<id>    then of the items, for the users as they are now

The current vector of an id is its newest fold after the newest model, or the model's. A fold
reads only folds of earlier batches, so a batch that is replayed writes the same rows again.
An id whose counterparts have no vectors yet gets none; the next fold or fit that reaches them
will give it one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.operators.als import ALSModel
from ridgeline.operators.gate import latest_factors
from ridgeline.operators.layout import half_step, spread_rows
from ridgeline.operators.skew import BROADCAST_IDS
from ridgeline.schemas import FACTORS, side_columns
from ridgeline.sources.factors import load_model, model_versions

SIDES = ("user", "item")


def touched_ratings(ratings: DataFrame, changes: DataFrame, side: str) -> DataFrame:
    """All ratings of the ids of ``side`` that occur in ``changes``.

    Both are tables, so counting them reads their footers. Few changes are sent to the ratings; for
    many the ratings are laid out by id first, in as many partitions as their number asks for.
    """
    own, _ = side_columns(side)
    ids = changes.select(own).distinct()
    if changes.count() <= BROADCAST_IDS:
        return ratings.join(F.broadcast(ids), own, "left_semi")
    return spread_rows(ratings, ratings.count(), own).join(ids, own, "left_semi")


def fold_in(ratings: DataFrame, counterpart: DataFrame, side: str, rank: int, reg: float, **options) -> DataFrame:
    """New vectors (id, features) of the ids of ``side`` in ``ratings``, for fixed ``counterpart`` vectors.

    ``ratings`` holds all ratings of those ids and of no others. Ratings of counterparts without
    a vector do not count. Only the vectors that are needed take part, so the choice of a
    strategy goes by their number and not by the size of the model.
    """
    _, other = side_columns(side)
    ratings = ratings.join(counterpart.select(F.col("id").alias(other)), other, "left_semi")
    needed = counterpart.join(ratings.select(F.col(other).alias("id")).distinct(), "id", "left_semi")
    return half_step(ratings, needed, side, rank, reg, **options)


def fold_path(table_path: str, side: str, batch_id: int) -> str:
    return f"{table_path}/folds/{side}/batch={batch_id}"


def current_factors(spark: SparkSession, table_path: str, side: str, version: int, up_to: int | None = None) -> DataFrame:
    """One vector per id: model ``version`` and the folds after it, up to batch ``up_to``."""
    base = spark.read.schema(FACTORS).parquet(f"{table_path}/factors/version={version}/{side}_factors")
    bound = float("inf") if up_to is None else up_to
    root = f"{table_path}/folds/{side}"
    folds = [b for b in workdir.list_versions(spark, root, "batch") if version < b <= bound]
    if not folds:
        return base
    schema = "id int, features array<double>, batch bigint"
    rows = spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/batch={b}" for b in folds])
    newest = latest_factors(rows, "batch")
    return base.join(newest.select("id"), "id", "left_anti").unionByName(newest)


def fold_batch(spark: SparkSession, table_path: str, batch_id: int, hot_limit: int | None = None) -> dict[str, int] | None:
    """Fold the delta of one micro-batch into the newest model; rows solved per side.

    None if there is no model before the batch yet.
    """
    from ridgeline.streaming.upsert import current_ratings, delta_of

    versions = [v for v in model_versions(spark, f"{table_path}/factors") if v < batch_id]
    if not versions:
        return None
    version = versions[-1]
    model = load_model(spark, f"{table_path}/factors/version={version}")
    changes = delta_of(spark, table_path, batch_id).select("user_id", "item_id")
    before = {side: current_factors(spark, table_path, side, version, batch_id - 1) for side in SIDES}
    solved = {}
    for side, other in (("user", "item"), ("item", "user")):
        touched = current_ratings(spark, table_path, batch_id, lambda rows: touched_ratings(rows, changes, side))
        path = fold_path(table_path, side, batch_id)
        counterpart = before[other] if side == "user" else current_factors(spark, table_path, other, version, batch_id)
        found = fold_in(touched.select("user_id", "item_id", "rating"), counterpart, side, model.rank, model.reg, hot_limit=hot_limit)
        found.write.mode("overwrite").parquet(path)
        solved[side] = spark.read.schema(FACTORS).parquet(path).count()
    return solved


def current_model(spark: SparkSession, table_path: str):
    """The newest model with all folds after it, or None."""
    versions = model_versions(spark, f"{table_path}/factors")
    if not versions:
        return None
    model = load_model(spark, f"{table_path}/factors/version={versions[-1]}")
    user, item = (current_factors(spark, table_path, side, versions[-1]) for side in SIDES)
    return ALSModel(user, item, model.rank, model.reg, user.count(), item.count())


def prune_folds(spark: SparkSession, table_path: str, covered: int) -> None:
    """Drop the folds that a model of batch ``covered`` and all later models contain."""
    for side in SIDES:
        for batch in workdir.list_versions(spark, f"{table_path}/folds/{side}", "batch"):
            if batch <= covered:
                workdir.delete_dir(spark, fold_path(table_path, side, batch))

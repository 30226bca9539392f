"""Streaming upsert of ratings and periodic refit.

The table is a log of deltas plus compacted bases, each written once:

    <table>/delta/batch=<id>      latest rating per pair within one micro-batch
    <table>/base/version=<id>     everything up to and including that batch
    <table>/factors/version=<id>  a model fitted on that base
    <table>/folds/<side>/batch=<id>  vectors of the ids a later batch touched (``foldin``)

A micro-batch costs its own size, not the table's. Every folder is named after
its batch id, so a batch that is replayed rewrites the same folder; nothing is
overwritten while it is read, and all state is found from the listing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.operators.als import ALSFactorizer
from ridgeline.operators.layout import spread_rows
from ridgeline.schemas import RATING_EVENTS
from ridgeline.streaming import foldin

_COLUMNS = RATING_EVENTS.fieldNames()


def latest_per_pair(events: DataFrame) -> DataFrame:
    """The latest rating of each (user, item) by (rated_at, seq), combined map-side."""
    latest = F.max(F.struct("rated_at", "seq", "rating")).alias("latest")
    return events.groupBy("user_id", "item_id").agg(latest).select(
        "user_id", "item_id", "latest.rating", "latest.rated_at", "latest.seq"
    )


def delta_of(spark: SparkSession, table_path: str, batch_id: int) -> DataFrame:
    """What one micro-batch changed."""
    return spark.read.schema(RATING_EVENTS).parquet(f"{table_path}/delta/batch={batch_id}")


def current_ratings(
    spark: SparkSession,
    table_path: str,
    up_to: int | None = None,
    only: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The table as of batch ``up_to`` (or now): newest base, plus deltas after it.

    ``only`` picks whole (user, item) pairs before their latest ratings are looked for, so
    pairs that are not wanted are never shuffled.
    """
    bound = float("inf") if up_to is None else up_to
    bases = [v for v in workdir.list_versions(spark, f"{table_path}/base", "version") if v < bound]
    after = bases[-1] if bases else -1
    deltas = workdir.list_versions(spark, f"{table_path}/delta", "batch")
    paths = [f"{table_path}/delta/batch={b}" for b in deltas if after < b <= bound]
    if bases:
        paths.insert(0, f"{table_path}/base/version={after}")
    if not paths:
        return spark.createDataFrame([], RATING_EVENTS)
    rows = spark.read.schema(RATING_EVENTS).parquet(*paths).select(*_COLUMNS)
    if len(paths) == 1:
        return rows if only is None else only(rows)
    found = rows.count()  # from the footers
    rows = spread_rows(rows, found, "user_id", "item_id") if only is None else only(rows)
    return latest_per_pair(rows)


def write_delta(batch: DataFrame, batch_id: int, table_path: str) -> None:
    latest_per_pair(batch).write.mode("overwrite").parquet(f"{table_path}/delta/batch={batch_id}")


def compact(spark: SparkSession, table_path: str, batch_id: int) -> DataFrame:
    """Write the base of ``batch_id`` from the previous base and later deltas."""
    path = f"{table_path}/base/version={batch_id}"
    current_ratings(spark, table_path, batch_id).write.mode("overwrite").parquet(path)
    return spark.read.schema(RATING_EVENTS).parquet(path)


def prune(spark: SparkSession, table_path: str, keep: int = 2) -> None:
    """Drop all but the newest ``keep`` bases and the deltas the oldest of them covers."""
    bases = workdir.list_versions(spark, f"{table_path}/base", "version")
    if len(bases) <= keep:
        return
    for version in bases[:-keep]:
        workdir.delete_dir(spark, f"{table_path}/base/version={version}")
    for batch in workdir.list_versions(spark, f"{table_path}/delta", "batch"):
        if batch <= bases[-keep]:
            workdir.delete_dir(spark, f"{table_path}/delta/batch={batch}")
    foldin.prune_folds(spark, table_path, bases[-keep])


def _start(stream: DataFrame, on_batch, checkpoint: str, trigger: dict | None):
    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def upsert_stream(
    stream: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None, compact_every: int = 16
):
    """Land rating events only; ``current_ratings`` reads the result.

    Every ``compact_every``-th micro-batch folds the deltas into a new base and drops what
    it covers, so a reader meets at most about twice that many folders.
    """
    if compact_every < 1:
        raise ValueError("compact_every must be at least 1")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch, batch_id, table_path)
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, table_path, batch_id)
            prune(batch.sparkSession, table_path)

    return _start(stream, on_batch, checkpoint, trigger)


def _refit(spark: SparkSession, table_path: str, batch_id: int, model_of: ALSFactorizer) -> None:
    base = compact(spark, table_path, batch_id)
    path = f"{table_path}/factors/version={batch_id}"
    workdir.delete_dir(spark, path)  # left by an attempt that did not finish
    if not base.isEmpty():
        model = model_of.fit(base)
        model.save(path)
        model.release()
    prune(spark, table_path)


def refit_pending(spark: SparkSession, table_path: str, factorizer: ALSFactorizer | None = None) -> bool:
    """Refit on micro-batches that came after the last refit; False if there are none.

    To be called when a ``refit_stream`` has ended, so that its last batches count too.
    """
    deltas = workdir.list_versions(spark, f"{table_path}/delta", "batch")
    bases = workdir.list_versions(spark, f"{table_path}/base", "version")
    if not deltas or (bases and bases[-1] >= deltas[-1]):
        return False
    _refit(spark, table_path, deltas[-1], factorizer or ALSFactorizer())
    return True


def refit_stream(
    stream: DataFrame,
    table_path: str,
    checkpoint: str,
    every: int = 1,
    factorizer: ALSFactorizer | None = None,
    trigger: dict | None = None,
    fold: bool = False,
):
    """Land rating events and refit after every ``every``-th micro-batch.

    With ``fold``, a batch without a refit folds the ids it touches into the model there is
    (``foldin.current_model`` reads the result). Returns the started query. ``trigger`` defaults to ``availableNow``, which
    takes in everything there is and stops; pass e.g. ``processingTime`` to keep
    going. New users and items simply become new rows.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    model_of = factorizer or ALSFactorizer()

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch, batch_id, table_path)
        if (batch_id + 1) % every == 0:
            _refit(batch.sparkSession, table_path, batch_id, model_of)
        elif fold:
            foldin.fold_batch(batch.sparkSession, table_path, batch_id, model_of.hot_limit)

    return _start(stream, on_batch, checkpoint, trigger)


def latest_model(spark: SparkSession, table_path: str):
    """The newest complete model of a refit stream, or None."""
    from ridgeline.sources.factors import load_model, model_versions

    versions = model_versions(spark, f"{table_path}/factors")
    return load_model(spark, f"{table_path}/factors/version={versions[-1]}") if versions else None

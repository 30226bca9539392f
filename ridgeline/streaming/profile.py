"""Profile of a ratings stream from sketches that can be merged.

Each micro-batch leaves one row per group: HyperLogLog sketches of its users, items and rated
cells next to exact counts and sums. Profiles of any set of batches and groups are unions of these
rows, so the extent of the matrix follows the stream without reading a rating twice, at a few
kilobytes per row however many ratings came. ``quality.profile`` is the exact path.

    <table>/batch=<id>         rows of one micro-batch; a replayed batch rewrites them
    <table>/base/version=<id>  everything up to and including that batch
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import workdir

#: Logarithm of the registers of a sketch; 14 has a standard error of about 0.8 percent.
LG_K = 14
#: Distinct things that are estimated, as columns of the ratings.
DISTINCT = {"users": ["user_id"], "items": ["item_id"], "cells": ["user_id", "item_id"]}


def sketches(ratings: DataFrame, by: tuple[str, ...] = (), lg_k: int = LG_K) -> DataFrame:
    """One row per group (one in all without ``by``), combined map-side; no row for no ratings."""
    aggs = []
    for name, columns in DISTINCT.items():
        known = F.lit(True)
        for column in columns:
            known = known & F.col(column).isNotNull()
        value = F.when(known, F.xxhash64(*columns))  # a pair with a null is no cell
        aggs.append(F.hll_sketch_agg(value, F.lit(lg_k)).alias(name))
    rating = F.col("rating").cast("double")
    rows = ratings.groupBy(*by).agg(
        *aggs, F.count(F.lit(1)).alias("ratings"), F.coalesce(F.sum(rating), F.lit(0.0)).alias("total"),
        F.min(rating).alias("lowest"), F.max(rating).alias("highest"),
    )
    return rows.where("ratings > 0")


def merge(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``sketches`` with the groups of ``by`` united; other grouping columns go."""
    united = rows.groupBy(*by).agg(
        *[F.hll_union_agg(name).alias(name) for name in DISTINCT],
        F.sum("ratings").alias("ratings"), F.sum("total").alias("total"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
    )
    return united.where("ratings > 0")


def estimates(rows: DataFrame) -> DataFrame:
    """Groups with (users, items, cells, ratings, mean, lowest, highest, sparsity); distinct counts are estimates."""
    counted = rows.withColumns({name: F.hll_sketch_estimate(name) for name in DISTINCT})
    extent = F.col("users").cast("double") * F.col("items")
    return counted.withColumns(
        {
            "mean": F.col("total") / F.col("ratings"),
            "sparsity": F.when(extent > 0, F.greatest(F.lit(0.0), 1 - F.col("cells") / extent)),
        }
    ).drop("total")


def _rows(spark: SparkSession, table_path: str, up_to: int | None = None, anew: bool = False) -> DataFrame | None:
    """The newest base and the batches after it, as of batch ``up_to``; ``anew`` without a base of that batch."""
    bound = float("inf") if up_to is None else up_to
    bases = [v for v in workdir.list_versions(spark, f"{table_path}/base", "version") if v < bound or (v == bound and not anew)]
    after = bases[-1] if bases else -1
    folders = [f"{table_path}/base/version={after}"] if bases else []
    folders += [
        f"{table_path}/batch={b}" for b in workdir.list_versions(spark, table_path, "batch") if after < b <= bound
    ]
    if not folders:
        return None
    schema = spark.read.parquet(folders[0]).schema  # of the footer: all folders were written alike
    return spark.read.schema(schema).parquet(*folders)


def _compact(spark: SparkSession, table_path: str, batch_id: int, by: tuple[str, ...], keep: int = 2) -> None:
    """One base up to ``batch_id``; a replayed batch still finds the base and batches before it."""
    merge(_rows(spark, table_path, batch_id, anew=True), by).write.mode("overwrite").parquet(f"{table_path}/base/version={batch_id}")
    bases = workdir.list_versions(spark, f"{table_path}/base", "version")
    for version in bases[:-keep]:
        workdir.delete_dir(spark, f"{table_path}/base/version={version}")
    for batch in workdir.list_versions(spark, table_path, "batch"):
        if len(bases) >= keep and batch <= bases[-keep]:
            workdir.delete_dir(spark, f"{table_path}/batch={batch}")


def profile_stream(
    stream: DataFrame,
    table_path: str,
    checkpoint: str,
    by: tuple[str, ...] = (),
    lg_k: int = LG_K,
    trigger: dict | None = None,
    compact_every: int = 16,
):
    """Keep the sketches of a ratings stream (user_id, item_id, rating and the columns of ``by``)."""
    if compact_every < 1:
        raise ValueError("compact_every must be at least 1")
    clash = set(by) & {*DISTINCT, "ratings", "total", "lowest", "highest"}
    if clash:
        raise ValueError(f"{sorted(clash)} cannot be grouping columns")

    def on_batch(ratings: DataFrame, batch_id: int) -> None:
        sketches(ratings, by, lg_k).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _compact(ratings.sparkSession, table_path, batch_id, by)

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_profile(
    spark: SparkSession, table_path: str, by: tuple[str, ...] = (), up_to: int | None = None
) -> DataFrame:
    """Estimates per group of ``by`` (a subset of the stream's), as of batch ``up_to`` or now.

    Batches before the last two bases cannot be told apart any more and are an error.
    """
    rows = _rows(spark, table_path, up_to)
    if rows is None:
        raise ValueError(f"{table_path} holds no batch" + ("" if up_to is None else f" up to {up_to}"))
    return estimates(merge(rows, by))

"""Incremental per-entity counts of a ratings stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.schemas import side_columns

SCHEMA = "id int, n bigint, total bigint"


def rating_counts_stream(stream: DataFrame, side: str = "item") -> DataFrame:
    """Running (id, n, total) per entity: built-in streaming state, one row per id.

    Partial aggregation runs before the shuffle, so a hot id arrives as one row
    per task.
    """
    own, _ = side_columns(side)
    return stream.groupBy(F.col(own).alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").cast("bigint").alias("total")
    )


def _fold(spark: SparkSession, table_path: str, batch_id: int, keep: int = 2) -> None:
    """Write everything up to ``batch_id`` as one base; drop what the base before it covers.

    A base and the batches since the one before it stay, so a batch that is replayed finds
    what it needs.
    """
    current_counts(spark, table_path, batch_id).write.mode("overwrite").parquet(
        f"{table_path}/base/version={batch_id}"
    )
    bases = workdir.list_versions(spark, f"{table_path}/base", "version")
    if len(bases) < keep:
        return
    for version in bases[:-keep]:
        workdir.delete_dir(spark, f"{table_path}/base/version={version}")
    for batch in workdir.list_versions(spark, table_path, "batch"):
        if batch <= bases[-keep]:
            workdir.delete_dir(spark, f"{table_path}/batch={batch}")


def write_counts_stream(
    counts: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None, compact_every: int = 16
):
    """Append the rows that changed in each micro-batch below ``batch=<id>``.

    Every ``compact_every``-th batch folds them into a base, so the folders stay few.
    """
    if compact_every < 1:
        raise ValueError("compact_every must be at least 1")

    def on_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _fold(changed.sparkSession, table_path, batch_id)

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_counts(spark: SparkSession, table_path: str, up_to: int | None = None) -> DataFrame:
    """The latest row of each id as of batch ``up_to`` (or now): newest base, then batches after it."""
    bound = float("inf") if up_to is None else up_to
    bases = [v for v in workdir.list_versions(spark, f"{table_path}/base", "version") if v < bound]
    after = bases[-1] if bases else -1
    batches = [b for b in workdir.list_versions(spark, table_path, "batch") if after < b <= bound]
    rows = None
    if batches:
        rows = spark.read.schema(f"{SCHEMA}, batch bigint").option("basePath", table_path).parquet(
            *[f"{table_path}/batch={b}" for b in batches]
        )
    if bases:
        base = spark.read.schema(SCHEMA).parquet(f"{table_path}/base/version={after}")
        base = base.withColumn("batch", F.lit(after).cast("bigint"))
        rows = base if rows is None else base.unionByName(rows)
    if rows is None:
        return spark.createDataFrame([], SCHEMA)
    latest = F.max_by(F.struct("n", "total"), "batch").alias("latest")
    return rows.groupBy("id").agg(latest).select("id", "latest.n", "latest.total")

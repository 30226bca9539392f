"""Headered ratings text as a stream of files.

The files are one text cut anywhere: a file, and a split of it, may begin inside an item whose
header came earlier. Inside a micro-batch headers are carried down over its splits in order of
file name; the header in force at its end is kept as a one-row table, where the next batch
begins:

    <table>/ratings/batch=<id>   usable lines (user_id, item_id, rating, rated_on)
    <table>/rejects/batch=<id>   the others (line, reason)
    <table>/carry/batch=<id>     header in force after the batch, and the batch's last file

Everything is named after the batch and begins from an earlier one's carry, so a batch that is
replayed writes the same again. Files have to arrive in order of their names; one that comes
too late would continue the wrong item, so it stops the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.schemas import RATINGS, REJECTS
from ridgeline.sources.headered import classified, fill_down, line_columns, with_fields

_CARRY = "header bigint, last_file string"


def _carry_before(spark: SparkSession, table_path: str, batch_id: int) -> tuple[int | None, str]:
    """(header, last file) that a batch begins with."""
    earlier = [b for b in workdir.list_versions(spark, f"{table_path}/carry", "batch") if b < batch_id]
    if not earlier:
        return None, ""
    row = spark.read.schema(_CARRY).parquet(f"{table_path}/carry/batch={earlier[-1]}").first()
    return row["header"], row["last_file"]


def land_batch(batch: DataFrame, batch_id: int, table_path: str) -> None:
    """Parse one micro-batch of (value, file, split_start) and keep where it ends."""
    spark = batch.sparkSession
    header, last_file = _carry_before(spark, table_path, batch_id)
    lines = batch.select(
        *line_columns(F.col("value")), "file", F.xxhash64("file").alias("split_file"), "split_start",
        F.monotonically_increasing_id().alias("pos"),
    ).select("line", "file", "split_file", "split_start", "pos", "header")
    path = workdir.new_run_dir(spark, "headered-batch")
    filled = workdir.write_table(with_fields(fill_down(lines)), path)
    # One row per split: few, whatever the lines.
    ends = filled.groupBy("file", "split_file", "split_start").agg(
        F.max_by("header", F.when(F.col("header").isNotNull(), F.col("pos"))).alias("last_header")
    )
    before = Window.orderBy("file", "split_start").rowsBetween(Window.unboundedPreceding, -1)
    started = F.lit(header).cast("bigint")
    carry = ends.select(
        "split_file", "split_start",
        F.coalesce(F.last("last_header", ignorenulls=True).over(before), started).alias("carried"),
    )
    place = F.struct("file", "split_start")
    facts = ends.agg(
        F.min("file").alias("first_file"),
        F.max("file").alias("last_file"),
        F.max_by("last_header", F.when(F.col("last_header").isNotNull(), place)).alias("header"),
        F.countDistinct("file").alias("files"),
        F.countDistinct("split_file").alias("prints"),
    ).first()
    if facts["files"]:
        if facts["first_file"] <= last_file:
            raise ValueError(f"{facts['first_file']} arrived after {last_file}")
        if facts["files"] != facts["prints"]:
            raise ValueError("two input file names share a hash; rename one of them")
        header = header if facts["header"] is None else facts["header"]
        last_file = facts["last_file"]
    parsed = classified(filled.join(carry, ["split_file", "split_start"]))
    good = parsed.where("reason is null and not is_header").select(*RATINGS.fieldNames())
    good.write.mode("overwrite").parquet(f"{table_path}/ratings/batch={batch_id}")
    bad = parsed.where("reason is not null").select(*REJECTS.fieldNames())
    bad.write.mode("overwrite").parquet(f"{table_path}/rejects/batch={batch_id}")
    end = spark.createDataFrame([(header, last_file)], _CARRY).coalesce(1)
    end.write.mode("overwrite").parquet(f"{table_path}/carry/batch={batch_id}")
    workdir.delete_dir(spark, path)
    for old in workdir.list_versions(spark, f"{table_path}/carry", "batch"):
        if old < batch_id - 1:
            workdir.delete_dir(spark, f"{table_path}/carry/batch={old}")


def headered_stream(
    spark: SparkSession,
    path: str,
    table_path: str,
    checkpoint: str,
    max_files_per_trigger: int | None = None,
    trigger: dict | None = None,
):
    """Start landing the files below ``path``; ``landed_ratings`` reads the result."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start")
    )
    return (
        lines.writeStream.foreachBatch(lambda batch, batch_id: land_batch(batch, batch_id, table_path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _landed(spark: SparkSession, table_path: str, kind: str, schema) -> DataFrame:
    """Batches whose carry, written last, is there or was followed by another's."""
    carries = workdir.list_versions(spark, f"{table_path}/carry", "batch")
    done = [b for b in workdir.list_versions(spark, f"{table_path}/{kind}", "batch") if carries and b <= carries[-1]]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table_path}/{kind}/batch={b}" for b in done])


def landed_ratings(spark: SparkSession, table_path: str) -> DataFrame:
    """All ratings that have arrived (user_id, item_id, rating, rated_on)."""
    return _landed(spark, table_path, "ratings", RATINGS)


def landed_rejects(spark: SparkSession, table_path: str) -> DataFrame:
    """All unusable lines that have arrived (line, reason)."""
    return _landed(spark, table_path, "rejects", REJECTS)

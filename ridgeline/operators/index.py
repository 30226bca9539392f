"""Dense positions: the order-preserving numbering 0, 1, 2, ... of ids or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline import workdir


def _offsets(counts: DataFrame, *order: str) -> DataFrame:
    """Start position of each group. ``counts`` has one row per partition or split."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def dense_index(ids: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): position of each distinct id in ascending order.

    Ids are range-partitioned and sorted once and written, so that the positions
    counted per partition and the offsets between partitions agree.
    """
    spark = ids.sparkSession
    placed = (
        ids.select(col)
        .distinct()
        .repartitionByRange(col)
        .sortWithinPartitions(col)
        .select(col, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"))
    )
    placed = workdir.write_table(placed, workdir.new_run_dir(spark, "index"))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    offsets = _offsets(counts, "part")  # one row per range partition
    return placed.join(F.broadcast(offsets), "part").select(
        col, (F.col("offset") + F.col("pos") - F.col("first")).alias(out)
    )


def numbered_lines(spark, path: str) -> DataFrame:
    """(line_no, value) of text files read in name order.

    Lines of a split keep their order, so only one row per split is needed to
    number all of them. The lines are written with the splits of one pass; the
    offsets come from that table.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("pos"),
    )
    lines = workdir.write_table(lines, workdir.new_run_dir(spark, "numbered-lines"))
    counts = lines.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")
    )
    offsets = workdir.write_table(
        _offsets(counts, "file", "start"), workdir.new_run_dir(spark, "line-offsets")
    )
    if offsets.count() * 256 <= 64 << 20:
        offsets = F.broadcast(offsets)
    number = F.col("offset") + F.col("pos") - F.col("first")
    lost = F.raise_error(F.concat(F.lit("no split starts at "), F.col("start").cast("string")))
    return lines.join(offsets, ["file", "start"], "left").select(
        F.coalesce(number, lost.cast("bigint")).alias("line_no"), "value"
    )

"""Headered ratings text: ``item:`` lines followed by ``user,rating,date`` lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.operators import skew
from ridgeline.operators.quality import split_rejects

MODES = ("failfast", "quarantine")
_NONE = -(1 << 62)  # no header seen yet in this split
_BAD = -(1 << 61)  # a header that is not a number
_CARRY_ROW_BYTES = 64
_CARRY_BROADCAST_LIMIT = 64 << 20


def line_columns(value: Column) -> list[Column]:
    """The trimmed line and, if it is a header, its value."""
    line = F.trim(value)
    number = F.get(F.split(line, ":"), F.lit(0)).try_cast("int").cast("bigint")
    return [line.alias("line"), F.when(line.endswith(":"), F.coalesce(number, F.lit(_BAD))).alias("header")]


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Trimmed lines with their split, a unique position and the header value."""
    return spark.read.text(paths).select(
        *line_columns(F.col("value")),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("pos"),
    )


def fill_down(lines: DataFrame) -> DataFrame:
    """Add ``seen``: the latest header of the same split at or before the line.

    Tasks read a split in file order, so a forward fill over Arrow batches does
    it without moving a line; only the last value is kept between batches.
    """

    def kernel(batches):
        split, last = None, _NONE
        for batch in batches:
            if batch.num_rows == 0:
                continue
            files = batch.column("split_file").to_numpy(zero_copy_only=False)
            starts = batch.column("split_start").to_numpy(zero_copy_only=False)
            header = batch.column("header").fill_null(_NONE).to_numpy(zero_copy_only=False)
            new_split = np.r_[
                (files[0], starts[0]) != split,
                (files[1:] != files[:-1]) | (starts[1:] != starts[:-1]),
            ]
            marks = np.where(new_split | (header != _NONE), np.arange(len(header)), -1)
            latest = np.maximum.accumulate(marks)
            seen = np.where(latest >= 0, header[latest], last)
            split, last = (files[-1], starts[-1]), seen[-1]
            columns = [*batch.columns, pa.array(seen, pa.int64(), mask=seen == _NONE)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "seen"])

    schema = (
        "line string, file string, split_file bigint, split_start bigint, pos bigint, header bigint, seen bigint"
    )
    return lines.mapInArrow(kernel, schema)


def with_fields(filled: DataFrame) -> DataFrame:
    """Add what a rating line holds, so that no reader of the table parses its lines again."""
    part = lambda n: F.get("fields", F.lit(n))
    return filled.withColumn("fields", F.split("line", ",")).select(
        *filled.columns,
        (F.trim(F.coalesce(part(1), F.lit(""))) != "").alias("has_rating"),
        part(0).try_cast("int").alias("user_id"),
        part(1).try_cast("smallint").alias("rating"),
        part(2).try_cast("date").alias("rated_on"),
    )


def _carry(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Per split, the header in force where it begins. One row per split."""
    ends = lines.groupBy("file", "split_file", "split_start").agg(
        F.max_by("header", F.when(F.col("header").isNotNull(), F.col("pos"))).alias("last_header")
    )
    before = (
        Window.partitionBy("file")
        .orderBy("split_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        "file", "split_file", "split_start",
        F.last("last_header", ignorenulls=True).over(before).alias("carried"),
    )
    return workdir.write_table(carried, workdir.new_run_dir(spark, "header-carry"))


def scan_headered_lines(spark: SparkSession, paths) -> DataFrame:
    """Every line with its parsed fields and, if it is unusable, the reason.

    Columns: line, is_header, user_id, item_id, rating, rated_on, reason,
    split_file, split_start, pos. A split may begin inside an item's lines, so
    headers are filled down inside the splits first. That one pass over the text
    is written as a table with the splits it saw; the headers in force where the
    splits begin, and everything later, come from the table. How many executors
    there are when the frame is built or used makes no difference.
    """
    lines = _lines(spark, paths).withColumn("split_file", F.xxhash64("file"))
    lines = lines.select("line", "file", "split_file", "split_start", "pos", "header")
    filled = workdir.write_table(with_fields(fill_down(lines)), workdir.new_run_dir(spark, "headered-lines"))
    carry = _carry(spark, filled)
    facts = carry.agg(
        F.count(F.lit(1)).alias("splits"),
        F.countDistinct("file").alias("files"),
        F.countDistinct("split_file").alias("hashes"),
    ).first()
    if facts["files"] != facts["hashes"]:
        raise ValueError("two input file names share a hash; rename one of them")
    carry = carry.select("split_file", "split_start", "carried")
    if facts["splits"] * _CARRY_ROW_BYTES <= _CARRY_BROADCAST_LIMIT:
        carry = F.broadcast(carry)  # else an ordinary join: a key is one split, so bounded

    filled = filled.join(carry.withColumn("found", F.lit(True)), ["split_file", "split_start"], "left")
    lost = F.raise_error(F.concat(F.lit("no split starts at "), F.col("split_start").cast("string")))
    filled = filled.withColumn("carried", F.when(F.col("found"), F.col("carried")).otherwise(lost.cast("bigint")))

    return classified(filled)


def classified(filled: DataFrame) -> DataFrame:
    """Reasons of lines ``with_fields`` that have ``seen`` and, for what precedes it, ``carried``."""
    parsed = filled.select(
        "line",
        F.col("header").isNotNull().alias("is_header"),
        F.col("header"),
        F.coalesce("seen", "carried").alias("item"),
        "has_rating", "user_id", "rating", "rated_on",
        "split_file", "split_start", "pos",
    )
    item = F.col("item")
    header_reason = F.when(F.col("header") == _BAD, "bad_header").when(
        F.col("header") < 0, "negative_id"
    )
    line_reason = (
        F.when(~F.col("has_rating"), "missing_field")
        .when(F.col("user_id").isNull() | F.col("rating").isNull(), "bad_number")
        .when(item.isNull() | (item == _BAD), "no_header")
        .when((F.col("user_id") < 0) | (item < 0), "negative_id")
    )
    return parsed.select(
        "line", "is_header", "user_id",
        F.when(item >= 0, item.cast("int")).alias("item_id"),
        "rating", "rated_on",
        F.when(F.col("is_header"), header_reason).otherwise(line_reason).alias("reason"),
        "split_file", "split_start", "pos",
    )


def read_headered_ratings(spark: SparkSession, paths, mode: str = "failfast") -> DataFrame:
    """Ratings (user_id, item_id, rating, rated_on) of headered text files.

    ``failfast`` raises on the first unusable line when the result is computed;
    ``quarantine`` leaves such lines and repeated pairs out (``split_rejects``
    of ``scan_headered_lines`` returns them).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    raw = scan_headered_lines(spark, paths)
    if mode == "quarantine":
        return split_rejects(raw)[0]
    message = F.concat(F.lit("unusable ratings line ("), F.col("reason"), F.lit("): "), F.col("line"))
    usable = F.when(F.col("reason").isNotNull(), F.raise_error(message).cast("boolean"))
    return raw.filter(usable.otherwise(~F.col("is_header"))).select(
        "user_id", "item_id", "rating", "rated_on"
    )


def write_headered_ratings(ratings: DataFrame, path: str, chunk_rows: int | None = None) -> None:
    """Write ratings as headered text, ordered by item, users ascending."""
    if "rated_on" not in ratings.columns:
        ratings = ratings.withColumn("rated_on", F.lit(None).cast("date"))
    line = F.concat_ws(
        ",", F.col("user_id").cast("string"), F.col("rating").cast("string"),
        F.coalesce(F.col("rated_on").cast("string"), F.lit("")),
    )
    rows = ratings.select("item_id", F.col("user_id").alias("order_key"), line.alias("line"))
    write_headered_lines(rows, path, chunk_rows)


def write_headered_lines(
    lines: DataFrame, path: str, chunk_rows: int | None = None, header: Column | None = None
) -> None:
    """Write (item_id, order_key, line) rows below a header per item.

    One output record is a header with up to about ``chunk_rows`` lines. An item
    with more of them is cut into several records that each repeat the header,
    so no record (and no task) has to hold a hot item whole, and a record never
    depends on the file before it. ``header`` overrides the header text.
    """
    path_of_rows = workdir.new_run_dir(lines.sparkSession, "headered-rows")
    rows = workdir.write_table(lines.select("item_id", "order_key", "line"), path_of_rows)  # read twice below
    hot, limit = skew.find_hot(rows, "item_id", chunk_rows)
    if hot is None:
        rows = rows.withColumn("copies", F.lit(1)).withColumn("chunk", F.lit(0))
    else:
        rows = skew.spread_copies(rows, hot, "item_id", limit, "chunk")
    header = F.col("item_id").cast("string") if header is None else header
    entries = F.array_sort(F.collect_list(F.struct("order_key", "line", "copies")))
    texts = F.flatten(F.transform("entries", lambda e: F.array_repeat(e["line"], e["copies"])))
    # Range partitioning on the grouping keys serves both the grouping and the order.
    records = (
        rows.repartitionByRange("item_id", "chunk")
        .groupBy("item_id", "chunk")
        .agg(entries.alias("entries"))
        .sortWithinPartitions("item_id", "chunk")
        .select(F.concat(header, F.lit(":\n"), F.array_join(texts, "\n")).alias("value"))
    )
    records.write.mode("overwrite").text(path)
    workdir.delete_dir(lines.sparkSession, path_of_rows)

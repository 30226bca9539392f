"""Ratings stored twice, bucketed and sorted by user and by item.

Every later session that fits, refits or scores them reads each side as it lies: the scan already
has the partitioning that sums by entity need, so no rating is shuffled again.

    <path>/user, <path>/item   the same rows, one sorted file per bucket
    <path>/manifest            written last: number of buckets, rating type, rows

A folder without its manifest is unfinished. Tables of the session's catalog point to the folders, and
``open_ratings`` makes them anew where the catalog does not know them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.operators.layout import Layout, SideStats, build_layout, choose_strategy, default_partitions
from ridgeline.operators import skew
from ridgeline.functions import linalg
from ridgeline.operators.quality import checked_ratings, duplicated_pairs, resolve_duplicates
from ridgeline.schemas import side_columns

_MANIFEST = "buckets int, rating string, rows bigint"
SIDES = ("user", "item")


def _name(path: str, side: str) -> str:
    return f"ridgeline_{side}_{hashlib.md5(path.encode()).hexdigest()[:16]}"


class StoredRatings:
    """The two tables of ``path``; made by ``store_ratings`` and ``open_ratings``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, rating: str, rows: int):
        self.spark = spark
        self.path = path
        self.buckets = buckets
        self.rating = rating
        self.rows = rows
        for side in SIDES:
            own, _ = side_columns(side)
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {_name(path, side)} (user_id INT, item_id INT, rating {rating}) USING parquet "
                f"CLUSTERED BY ({own}) SORTED BY ({own}) INTO {buckets} BUCKETS LOCATION '{path}/{side}'"
            )

    def by(self, side: str) -> DataFrame:
        """(user_id, item_id, rating), partitioned and sorted by the side's id."""
        return self.spark.table(_name(self.path, side))

    def stats(self) -> dict[str, SideStats]:
        """Counts of both sides; neither pass moves ratings."""
        found = {}
        for side in SIDES:
            counts = self.by(side).groupBy(side_columns(side)[0]).agg(F.count(F.lit(1)).alias("n"))
            row = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
            found[side] = SideStats(*row)
        return found

    def layout(
        self, side: str, rank: int, strategy: str, num_blocks: int | None, hot_limit: int | None,
        broadcast_limit: int, stats: dict[str, SideStats], kernel: str,
    ) -> Layout:
        """The stored table as a layout, where the counterpart's vectors can be broadcast and no id is hot.

        Otherwise the layout of the ratings is built as for any others.
        """
        own, other = side_columns(side)
        other_side = "item" if side == "user" else "user"
        if strategy == "auto":
            strategy = choose_strategy(stats[other_side].ids, rank, broadcast_limit)
        if strategy != "broadcast" or stats[side].max_per_id > skew.row_limit(hot_limit):
            return build_layout(
                self.by(side), side, rank, strategy, num_blocks, hot_limit, broadcast_limit, stats, kernel
            ).persist()
        rows = self.by(side).select(F.col(own).alias("id"), F.col(other).alias("other_id"), "rating")
        batches = linalg.uses_batches(kernel, rank)
        # Spark may read buckets in pieces where no operator asks for them, so batches are merged by id.
        return Layout(side, "broadcast", self.buckets, rows, ["id"], batches, batches)

    def drop(self) -> None:
        """Delete the tables and the folder."""
        for side in SIDES:
            self.spark.sql(f"DROP TABLE IF EXISTS {_name(self.path, side)}")
        workdir.delete_dir(self.spark, self.path)


def store_ratings(ratings: DataFrame, path: str, buckets: int | None = None, on_duplicate: str = "error") -> StoredRatings:
    """Check the ratings, one row per pair, and store them by both sides (the only shuffles there are)."""
    if on_duplicate == "keep":
        raise ValueError("stored ratings have one row per pair")
    spark = ratings.sparkSession
    rows = resolve_duplicates(checked_ratings(ratings), on_duplicate).select("user_id", "item_id", "rating")
    rows = workdir.write_table(rows, f"{path}/rows")
    total = rows.count()
    if on_duplicate == "error":
        found = duplicated_pairs(rows).limit(1).collect()
        if found:
            row = found[0]
            raise ValueError(f"user {row['user_id']} rated item {row['item_id']} {row['n']} times; choose on_duplicate='last'")
    buckets = buckets or default_partitions(spark, total)
    rating = dict(rows.dtypes)["rating"]
    for side in SIDES:
        own, _ = side_columns(side)
        spark.sql(f"DROP TABLE IF EXISTS {_name(path, side)}")
        placed = rows.repartition(buckets, own).sortWithinPartitions(own)  # one file per bucket
        placed.write.bucketBy(buckets, own).sortBy(own).option("path", f"{path}/{side}").mode("overwrite").format(
            "parquet"
        ).saveAsTable(_name(path, side))
    workdir.delete_dir(spark, f"{path}/rows")
    manifest = spark.createDataFrame([(buckets, rating, total)], _MANIFEST).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return open_ratings(spark, path)


def open_ratings(spark: SparkSession, path: str) -> StoredRatings:
    """Ratings that an earlier session has stored."""
    row = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").first()
    if row is None:
        raise ValueError(f"{path} holds no finished ratings")
    return StoredRatings(spark, path, row["buckets"], row["rating"], row["rows"])

"""Blocks of ids, per-entity rating lists and who needs whose vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.functions.columns import block_of
from ridgeline.operators import skew
from ridgeline.schemas import side_columns


def with_block(df: DataFrame, col: str, num_blocks: int, out: str = "block", place: bool = False) -> DataFrame:
    """Add the block of an id; with ``place`` also lay the rows out by it."""
    blocked = df.withColumn(out, block_of(col, num_blocks).cast("int"))
    return blocked.repartition(num_blocks, out) if place else blocked


def rekey(ratings: DataFrame, side: str, num_partitions: int | None = None) -> DataFrame:
    """Ratings as (id, other_id, rating) seen from one side, clustered by that id.

    Without ``num_partitions`` the exchange is left to adaptive execution, which
    also splits a partition that a hot id makes too large.
    """
    own, other = side_columns(side)
    rows = ratings.select(F.col(own).alias("id"), F.col(other).alias("other_id"), "rating")
    if num_partitions:
        return rows.repartition(num_partitions, "id")
    return rows.hint("rebalance", "id")


def in_blocks(ratings: DataFrame, side: str, max_entries: int | None = None) -> DataFrame:
    """Per entity its (other_id, rating) list: (id, part, entries).

    Entries are sorted by counterpart. An entity with more than ``max_entries``
    ratings (a million by default) is cut into several parts, so a list never
    grows without bound; everyone else has part 0 only.
    """
    own, other = side_columns(side)
    rows = ratings.select(F.col(own).alias("id"), F.col(other).alias("other_id"), "rating")
    rows = workdir.write_table(rows, workdir.new_run_dir(rows.sparkSession, "list-rows"))  # read twice below
    hot, limit = skew.find_hot(rows, "id", max_entries)
    entry = F.struct("other_id", "rating")
    if hot is None:
        lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        return lists.select("id", F.lit(0).alias("part"), "entries")
    rows = skew.spread_copies(rows, hot, "id", limit, "part")
    repeated = F.flatten(F.collect_list(F.array_repeat(entry, F.col("copies"))))
    return rows.groupBy("id", "part").agg(F.array_sort(repeated).alias("entries"))


def out_blocks(ratings: DataFrame, side: str, num_blocks: int) -> DataFrame:
    """Per entity the distinct counterpart blocks that need its vector.

    Pairs (id, block) are made distinct before the list is built, with map-side
    combine, so the list holds at most ``num_blocks`` entries whatever the skew.
    """
    own, other = side_columns(side)
    return (
        ratings.select(F.col(own).alias("id"), block_of(other, num_blocks).cast("int").alias("block"))
        .distinct()
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    )


def dependents_in_block(lists: DataFrame, num_blocks: int) -> DataFrame:
    """For each in-block row and each target block: the counterparts living there.

    (id, part, block, dependent_ids), only for blocks that have any.
    """
    ids = F.transform("entries", lambda e: e["other_id"])
    block = lambda x: F.pmod(x, F.lit(num_blocks))
    return (
        lists.select("id", "part", ids.alias("ids"))
        .select("id", "part", "ids", F.explode(F.array_distinct(F.transform("ids", block))).alias("block"))
        .select(
            "id", "part", F.col("block").cast("int").alias("block"),
            F.filter("ids", lambda x: F.pmod(x, F.lit(num_blocks)) == F.col("block")).alias("dependent_ids"),
        )
    )


def block_stats(ratings: DataFrame, side: str, num_blocks: int, approximate: bool = False) -> DataFrame:
    """(block, ids, ratings): how many entities and ratings each block holds."""
    own, _ = side_columns(side)
    block = block_of(own, num_blocks).cast("int").alias("block")
    if approximate:
        return ratings.groupBy(block).agg(
            F.approx_count_distinct(own).alias("ids"), F.count(F.lit(1)).alias("ratings")
        )
    # An id lives in one block: count per id first, then the ids of a block.
    per_id = ratings.groupBy(own).agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy(block).agg(
        F.count(F.lit(1)).alias("ids"), F.sum("n").alias("ratings")
    )


def comm_volume(ratings: DataFrame, num_blocks: int) -> DataFrame:
    """Vectors shipped per half-step: once per rating, or once per needing block.

    One row per side whose vectors travel: (side, all_to_all, block_to_block).
    """
    rows = []
    for side in ("user", "item"):
        own, other = side_columns(side)
        shipped = ratings.groupBy(own, block_of(other, num_blocks).alias("block")).agg(
            F.count(F.lit(1)).alias("n")
        )
        rows.append(
            shipped.agg(
                F.sum("n").alias("all_to_all"), F.count(F.lit(1)).alias("block_to_block")
            ).select(F.lit(side).alias("side"), "all_to_all", "block_to_block")
        )
    return rows[0].unionByName(rows[1])

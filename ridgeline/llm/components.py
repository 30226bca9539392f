"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouped minimum and a join, and is written to the shared folder; no node's
neighbours are ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.workdir import delete_dir, new_run_dir, write_table


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that itself hangs on none: all is done."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        edges.select("lo", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return seen.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (hi > lo)."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (
        both.where("v > u").join(lowest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    )
    heads = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(heads, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.union(heads.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reached.

    ``edges`` has long columns a and b. Null ends and loops are ignored, repeated edges count
    once, an empty table gives an empty one.
    """
    spark = edges.sparkSession
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    path = new_run_dir(spark, "components")
    current = write_table(current.distinct(), path)
    while not _are_stars(current):
        next_path = new_run_dir(spark, "components")
        current = write_table(_star_round(current), next_path)
        delete_dir(spark, path)
        path = next_path
    heads = current.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(heads)

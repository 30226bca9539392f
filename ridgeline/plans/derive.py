"""Ratings derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.layout import spread_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its buyer: the ungrouped form, with repeats."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey)


def order_ratings(spark: SparkSession, sf_dir: str, dated: bool = False) -> DataFrame:
    """R1: a customer's rating of a part, from the largest quantity bought."""
    aggs = [
        (F.max(F.col("l_quantity").cast("int")) % 5 + 1).cast("smallint").alias("rating")
    ]
    if dated:
        aggs.append(F.max("o_orderdate").cast("date").alias("rated_on"))
    bought = purchases(spark, sf_dir).select(
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("l_partkey").cast("int").alias("item_id"),
        "l_quantity",
        "o_orderdate",
    )
    lines = table(spark, sf_dir, "lineitem").count()  # from the footers
    return spread_rows(bought, lines, "user_id", "item_id").groupBy("user_id", "item_id").agg(*aggs)


def event_ratings(events: DataFrame) -> DataFrame:
    """R2: rating events; works on the static table and on a stream of it."""
    kind = F.col("event_type")
    rating = (
        F.when(kind == "view", 1)
        .when(kind == "click", 2)
        .when(kind == "signup", 4)
        .when(kind == "purchase", 5)
    )
    return events.select(
        F.col("user_id").cast("int").alias("user_id"),
        F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("int").alias("item_id"),
        rating.cast("smallint").alias("rating"),
        F.col("ts").cast("timestamp").alias("rated_at"),
        F.col("event_id").cast("bigint").alias("seq"),
    ).filter(F.col("rating").isNotNull() & F.col("item_id").isNotNull())

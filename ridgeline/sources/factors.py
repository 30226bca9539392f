"""Saving and loading of a fitted model: two factor tables and its parameters."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ridgeline import workdir
from ridgeline.schemas import FACTORS

PARAMS = "rank int, reg double, users bigint, items bigint"


def save_model(model, path: str) -> None:
    """Factor tables range-partitioned and sorted by id, so id lookups can skip files."""
    for side, factors in (("user", model.user_factors), ("item", model.item_factors)):
        ordered = factors.repartitionByRange("id").sortWithinPartitions("id")
        ordered.write.mode("error").parquet(f"{path}/{side}_factors")
    row = [(model.rank, model.reg, model.users, model.items)]
    model.spark.createDataFrame(row, PARAMS).coalesce(1).write.mode("error").parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str):
    from ridgeline.operators.als import ALSModel

    params = spark.read.schema(PARAMS).parquet(f"{path}/params").first()
    user = spark.read.schema(FACTORS).parquet(f"{path}/user_factors")
    item = spark.read.schema(FACTORS).parquet(f"{path}/item_factors")
    return ALSModel(user, item, params["rank"], params["reg"], params["users"], params["items"])


def model_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions below ``path`` whose last-written part (the parameters) is complete."""
    return workdir.list_versions(spark, path, "version", "params/_SUCCESS")

"""Ratings as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.schemas import RATING_EVENTS


def read_ratings_stream(
    spark: SparkSession,
    path: str | None = None,
    schema=RATING_EVENTS,
    file_format: str = "parquet",
    max_files_per_trigger: int | None = None,
    **options,
) -> DataFrame:
    """A streaming DataFrame of rating events, from the beginning of the source.

    With ``path``: files of ``file_format`` and ``schema``. Without: a message
    log given by Kafka options (``subscribe``, bootstrap servers, ...), whose
    JSON values are parsed with ``schema``; the connector must be on the class
    path.
    """
    if path is not None:
        reader = spark.readStream.format(file_format).schema(schema).options(**options)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.load(path)
    reader = spark.readStream.format("kafka").option("startingOffsets", "earliest")
    messages = reader.options(**options).load()
    parsed = F.from_json(F.col("value").cast("string"), schema).alias("event")
    return messages.select(parsed).select("event.*")

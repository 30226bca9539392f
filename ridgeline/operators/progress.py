"""What a fit has finished, kept in a folder so that another run can go on from it.

    <path>/<side>-factors-<i>          vectors of iteration i
    <path>/committed/iteration=<i>     written last: both sides of iteration i are complete

A manifest holds the parameters and a print of the ratings. A run that finds a manifest of
other parameters or other ratings is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.schemas import FACTORS

_MANIFEST = "rank int, reg double, seed bigint, on_duplicate string, ratings bigint, print bigint"
SIDES = ("item", "user")


def ratings_print(ratings: DataFrame) -> int:
    """A number that other ratings hardly share; ``ratings`` has one row per pair."""
    row = ratings.agg(F.bit_xor(F.xxhash64(*ratings.columns))).first()
    return row[0] or 0


class FitLog:
    """The tables of one fit below ``path``; ``facts`` are the values of its manifest."""

    def __init__(self, spark: SparkSession, path: str, facts: tuple):
        self.spark = spark
        self.path = path
        self.facts = facts

    def iterations(self) -> list[int]:
        return workdir.list_versions(self.spark, f"{self.path}/committed", "iteration")

    def last(self) -> int:
        """The last committed iteration, 0 if there is none."""
        done = self.iterations()
        if not done:
            return 0
        row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/committed/iteration={done[-1]}").first()
        names = [field.split()[0] for field in _MANIFEST.split(", ")]
        other = [f"{n} {was!r} instead of {now!r}" for n, was, now in zip(names, row, self.facts) if was != now]
        if other:
            raise ValueError(f"{self.path} holds another fit: {', '.join(other)}")
        return done[-1]

    def factors(self, side: str, iteration: int) -> DataFrame:
        return self.spark.read.schema(FACTORS).parquet(f"{self.path}/{side}-factors-{iteration}")

    def write(self, parts: list[DataFrame], side: str, iteration: int) -> DataFrame:
        """Vectors as a table, one part after the other; what a broken-off run left in its place goes first."""
        path = f"{self.path}/{side}-factors-{iteration}"
        workdir.delete_dir(self.spark, path)
        for part in parts:
            part.write.mode("append").parquet(path)
        return self.spark.read.schema(parts[0].schema).parquet(path)

    def commit(self, iteration: int, keep: int = 0) -> None:
        """Both sides are complete; tables of earlier iterations but ``keep`` are not needed any more."""
        earlier = self.iterations()
        row = self.spark.createDataFrame([self.facts], _MANIFEST).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/committed/iteration={iteration}")
        for old in earlier:
            if old < iteration and old != keep:
                for side in SIDES:
                    workdir.delete_dir(self.spark, f"{self.path}/{side}-factors-{old}")
                workdir.delete_dir(self.spark, f"{self.path}/committed/iteration={old}")

"""Completeness gate: which entities lack a counterpart vector, and what a half-step solved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ridgeline.operators.skew import join_vectors
from ridgeline.schemas import side_columns


def missing_vectors(ratings: DataFrame, factors: DataFrame, side: str, **options) -> DataFrame:
    """(id, expected, received) of entities that cannot be solved completely."""
    own, other = side_columns(side)
    rows = ratings.select(F.col(own).alias("id"), F.col(other).alias("other_id"))
    present = factors.select(F.col("id").alias("other_id"), F.lit(1).alias("there"))
    joined = join_vectors(rows, present, "other_id", "id", how="left", row_bytes=16, **options)
    return (
        joined.groupBy("id")
        .agg(F.count(F.lit(1)).alias("expected"), F.count("there").alias("received"))
        .filter(F.col("received") < F.col("expected"))
    )


def latest_factors(versions: DataFrame, version: str = "version") -> DataFrame:
    """One vector per id out of several versions: the last one wins."""
    return versions.groupBy("id").agg(F.max_by("features", version).alias("features"))


class HalfStep:
    """Observes one half-step while it runs: no job of its own.

    Complete means one vector per id, every rating met by its counterpart's vector, and
    nothing but finite numbers.
    """

    def __init__(self, side: str, iteration: int, ids: int, ratings: int):
        self.name = f"{side} half-step of iteration {iteration}"
        self.ids = ids
        self.ratings = ratings
        self.seen: list[Observation] = []

    def watched(self, solved: DataFrame) -> DataFrame:
        """``solved`` (id, features, n) as (id, features); called once per pass of the half-step."""
        broken = F.exists("features", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
        self.seen.append(Observation())
        return solved.observe(
            self.seen[-1],
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("received"),
            F.coalesce(F.sum(broken.cast("int")), F.lit(0)).alias("broken"),
        ).select("id", "features")

    def checked(self) -> int:
        """Vectors solved, once the queries have run; raises if the half-step was not complete."""
        passes = [seen.get for seen in self.seen]
        found = {name: sum(p[name] for p in passes) for name in ("rows", "received", "broken")}
        for what, got, wanted in (
            ("vectors", found["rows"], self.ids),
            ("ratings with a counterpart's vector", found["received"], self.ratings),
            ("vectors that are not finite", found["broken"], 0),
        ):
            if got != wanted:
                raise ValueError(f"{self.name}: {got} {what}, expected {wanted}")
        return found["rows"]

"""Physical layouts of the ratings for one half-step.

The ratings never change while the factors do, so each side gets one layout
that is partitioned once, persisted, and met by the factors every iteration:

* ``broadcast``: ratings clustered by the entity being solved, counterpart
  factors broadcast (only under a size limit). A half-step has no shuffle.
* ``shuffle``: ratings clustered by the counterpart id; one vector row per
  counterpart (and part) moves to its ratings, partial sums move to the entity.
* ``blocks``: ratings clustered by the entity's block; a counterpart vector is
  shipped once per block that needs it, and everything else is local. Blocks of more rows
  than a task should hold are cut into finer ones, each of ids of one block only.

A hot entity (or counterpart) is cut into parts, so no task holds more than
about ``hot_limit`` of its rows; the partial systems are added up by id.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import linalg
from ridgeline.functions.columns import block_of, features_to_columns
from ridgeline.operators import skew
from ridgeline.operators.quality import checked_ratings
from ridgeline.schemas import side_columns

STRATEGIES = ("auto", "broadcast", "shuffle", "blocks")
ROWS_PER_PARTITION = 2_000_000
MIN_ROWS_PER_PARTITION = 20_000
BROADCAST_LIMIT = 64 << 20
#: What one query may shuffle of rows that carry vectors; more is done in several passes.
PASS_BYTES = 8 << 30


@dataclass(frozen=True)
class SideStats:
    """Counted facts about one side of the ratings."""

    ids: int
    ratings: int
    max_per_id: int


def side_counts(ratings: DataFrame, side: str) -> DataFrame:
    own, _ = side_columns(side)
    return ratings.groupBy(F.col(own).alias("id")).agg(F.count(F.lit(1)).alias("n"))


def ratings_stats(ratings: DataFrame) -> dict[str, SideStats]:
    """Counts of both sides in one job; two rows come back."""
    parts = [
        side_counts(ratings, side).agg(
            F.lit(side).alias("side"),
            F.count(F.lit(1)).alias("ids"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("ratings"),
            F.coalesce(F.max("n"), F.lit(0)).alias("max_per_id"),
        )
        for side in ("user", "item")
    ]
    return {
        row["side"]: SideStats(row["ids"], row["ratings"], row["max_per_id"])
        for row in parts[0].unionByName(parts[1]).collect()
    }


def default_partitions(spark: SparkSession, total: int) -> int:
    """Enough partitions for bounded task size, no more than useful on small data."""
    by_size = -(-total // ROWS_PER_PARTITION)
    useful = -(-total // MIN_ROWS_PER_PARTITION)
    return max(by_size, min(spark.sparkContext.defaultParallelism, useful), 1)


def spread_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows, partitioned by ``keys`` if a task of the session's partitions would hold too many.

    Adaptive execution joins partitions of a grouping or sort but cannot cut them.
    """
    wanted = -(-rows // ROWS_PER_PARTITION)
    return df.repartition(wanted, *keys) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def block_partitions(num_blocks: int, total: int) -> int:
    """``num_blocks``, or a multiple that cuts every block alike when blocks hold too many rows for a task."""
    return num_blocks * max(1, -(-total // (ROWS_PER_PARTITION * num_blocks)))


def vector_bytes(rows: int, rank: int) -> int:
    """Shuffled bytes of that many rows with a vector each."""
    return rows * (8 * rank + 32)


def passes_for(shuffled: int) -> int:
    """Queries into which a job that shuffles so many bytes is cut."""
    return max(1, -(-shuffled // PASS_BYTES))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def block_partitioning(spark: SparkSession):
    """Let a join on (block, id) use data already partitioned by block."""
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def adaptive_cache(spark: SparkSession):
    """Let adaptive execution merge small partitions of what is cached."""
    return _setting(spark, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")


def fixed_partitioning(spark: SparkSession):
    """Plan a cached layout without adaptive execution.

    An adaptive plan does not tell its partitioning before it has run, and the
    half-steps planned on top of it would shuffle the ratings again.
    """
    return _setting(spark, "spark.sql.adaptive.enabled", "false")


def shuffle_cleanup(spark: SparkSession):
    """Delete the shuffle files of a query when it has ended, not when the driver next collects garbage.

    What is cached stays, and a lost part of it is computed anew from its sources.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@dataclass
class Layout:
    side: str
    strategy: str
    partitions: int
    data: DataFrame
    group_keys: list[str]
    merge: bool
    batches: bool = False
    hot_other: DataFrame | None = None
    routes: DataFrame | None = None
    hot: DataFrame | None = None

    def persist(self) -> "Layout":
        with fixed_partitioning(self.data.sparkSession):
            for df in (self.data, self.routes, self.hot_other):
                if df is not None:
                    df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for df in (self.data, self.routes, self.hot_other):
            if df is not None:
                df.unpersist()

    def passes(self, shipped: int) -> int:
        """Passes over groups of whole blocks in which a half-step that ships so many bytes is done.

        The parts of a hot id lie in several blocks, so a layout that merges parts has one pass.
        """
        if self.strategy != "blocks" or self.merge:
            return 1
        return min(self.partitions, passes_for(shipped))

    def only(self, turn: int, passes: int) -> "Layout":
        """The blocks of one of several passes."""
        if passes == 1:
            return self
        low, high = (self.partitions * t // passes for t in (turn, turn + 1))
        here = lambda block: (block >= low) & (block < high)
        routes = self.routes.withColumn("blocks", F.filter("blocks", here))
        return replace(self, data=self.data.where(here(F.col("block"))), routes=routes)

    def joined(self, factors: DataFrame, rank: int) -> DataFrame:
        """Each rating next to its counterpart's vector."""
        columns = [F.col("features")] if self.batches else features_to_columns("features", rank, "f")
        vectors = factors.select(F.col("id").alias("other_id"), *columns)
        if self.strategy == "broadcast":
            return self.data.join(F.broadcast(vectors), "other_id")
        if self.strategy == "shuffle":
            keys = ["other_id"]
            if self.hot_other is not None:
                vectors = skew.replicate(vectors, self.hot_other, "other_id", "other_part")
                keys = ["other_id", "other_part"]
            vectors = vectors.repartition(self.partitions, *keys)
            return self.data.join(vectors.hint("merge"), keys)
        shipped = (
            vectors.join(self.routes, "other_id")
            .withColumn("block", F.explode("blocks"))
            .drop("blocks")
            .repartitionById(self.partitions, F.col("block"))
        )
        return self.data.join(shipped.hint("merge"), ["block", "other_id"])

    def _by_id(self, factors: DataFrame, rank: int) -> DataFrame:
        """Joined rows sorted by id within partitions, for the batch kernels."""
        joined = self.joined(factors, rank)
        if self.strategy == "shuffle":
            keys = ["id", "part"] if self.merge else ["id"]
            joined = joined.repartition(self.partitions, *keys)
        # A sort below the join is dropped by the optimiser; one above it is only
        # planned where the order is not there already.
        return joined.sortWithinPartitions("id")

    def systems(self, factors: DataFrame, rank: int) -> DataFrame:
        """The regularisation-free normal equations of every entity."""
        if self.batches:
            rows = self._by_id(factors, rank)
            return linalg.packed_systems(rows, rank, self.partitions if self.merge else None)
        summed = linalg.sum_systems(self.joined(factors, rank), self.group_keys, rank)
        if self.merge and self.strategy != "shuffle":
            return linalg.merge_systems(summed, rank)
        return summed.drop("block")

    def step(self, factors: DataFrame, rank: int, reg: float, counts: bool = False) -> DataFrame:
        """Solve this side for fixed counterpart factors; ``counts`` adds the ratings met per id."""
        if self.batches and not self.merge:
            return linalg.solve_joined(self._by_id(factors, rank), rank, reg, counts)
        return linalg.solve_factors(self.systems(factors, rank), rank, reg, counts)


def choose_strategy(other_ids: int, rank: int, broadcast_limit: int) -> str:
    return "broadcast" if other_ids * (8 * rank + 16) <= broadcast_limit else "blocks"


def build_layout(
    ratings: DataFrame,
    side: str,
    rank: int,
    strategy: str = "auto",
    num_blocks: int | None = None,
    hot_limit: int | None = None,
    broadcast_limit: int = BROADCAST_LIMIT,
    stats: dict[str, SideStats] | None = None,
    kernel: str = "auto",
) -> Layout:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    batches = linalg.uses_batches(kernel, rank)
    own, other = side_columns(side)
    other_side = "user" if side == "item" else "item"
    stats = stats or ratings_stats(ratings)
    own_stats, other_stats = stats[side], stats[other_side]
    if strategy == "auto":
        strategy = choose_strategy(other_stats.ids, rank, broadcast_limit)

    if num_blocks:
        partitions = block_partitions(num_blocks, own_stats.ratings)
    else:
        partitions = default_partitions(ratings.sparkSession, own_stats.ratings)
    limit = skew.row_limit(hot_limit)
    extra = [c for c in ("weight",) if c in ratings.columns]
    rows = ratings.select(F.col(own).alias("id"), F.col(other).alias("other_id"), "rating", *extra)

    # Sums over entities combine map-side under ``shuffle``; batch kernels do not.
    own_hot = None
    cut = own_stats.max_per_id > limit and (strategy != "shuffle" or batches)
    if cut:
        own_hot = skew.hot_ids(side_counts(ratings, side), "id", limit)
        rows = skew.spread(rows, own_hot, "id", "other_id", "part")

    if strategy == "shuffle":
        hot = None
        keys = ["other_id"]
        if other_stats.max_per_id > limit:
            counts = side_counts(ratings, other_side).withColumnRenamed("id", "other_id")
            hot = skew.hot_ids(counts, "other_id", limit)
            rows = skew.spread(rows, hot, "other_id", "id", "other_part")
            keys = ["other_id", "other_part"]
        data = rows.repartition(partitions, *keys).sortWithinPartitions(*keys)
        return Layout(side, strategy, partitions, data, ["id"], cut, batches, hot_other=hot)

    if strategy == "broadcast":
        keys = ["id", "part"] if cut else ["id"]
        data = rows.repartition(partitions, *keys).sortWithinPartitions("id")
        return Layout(side, strategy, partitions, data, keys, cut, batches, hot=own_hot)

    # Part p of a hot entity is worked on in the p-th block after its own.
    home = F.col("id") + F.col("part") if cut else F.col("id")
    rows = rows.withColumn("block", block_of(home.cast("bigint"), partitions).cast("int"))
    data = (
        rows.drop("part")
        .repartitionById(partitions, F.col("block"))  # one block to a partition
        .sortWithinPartitions("block", "other_id")
    )
    # Distinct targets are found where the ratings already are, then gathered per id.
    routes = (
        data.select("block", "other_id")
        .groupBy("block", "other_id")
        .agg(F.lit(1).alias("needed"))
        .groupBy("other_id")
        .agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    )
    return Layout(side, strategy, partitions, data, ["block", "id"], cut, batches, routes=routes, hot=own_hot)


def half_step(
    ratings: DataFrame,
    factors: DataFrame,
    side: str,
    rank: int,
    reg: float,
    strategy: str = "auto",
    num_blocks: int | None = None,
    **options,
) -> DataFrame:
    """One half-step: new factors of ``side`` for fixed counterpart ``factors``."""
    layout = build_layout(checked_ratings(ratings), side, rank, strategy, num_blocks, **options)
    return layout.step(factors, rank, reg)


def normal_equations(
    ratings: DataFrame, factors: DataFrame, side: str, rank: int, strategy: str = "auto", **options
) -> DataFrame:
    return build_layout(checked_ratings(ratings), side, rank, strategy, **options).systems(factors, rank)

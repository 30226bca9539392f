"""Alternating least squares as a driver loop over DataFrame half-steps."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.functions.linalg import KERNELS
from ridgeline.operators import evaluate as ev
from ridgeline.operators import gradient, predict
from ridgeline.operators.gate import HalfStep
from ridgeline.operators.holdout import TRACE_SCHEMA as HELD_OUT_SCHEMA
from ridgeline.operators.holdout import Progress, Stop
from ridgeline.operators.init import initial_features
from ridgeline.operators.layout import (
    BROADCAST_LIMIT,
    STRATEGIES,
    adaptive_cache,
    block_partitioning,
    build_layout,
    passes_for,
    ratings_stats,
    shuffle_cleanup,
    vector_bytes,
)
from ridgeline.operators.progress import FitLog, ratings_print
from ridgeline.operators.quality import ON_DUPLICATE, checked_ratings, combine_repeats, resolve_duplicates

TRACE_SCHEMA = "iteration int, mse double, rmse double, objective double"
SOLVERS = ("direct", "gradient")
METRICS_SCHEMA = "iteration int, side string, rows bigint, seconds double"


class ALSModel:
    """Factor tables of one run and what can be computed from them.

    ``user_factors`` and ``item_factors`` are tables (id, features); the user
    factors were solved last, against exactly these item factors. ``ratings``
    are the fitted ones, one row per pair.
    """

    def __init__(self, user_factors, item_factors, rank, reg, users, items, path=None, ratings=None):
        self.user_factors = user_factors
        self.item_factors = item_factors
        self.rank = rank
        self.reg = reg
        self.users = users
        self.items = items
        self.path = path
        self.ratings = ratings
        self.trace: DataFrame | None = None
        self.metrics: DataFrame | None = None
        self.held_out: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.user_factors.sparkSession

    def assert_complete(self, expected_users: int | None = None, expected_items: int | None = None):
        """Raise unless there is exactly one vector per expected id."""
        for side, factors, known, expected in (
            ("user", self.user_factors, self.users, expected_users),
            ("item", self.item_factors, self.items, expected_items),
        ):
            row = factors.agg(
                F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")
            ).first()
            if row["n"] != row["ids"]:
                raise ValueError(f"{side} factors hold {row['n'] - row['ids']} repeated ids")
            wanted = known if expected is None else expected
            if row["n"] != wanted:
                raise ValueError(f"expected {wanted} {side} vectors, found {row['n']}")
        return self

    def predict_pairs(self, pairs: DataFrame, cold_start: str = "nan", **options) -> DataFrame:
        return predict.predict_pairs(self, pairs, cold_start, **options)

    def predict_all(self, users=None, items=None, **options) -> DataFrame:
        return predict.predict_all(self, users, items, **options)

    def predict_rows(self, **options) -> DataFrame:
        return predict.predict_rows(self, **options)

    def recommend(self, k: int = 10, exclude_rated: bool = True, ratings=None, **options) -> DataFrame:
        return predict.recommend(self, k, exclude_rated, ratings, **options)

    def evaluate(self, ratings: DataFrame, **options) -> DataFrame:
        return ev.evaluate(self.user_factors, self.item_factors, ratings, self.rank, **options)

    def objective(self, ratings: DataFrame, **options) -> DataFrame:
        return ev.objective(
            self.user_factors, self.item_factors, ratings, self.rank, self.reg, **options
        )

    def save(self, path: str) -> None:
        from ridgeline.sources.factors import save_model

        save_model(self, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ALSModel":
        from ridgeline.sources.factors import load_model

        return load_model(spark, path)

    def release(self) -> None:
        """Delete the run folder of a fitted model; its tables are gone after this."""
        if self.path:
            workdir.delete_dir(self.spark, self.path)
            self.path = None


class ALSFactorizer:
    """ALS with count-weighted ridge regularisation and deterministic start.

    Each iteration solves the items for fixed users, then the users for fixed
    items; entity x with n_x ratings gets x = (F'F + reg * n_x * I)^-1 F'r. The ``direct`` solver forms
    the systems; ``gradient`` searches from the factors of the iteration before without forming
    them, for ranks whose square is too much to send, and writes every iteration.
    """

    def __init__(
        self,
        rank: int = 10,
        reg: float = 0.05,
        max_iter: int = 10,
        num_blocks: int | None = None,
        strategy: str = "auto",
        seed: int = 0,
        on_duplicate: str = "error",
        broadcast_limit: int = BROADCAST_LIMIT,
        hot_limit: int | None = None,
        kernel: str = "auto",
        checkpoint_interval: int = 3,
        solver: str = "direct",
    ):
        if rank < 1:
            raise ValueError("rank must be at least 1")
        if reg <= 0:
            raise ValueError("reg must be positive, or a small group is singular")
        if max_iter < 1:
            raise ValueError("max_iter must be at least 1")
        if num_blocks is not None and num_blocks < 1:
            raise ValueError("num_blocks must be at least 1")
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
        if on_duplicate not in ON_DUPLICATE:
            raise ValueError(f"on_duplicate must be one of {ON_DUPLICATE}, got {on_duplicate!r}")
        if kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {KERNELS}, got {kernel!r}")
        if checkpoint_interval < 1:
            raise ValueError("checkpoint_interval must be at least 1")
        if solver not in SOLVERS:
            raise ValueError(f"solver must be one of {SOLVERS}, got {solver!r}")
        if solver == "gradient" and (strategy == "shuffle" or kernel == "sums"):
            raise ValueError("the gradient solver needs strategy 'broadcast' or 'blocks' and batches")
        self.rank = rank
        self.reg = reg
        self.max_iter = max_iter
        self.kernel = "batches" if solver == "gradient" else kernel
        self.solver = solver
        self.checkpoint_interval = checkpoint_interval
        self.num_blocks = num_blocks
        self.strategy = strategy
        self.seed = seed
        self.on_duplicate = on_duplicate
        self.broadcast_limit = broadcast_limit
        self.hot_limit = hot_limit

    def fit(
        self,
        ratings: DataFrame,
        trace: bool = False,
        metrics: bool = False,
        expected_users: int | None = None,
        expected_items: int | None = None,
        resume: str | None = None,
        on_iteration: Callable[[int], None] | None = None,
        stop: Stop | None = None,
    ) -> ALSModel:
        """Fit, and with ``resume`` go on from what an earlier fit committed in that folder.

        The folder must be one that all executors reach; it is created if there is nothing in
        it. ``on_iteration`` is called after each iteration has been committed; a fit that it
        breaks off can be resumed.

        With ``stop`` the fit ends before ``max_iter`` when the error on cells held out of
        ``ratings`` has ceased to fall; the model is the one before that, and ``model.held_out`` has
        both errors of each iteration. A folder does not hold these errors, so ``resume`` is refused.
        """
        if stop is not None and resume is not None:
            raise ValueError("a fit with a stopping rule cannot be resumed")
        spark = ratings.sparkSession
        source = resolve_duplicates(checked_ratings(ratings), self.on_duplicate)
        base = source.select("user_id", "item_id", "rating")
        if self.on_duplicate == "keep":
            base = combine_repeats(base)
        with adaptive_cache(spark):
            base = base.persist(StorageLevel.MEMORY_AND_DISK)
        layouts = []
        try:
            with shuffle_cleanup(spark):
                stats = ratings_stats(base)
            users, items, total = stats["user"].ids, stats["item"].ids, stats["user"].ratings
            for what, found, wanted in (("users", users, expected_users), ("items", items, expected_items)):
                if wanted is not None and found != wanted:
                    raise ValueError(f"expected {wanted} {what}, found {found}")
            if total == 0:
                raise ValueError("no ratings to fit")
            by_user, by_item = layouts = [
                build_layout(
                    base, side, self.rank, self.strategy, self.num_blocks, self.hot_limit,
                    self.broadcast_limit, stats, self.kernel,
                ).persist()
                for side in ("user", "item")
            ]
            with block_partitioning(spark), shuffle_cleanup(spark):
                if self.on_duplicate == "error":
                    _assert_unique(by_user)
                return self._iterate(
                    spark, base, source, by_user, by_item, total, users, items, trace, metrics, resume,
                    on_iteration, stop,
                )
        finally:
            for layout in layouts:
                layout.unpersist()
            base.unpersist()

    def _iterate(
        self, spark, base, source, by_user, by_item, total, users, items, trace, metrics, resume, on_iteration, stop
    ):
        """Each half-step is planned on the one before it, which is marked to be kept. Every
        ``checkpoint_interval`` iterations, and at the end, both sides are written to the run's
        folder: one query runs the half-steps since the last tables, each as the broadcast or
        exchange that the next one needs. There is no other job. With a trace, metrics, a
        callback or a stopping rule every iteration is written.

        What a half-step solved is observed while it runs: a vector per id, every rating met,
        all values finite.

        A half-step that ships more vectors than a query should hold on disk is written block by block
        in several passes, and then every iteration is written.
        """
        search = self.solver == "gradient"
        ids = {"user": users, "item": items}
        others = {"user": items, "item": users}
        shipped = {
            layout.side: vector_bytes(min(total, others[layout.side] * layout.partitions), self.rank)
            for layout in (by_item, by_user) if layout.strategy == "blocks"
        }
        large = passes_for(2 * self.checkpoint_interval * max(shipped.values(), default=0)) > 1
        every = 1 if trace or metrics or on_iteration or search or stop or large else self.checkpoint_interval
        weighted = "weight" in base.columns
        expected = base.agg(F.sum("weight")).first()[0] if weighted else total
        facts = (self.rank, self.reg, self.seed, self.on_duplicate, total, ratings_print(base) if resume else 0)
        log = FitLog(spark, resume or workdir.new_run_dir(spark, "als"), facts)
        trace_rows, metric_rows = [], []
        scored = source if weighted else base
        user, item, done = self._start(by_user), None, log.last() if resume else 0
        if done > self.max_iter:
            raise ValueError(f"{resume} holds iteration {done}, after the {self.max_iter} that are asked for")
        if done:
            user, item = log.factors("user", done), log.factors("item", done)
        elif large:  # every pass reads it
            user = workdir.write_table(user, f"{log.path}/start-{uuid.uuid4().hex[:12]}")

        progress = None
        if stop is not None:
            held_out = resolve_duplicates(checked_ratings(stop.held_out), self.on_duplicate)
            progress = Progress(stop, scored, held_out, self.rank, self.broadcast_limit)
        waiting: list[HalfStep] = []
        held: list[DataFrame] = []
        for iteration in range(done + 1, self.max_iter + 1):
            commit = iteration % every == 0 or iteration == self.max_iter
            for layout in (by_item, by_user):
                started = time.perf_counter()
                step = HalfStep(layout.side, iteration, ids[layout.side], expected)
                fixed, before = (user, item) if layout is by_item else (item, user if iteration > 1 else None)
                if search:
                    path = workdir.new_run_dir(spark, "gradient")
                    solved = [gradient.solve(layout, fixed, self.rank, self.reg, path, start=before)]
                else:
                    passes = layout.passes(shipped.get(layout.side, 0)) if commit else 1
                    turns = [layout.only(turn, passes) for turn in range(passes)]
                    solved = [turn.step(fixed, self.rank, self.reg, counts=True) for turn in turns]
                parts = [step.watched(part) for part in solved]
                waiting.append(step)
                if commit:
                    found = log.write(parts, layout.side, iteration)
                    if search:
                        workdir.delete_dir(spark, path)
                    while waiting:
                        rows = waiting.pop(0).checked()
                    metric_rows.append((iteration, layout.side, rows, time.perf_counter() - started))
                else:
                    held.append(found := parts[0].persist(StorageLevel.MEMORY_AND_DISK))
                if layout is by_item:
                    item = found
                else:
                    user = found
            if not commit:
                continue
            log.commit(iteration, progress.best if progress else 0)
            while held:  # both sides are tables now; nothing reads what came before
                held.pop().unpersist()
            if trace:
                row = ev.objective(
                    user, item, scored, self.rank, self.reg, broadcast_limit=self.broadcast_limit
                ).first()
                trace_rows.append((iteration, row["mse"], row["rmse"], row["objective"]))
            elif progress is None:
                base.unpersist()  # both layouts are filled now
            if on_iteration is not None:
                on_iteration(iteration)
            if progress is not None and progress.score(iteration, user, item):
                break
        if progress is not None:
            user, item = log.factors("user", progress.best), log.factors("item", progress.best)

        run = log.path
        rated = source.select("user_id", "item_id", "rating")
        if self.on_duplicate == "keep":
            rated = combine_repeats(rated)
        model = ALSModel(user, item, self.rank, self.reg, users, items, run, rated)
        if trace:
            model.trace = spark.createDataFrame(trace_rows, TRACE_SCHEMA)
        if metrics:  # every iteration was written, so each half-step ran by itself
            model.metrics = spark.createDataFrame(metric_rows, METRICS_SCHEMA)
        if progress is not None:
            model.held_out = spark.createDataFrame(progress.rows, HELD_OUT_SCHEMA)
        return model

    def fit_stored(
        self,
        stored,
        trace: bool = False,
        metrics: bool = False,
        resume: str | None = None,
        on_iteration: Callable[[int], None] | None = None,
    ) -> ALSModel:
        """Fit ratings of ``sources.bucketed``, read as they lie; options as in ``fit``.

        They were checked when they were stored, and nothing of them is cached.
        """
        if self.solver == "gradient":
            raise ValueError("the gradient solver needs layouts of its own: use fit")
        stats = stored.stats()
        users, items, total = stats["user"].ids, stats["item"].ids, stats["user"].ratings
        if total == 0:
            raise ValueError("no ratings to fit")
        base = stored.by("user")
        layouts = []
        try:
            for side in ("user", "item"):
                layouts.append(
                    stored.layout(
                        side, self.rank, self.strategy, self.num_blocks, self.hot_limit, self.broadcast_limit, stats, self.kernel
                    )
                )
            with block_partitioning(stored.spark), shuffle_cleanup(stored.spark):
                return self._iterate(
                    stored.spark, base, base, *layouts, total, users, items, trace, metrics, resume, on_iteration, None
                )
        finally:
            for layout in layouts:
                layout.unpersist()

    def _start(self, by_user) -> DataFrame:
        """Initial user factors from the layout: no shuffle when it is by user."""
        count = F.sum("weight") if "weight" in by_user.data.columns else F.count(F.lit(1))
        sums = by_user.data.groupBy(*by_user.group_keys).agg(
            F.sum("rating").alias("total"), count.alias("n")
        )
        if by_user.group_keys != ["id"]:
            sums = sums.groupBy("id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        mean = F.col("total").cast("double") / F.col("n")
        return sums.select("id", initial_features(mean, F.col("id"), self.rank, self.seed).alias("features"))


def _assert_unique(by_user) -> None:
    """Repeats of a pair share a partition of the layout, so this needs no shuffle."""
    keys = list(dict.fromkeys([*by_user.group_keys, "id", "other_id"]))
    found = (
        by_user.data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(1)
    ).collect()
    if found:
        row = found[0]
        raise ValueError(
            f"user {row['id']} rated item {row['other_id']} {row['n']} times; "
            "choose on_duplicate='last' or 'keep'"
        )

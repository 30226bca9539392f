"""Results do not depend on sizes, kernels or parallelism; bad input is an error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.operators import blocks
from ridgeline.operators.als import ALSFactorizer
from ridgeline.operators.init import init_user_factors
from ridgeline.operators.layout import half_step, normal_equations
from ridgeline.plans.derive import order_ratings
from ridgeline.sources import dense, headered

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ratings(spark):
    return workdir.write_table(order_ratings(spark, SF_DIR), workdir.new_run_dir(spark, "rules"))


def solved(rows, users, rank, reg):
    by_item = {}
    for u, i, r in rows:
        by_item.setdefault(i, []).append((users[u], r))
    out = {}
    for i, pairs in by_item.items():
        x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], dtype=float)
        out[i] = np.linalg.solve(x.T @ x + reg * len(y) * np.eye(rank), x.T @ y)
    return out


@pytest.mark.parametrize("rank,kernel", [(14, "auto"), (14, "sums"), (3, "batches")])
@pytest.mark.parametrize("strategy", ["broadcast", "shuffle", "blocks"])
def test_half_step_at_any_rank(spark, ratings, rank, kernel, strategy):
    start = init_user_factors(ratings, rank)
    users = {r.id: np.array(r.features) for r in start.collect()}
    rows = [(r.user_id, r.item_id, r.rating) for r in ratings.collect()]
    expected = solved(rows, users, rank, 0.05)
    one = ratings.coalesce(1)  # many Arrow batches to one partition
    found = half_step(one, start, "item", rank, 0.05, strategy, 1, kernel=kernel).collect()
    assert len(found) == len(expected) == len({r.id for r in found})
    assert all(np.allclose(r.features, expected[r.id], atol=1e-8) for r in found)
    if kernel == "auto":
        systems = normal_equations(one, start, "item", rank, strategy, num_blocks=1)
        assert systems.count() == systems.select("id").distinct().count() == len(expected)


def test_unsorted_rows_raise():
    import pyarrow as pa

    from ridgeline.functions import linalg

    rows = pa.RecordBatch.from_arrays(
        [pa.array([2, 1], pa.int32()), pa.array([1, 1], pa.int64()), pa.array([1.0, 2.0]), pa.array([[1.0], [1.0]])],
        ["id", "weight", "rating", "features"],
    )
    with pytest.raises(ValueError, match="sorted"):
        list(linalg._merge_batches(linalg._gram_batches([rows], 1), 1))


def test_asked_limits_bound_lists_and_records(spark, ratings, tmp_path):
    lists = blocks.in_blocks(ratings, "item", max_entries=10)
    assert lists.agg(F.max(F.size("entries"))).first()[0] <= 25  # hash parts of about 10
    assert lists.agg(F.sum(F.size("entries"))).first()[0] == ratings.count()
    headered.write_headered_ratings(ratings, str(tmp_path / "text"), chunk_rows=10)
    back = headered.read_headered_ratings(spark, str(tmp_path / "text"))
    assert back.count() == ratings.count()


@pytest.mark.parametrize("bad,what", [
    ((None, 1, 3.0), "user_id"), ((1, None, 3.0), "item_id"), ((1, 1, None), "rating"),
    ((1, 1, float("nan")), "rating"), ((1 << 40, 1, 3.0), "user_id"),
])
def test_bad_ratings_are_one_clear_error(spark, bad, what):
    frame = spark.createDataFrame([(1, 2, 4.0), (2, 1, 3.0), bad], "user_id long, item_id long, rating double")
    with pytest.raises(Exception, match=what):
        ALSFactorizer(rank=2, max_iter=1).fit(frame)


def test_long_ids_within_int_fit(spark):
    frame = spark.createDataFrame([(1, 2, 4.0), (2, 1, 3.0), (2, 2, 5.0)], "user_id long, item_id long, rating double")
    model = ALSFactorizer(rank=2, max_iter=5, checkpoint_interval=2).fit(frame)
    assert model.user_factors.count() == model.item_factors.count() == 2
    model.release()


def test_checkpoint_interval_changes_nothing(spark, hand):
    found = []
    for interval in (1, 2, 10):
        model = ALSFactorizer(rank=2, max_iter=5, checkpoint_interval=interval).fit(hand)
        found.append(sorted((r.id, *np.round(r.features, 9)) for r in model.user_factors.collect()))
        model.release()
    assert found[0] == found[1] == found[2]


@pytest.fixture()
def split_sizes(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum"]
    before = {k: spark.conf.get(k, None) for k in keys}

    def use(size, n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        spark.conf.set("spark.sql.files.minPartitionNum", n)

    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scan_survives_a_change_of_splits(spark, ratings, tmp_path, split_sizes):
    path = str(tmp_path / "text")
    headered.write_headered_ratings(ratings, path)
    split_sizes("128m", "2")
    frame = headered.read_headered_ratings(spark, path, mode="quarantine")
    good, rejects = headered.split_rejects(headered.scan_headered_lines(spark, path))
    split_sizes("16k", "64")
    assert frame.count() == good.count() == ratings.count()
    assert rejects.count() == 0


def test_dense_scan_survives_and_checks_its_ids(spark, ratings, tmp_path, split_sizes):
    model = ALSFactorizer(rank=2, max_iter=1).fit(ratings)
    path = dense.write_dense_predictions(model, str(tmp_path / "dense"))
    users, items = ratings.select("user_id"), ratings.select("item_id")
    split_sizes("128m", "2")
    cells = dense.read_dense_predictions(spark, path, users, items)
    scored = dense.score_dense_predictions(spark, path, ratings)
    split_sizes("1m", "64")
    assert cells.count() == model.users * model.items
    whole = model.evaluate(ratings).first()
    assert scored.first().mse == pytest.approx(whole.mse)
    half = ratings.where("user_id % 2 = 0")
    by_ids = dense.score_dense_predictions(spark, path, half, users, items).first()
    assert by_ids.mse == pytest.approx(model.evaluate(half).first().mse)
    with pytest.raises(ValueError, match="users and items"):
        dense.score_dense_predictions(spark, path, half)
    extra = ratings.limit(5).withColumn("item_id", F.lit(10**6))
    with pytest.raises(Exception, match="no item"):
        dense.score_dense_predictions(spark, path, extra, users, items).collect()
    lines = spark.read.text(path)
    short = F.when(F.col("value").contains("real"), F.col("value")).otherwise(F.regexp_replace("value", " [^ ]*$", ""))
    lines.coalesce(1).select(short.alias("value")).write.text(str(tmp_path / "short"))
    with pytest.raises(Exception, match="cells"):
        dense.score_dense_predictions(spark, str(tmp_path / "short"), ratings).collect()
    model.release()


def test_blocks_fill_their_partitions(spark, ratings):
    from ridgeline.operators.layout import build_layout

    layout = build_layout(ratings, "item", 2, "blocks", num_blocks=16)
    rows = layout.data.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("block").alias("b")).collect()
    assert len(rows) == 16 and all(r.b == 1 for r in rows)

"""What one task holds, or one job sends, stays bounded when tables grow."""

import glob

import pytest

from ridgeline import workdir
from ridgeline.operators import layout
from ridgeline.plans import derive, queries
from ridgeline.streaming import foldin

from brute import close, collected
from conftest import SF_DIR


def test_gradients_are_summed_before_a_row_per_feature_is_made(spark):
    plan = queries.als_rank20_gradient(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Aggregate [user_id")


@pytest.mark.parametrize("kernel", ["sums", "batches"])
@pytest.mark.parametrize("hot_limit", [None, 7])
def test_large_blocks_are_cut(spark, skewed, monkeypatch, kernel, hot_limit):
    start = layout.half_step(skewed, queries.init_user_factors(skewed, 2), "item", 2, 0.05)
    run = dict(strategy="blocks", num_blocks=3, hot_limit=hot_limit, kernel=kernel)
    whole = collected(layout.half_step(skewed, start, "user", 2, 0.05, **run))
    monkeypatch.setattr(layout, "ROWS_PER_PARTITION", 20)
    placed = layout.build_layout(skewed, "user", 2, **run)
    total = skewed.count()
    assert placed.partitions % 3 == 0 and placed.partitions * 20 >= total
    rows = placed.data.groupBy("block").count().collect()
    assert len(rows) > 3 and max(r["block"] for r in rows) < placed.partitions
    close(collected(layout.half_step(skewed, start, "user", 2, 0.05, **run)), whole)


def test_headered_text_has_files_by_its_size(spark, monkeypatch):
    made, real = [], workdir.new_run_dir
    monkeypatch.setattr(workdir, "new_run_dir", lambda *a: made.append(real(*a)) or made[-1])
    whole = sorted(map(tuple, queries.stream_headered(spark, SF_DIR).collect()))
    monkeypatch.setattr(layout, "ROWS_PER_PARTITION", 200)
    assert sorted(map(tuple, queries.stream_headered(spark, SF_DIR).collect())) == whole
    few, many = [len(glob.glob(f"{p}/text/step=0/part-*")) for p in made if "headered-stream" in p]
    assert few == 2 and many > 2


def test_ratings_of_many_rows_get_partitions_by_their_number(spark, monkeypatch):
    """More rows than the session's partitions should hold: the grouping has as many as they ask for."""
    usual = derive.order_ratings(spark, SF_DIR, dated=True)
    rows = derive.table(spark, SF_DIR, "lineitem").count()
    monkeypatch.setattr(layout, "ROWS_PER_PARTITION", 100)
    found = derive.order_ratings(spark, SF_DIR, dated=True)
    assert found.rdd.getNumPartitions() == -(-rows // 100)
    assert sorted(found.collect()) == sorted(usual.collect())


@pytest.mark.parametrize("few", [0, 100_000])
def test_touched_ratings_are_few_or_laid_out_by_id(spark, monkeypatch, few):
    monkeypatch.setattr(layout, "ROWS_PER_PARTITION", 5)
    monkeypatch.setattr(foldin, "BROADCAST_IDS", few)
    ratings = spark.createDataFrame([(u % 9, u, 1 + u % 5) for u in range(90)], "user_id int, item_id int, rating smallint")
    changes = ratings.where("user_id < 4").select("user_id", "item_id")
    touched = foldin.touched_ratings(ratings, changes, "user")
    assert sorted(touched.collect()) == sorted(ratings.where("user_id < 4").collect())
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert ("REPARTITION_BY_NUM" in plan) != bool(few)

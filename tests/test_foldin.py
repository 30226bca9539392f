"""Folds: only touched ids are solved, as a half-step would; replays and refits keep them right."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import ALSFactorizer
from ridgeline.operators.layout import half_step
from ridgeline.schemas import FACTORS
from ridgeline.streaming import foldin, source, upsert

from test_streaming import events, put

FIT = ALSFactorizer(rank=2, reg=0.05, max_iter=2)
OLD = [(u, i, 1 + (u * i) % 5, "2024-01-01", u * 10 + i) for u in range(1, 9) for i in range(1, 6) if (u + i) % 3]
NEW = [(1, 1, 5, "2024-02-01", 900), (1, 2, 1, "2024-02-01", 901), (20, 3, 4, "2024-02-01", 902), (2, 30, 2, "2024-02-01", 903)]


def vectors(df):
    return {r["id"]: np.array(r["features"]) for r in df.collect()}


@pytest.fixture
def log(spark, tmp_path):
    path = f"{tmp_path}/table"
    upsert.write_delta(events(spark, OLD), 0, path)
    model = FIT.fit(upsert.compact(spark, path, 0))
    model.save(f"{path}/factors/version=0")
    model.release()
    upsert.write_delta(events(spark, NEW), 1, path)
    return path


def test_only_touched_ids_are_solved(spark, log):
    before = [vectors(spark.read.schema(FACTORS).parquet(f"{log}/factors/version=0/{s}_factors")) for s in ("user", "item")]
    solved = foldin.fold_batch(spark, log, 1)
    assert solved == {"user": 3, "item": 4}  # 1, 2, 20 and 1, 2, 3, 30
    model = foldin.current_model(spark, log)
    users, items = vectors(model.user_factors), vectors(model.item_factors)
    assert (model.users, model.items) == (9, 6)
    assert all((users[u] == before[0][u]).all() for u in before[0] if u > 2)
    assert all((items[i] == before[1][i]).all() for i in (4, 5))
    # A half-step over all ratings gives the same vectors to the touched users ...
    ratings = upsert.current_ratings(spark, log).select("user_id", "item_id", "rating")
    standing = spark.read.schema(FACTORS).parquet(f"{log}/factors/version=0/item_factors")
    known = ratings.join(standing.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    whole = vectors(half_step(known, standing, "user", 2, 0.05))
    assert all(np.allclose(users[u], whole[u]) for u in (1, 2, 20))
    # ... and then to the touched items.
    whole = vectors(half_step(ratings, model.user_factors, "item", 2, 0.05))
    assert all(np.allclose(items[i], whole[i]) for i in (1, 2, 3, 30))


def test_replayed_fold_changes_nothing(spark, log):
    foldin.fold_batch(spark, log, 1)
    first = vectors(foldin.current_model(spark, log).user_factors)
    foldin.fold_batch(spark, log, 1)
    again = vectors(foldin.current_model(spark, log).user_factors)
    assert first.keys() == again.keys() and all((first[u] == again[u]).all() for u in first)


def test_no_model_no_fold(spark, tmp_path):
    upsert.write_delta(events(spark, OLD), 0, f"{tmp_path}/t")
    assert foldin.fold_batch(spark, f"{tmp_path}/t", 0) is None
    assert foldin.current_model(spark, f"{tmp_path}/t") is None


def test_stream_folds_between_refits(spark, tmp_path):
    paths = {n: f"{tmp_path}/{n}" for n in ("in", "table", "check")}

    def run(rows):
        put(spark, paths["in"], rows)
        stream = source.read_ratings_stream(spark, paths["in"])
        upsert.refit_stream(stream, paths["table"], paths["check"], 2, FIT, fold=True).awaitTermination()

    run(OLD[:4])  # batch 0: no model yet
    run(OLD[4:])  # batch 1: refit
    run(NEW)  # batch 2: fold
    assert os.listdir(f"{paths['table']}/folds/user") == ["batch=2"]
    model = foldin.current_model(spark, paths["table"])
    assert (model.users, model.items) == (9, 6)
    for k in range(3):  # batches 3 to 5: refit, fold, refit; old folds go
        run([(3, 1 + k, 2, f"2024-03-0{k + 1}", 1000 + k)])
    assert os.listdir(f"{paths['table']}/folds/user") == ["batch=4"]
    model = foldin.current_model(spark, paths["table"])
    whole = vectors(upsert.latest_model(spark, paths["table"]).user_factors)
    assert vectors(model.user_factors).keys() == whole.keys()

"""Resuming a broken-off fit, and what is observed of each half-step."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import ALSFactorizer
from ridgeline.operators.gate import HalfStep


class Lost(Exception):
    pass


def lost_after(iteration):
    def told(done):
        if done == iteration:
            raise Lost

    return told


def vectors(df):
    return {r["id"]: r["features"] for r in df.collect()}


@pytest.mark.parametrize("strategy", ["broadcast", "blocks", "shuffle"])
def test_resumed_fit_equals_a_whole_one(spark, hand, tmp_path, strategy):
    fit = ALSFactorizer(rank=2, reg=0.05, max_iter=4, strategy=strategy, num_blocks=2)
    whole = fit.fit(hand)
    path = f"{tmp_path}/fit"
    for iteration in (1, 3):
        with pytest.raises(Lost):
            fit.fit(hand, resume=path, on_iteration=lost_after(iteration))
        assert os.listdir(f"{path}/committed") == [f"iteration={iteration}"]
    # What a lost driver left of the next iteration is written over.
    hand.limit(1).write.parquet(f"{path}/item-factors-4")
    seen = []
    model = fit.fit(hand, resume=path, on_iteration=seen.append)
    assert seen == [4]
    for side in ("user_factors", "item_factors"):
        ours, theirs = vectors(getattr(model, side)), vectors(getattr(whole, side))
        assert ours.keys() == theirs.keys() and all(np.allclose(ours[i], theirs[i]) for i in ours)
    # A finished fit is only read.
    again = fit.fit(hand, resume=path, on_iteration=seen.append)
    assert seen == [4] and vectors(again.user_factors) == vectors(model.user_factors)


def test_other_fits_are_refused(spark, hand, tmp_path):
    path = f"{tmp_path}/fit"
    ALSFactorizer(rank=2, reg=0.05, max_iter=2).fit(hand, resume=path)
    with pytest.raises(ValueError, match="reg 0.05 instead of 0.1"):
        ALSFactorizer(rank=2, reg=0.1, max_iter=2).fit(hand, resume=path)
    with pytest.raises(ValueError, match="print"):
        turned = hand.withColumn("rating", (6 - F.col("rating")).cast("smallint"))
        ALSFactorizer(rank=2, reg=0.05, max_iter=2).fit(turned, resume=path)
    with pytest.raises(ValueError, match="after the 1"):
        ALSFactorizer(rank=2, reg=0.05, max_iter=1).fit(hand, resume=path)
    longer = ALSFactorizer(rank=2, reg=0.05, max_iter=3).fit(hand, resume=path)
    assert vectors(longer.user_factors) == vectors(ALSFactorizer(rank=2, reg=0.05, max_iter=3).fit(hand).user_factors)


def solved(spark, rows):
    return spark.createDataFrame(rows, "id int, features array<double>, n bigint")


@pytest.mark.parametrize(
    "rows,told",
    [
        ([(1, [0.5], 3)], "1 vectors, expected 2"),
        ([(1, [0.5], 3), (2, [0.1], 3)], "6 ratings with a counterpart's vector, expected 7"),
        ([(1, [0.5], 3), (2, [float("nan")], 4)], "1 vectors that are not finite, expected 0"),
        ([(1, [float("-inf")], 3), (2, [0.1], 4)], "1 vectors that are not finite, expected 0"),
    ],
)
def test_incomplete_half_steps_raise(spark, rows, told):
    step = HalfStep("item", 3, 2, 7)
    step.watched(solved(spark, rows)).collect()
    with pytest.raises(ValueError, match=told):
        step.checked()


def test_complete_half_step(spark):
    step = HalfStep("item", 3, 2, 7)
    step.watched(solved(spark, [(1, [0.5], 3), (2, [0.1], 4)])).collect()
    assert step.checked() == 2


def test_a_dropped_vector_stops_the_fit(spark, hand, monkeypatch):
    from ridgeline.operators.layout import Layout

    joined = Layout.joined
    monkeypatch.setattr(Layout, "joined", lambda self, factors, rank: joined(self, factors.where("id <> 1"), rank))
    with pytest.raises(ValueError, match="half-step of iteration 1"):
        ALSFactorizer(rank=2, reg=0.05, max_iter=2).fit(hand)


def test_repeats_count_as_ratings(spark, hand):
    model = ALSFactorizer(rank=2, reg=0.05, max_iter=2, on_duplicate="keep").fit(hand.unionByName(hand.limit(3)), metrics=True)
    assert [(r.iteration, r.side, r.rows) for r in model.metrics.collect()] == [
        (1, "item", 4), (1, "user", 4), (2, "item", 4), (2, "user", 4)
    ]

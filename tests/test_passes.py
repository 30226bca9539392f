"""Jobs whose shuffled vectors do not fit on disk at once are done in passes."""

import time

import numpy as np
import pytest

from ridgeline import ALSFactorizer
from ridgeline.operators import compare, evaluate, layout
from ridgeline.plans import queries as q
from tests.conftest import SF_DIR


def collected(factors):
    return {r["id"]: np.array(r["features"]) for r in factors.collect()}


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


@pytest.mark.parametrize("rank", [3, 14])
def test_a_fit_in_passes_finds_the_same_factors(skewed, monkeypatch, rank):
    fit = ALSFactorizer(rank=rank, max_iter=2, strategy="blocks", num_blocks=5)
    whole = fit.fit(skewed)
    turns = []
    only = layout.Layout.only
    monkeypatch.setattr(layout, "PASS_BYTES", 4_000)
    monkeypatch.setattr(layout.Layout, "only", lambda self, turn, passes: turns.append((turn, passes)) or only(self, turn, passes))
    cut = fit.fit(skewed)
    assert max(passes for _, passes in turns) > 1
    for side in ("user_factors", "item_factors"):
        one, other = collected(getattr(whole, side)), collected(getattr(cut, side))
        assert one.keys() == other.keys() and all(np.allclose(one[i], other[i]) for i in one)


def test_parts_of_hot_ids_stay_in_one_pass(skewed, monkeypatch):
    fit = ALSFactorizer(rank=3, max_iter=2, strategy="blocks", num_blocks=5, hot_limit=8)
    whole = collected(fit.fit(skewed).user_factors)
    monkeypatch.setattr(layout, "PASS_BYTES", 4_000)
    cut = collected(fit.fit(skewed).user_factors)
    assert whole.keys() == cut.keys() and all(np.allclose(whole[i], cut[i]) for i in whole)


def test_written_half_steps_leave_no_shuffle_files(skewed, spark):
    """What stays is of the cached layouts, however many iterations there are."""

    def left(iterations, most=0):
        before = shuffles(spark)
        ALSFactorizer(rank=3, max_iter=iterations, strategy="blocks", num_blocks=5, checkpoint_interval=1).fit(skewed)
        for _ in range(100):  # they go in the background
            found = len(shuffles(spark) - before)
            if found <= most:
                break
            time.sleep(0.1)
        return found

    once = left(1)
    assert left(4, once) <= once


@pytest.mark.parametrize("pass_bytes", [1 << 30, 2_000], ids=["one", "many"])
def test_scoring_writes_no_vectors_and_sums_its_passes(skewed, monkeypatch, pass_bytes):
    model = ALSFactorizer(rank=3, max_iter=2).fit(skewed)
    rated, objective = model.evaluate(skewed).first(), model.objective(skewed).first()
    written = []
    write = evaluate.workdir.write_table
    monkeypatch.setattr(layout, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(evaluate.workdir, "write_table", lambda df, path: written.append(df.columns) or write(df, path))
    spread = model.evaluate(skewed, broadcast_limit=0, hot_limit=8).first()
    assert spread["n"] == rated["n"] and spread["mse"] == pytest.approx(rated["mse"])
    assert spread["rmse"] == pytest.approx(rated["rmse"])
    assert model.objective(skewed, broadcast_limit=0).first()["objective"] == pytest.approx(objective["objective"])
    assert written and not any(c in ("u0", "m0") for columns in written for c in columns)


def test_ids_of_another_type_are_scored_in_passes(skewed, monkeypatch):
    model = ALSFactorizer(rank=3, max_iter=1).fit(skewed)
    wide = skewed.selectExpr("cast(user_id as bigint) as user_id", "item_id", "if(user_id = 1, null, rating) as rating")
    rated = model.evaluate(wide).first()
    monkeypatch.setattr(layout, "PASS_BYTES", 2_000)
    spread = model.evaluate(wide, broadcast_limit=0).first()
    assert spread["n"] == rated["n"] == skewed.count() and spread["mse"] == pytest.approx(rated["mse"])


def test_gradients_in_passes(spark, monkeypatch):
    whole = {tuple(r) for r in q.als_rank20_gradient(spark, SF_DIR).collect()}
    made = []
    in_passes = q.in_passes
    monkeypatch.setattr(layout, "PASS_BYTES", 400_000)
    monkeypatch.setattr(q, "in_passes", lambda rows, key, n: made.append(n) or in_passes(rows, key, n))
    assert {tuple(r) for r in q.als_rank20_gradient(spark, SF_DIR).collect()} == whole
    assert max(made) > 1


def test_comparison_in_passes(spark, skewed, monkeypatch):
    whole = {r["engine"]: r for r in compare.compare_builtin(skewed, rank=3, max_iter=2).collect()}
    monkeypatch.setattr(layout, "PASS_BYTES", 2_000)
    for row in compare.compare_builtin(skewed, rank=3, max_iter=2).collect():
        assert row["n"] == whole[row["engine"]]["n"] and row["mse"] == pytest.approx(whole[row["engine"]]["mse"])


def test_a_comparison_is_scored_once(spark, skewed):
    """Its readers may read it twice: nothing of the ratings is left in the plan."""
    found = compare.compare_builtin(skewed, rank=2, max_iter=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.count() == 2

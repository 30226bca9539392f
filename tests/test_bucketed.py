"""Ratings stored in buckets."""

import pytest

from ridgeline import ALSFactorizer, workdir
from ridgeline.operators.evaluate import evaluate
from ridgeline.operators.init import init_user_factors
from ridgeline.sources.bucketed import open_ratings, store_ratings

from brute import als, close, collected, triples
from test_plans import above_cache, plan_of

REG = 0.1


@pytest.fixture()
def stored(spark, skewed):
    kept = store_ratings(skewed, workdir.new_run_dir(spark, "t"), 4)
    yield kept
    kept.drop()


def test_a_new_session_moves_no_ratings(spark, skewed, stored):
    other = open_ratings(spark.newSession(), stored.path)
    assert (other.buckets, other.rows) == (4, skewed.count())
    assert sorted(triples(other.by("item"))) == sorted(triples(skewed)) == sorted(triples(other.by("user")))
    stats = other.stats()
    users = init_user_factors(skewed, 2).persist()
    for side in ("user", "item"):
        layout = other.layout(side, 2, "broadcast", None, None, 1 << 20, stats, "auto")
        plan = plan_of(layout.systems(users, 2))
        assert "Exchange hashpartitioning" not in above_cache(plan), plan
        counted = above_cache(plan_of(other.by(side).groupBy(f"{side}_id").count()))
        assert "Exchange" not in counted, counted
    model = ALSFactorizer(rank=2, reg=REG, max_iter=1).fit_stored(other)
    plan = above_cache(plan_of(evaluate(model.user_factors, model.item_factors, model.ratings, 2)))
    assert "Exchange hashpartitioning" not in plan, plan


@pytest.mark.parametrize("options", [{}, {"kernel": "batches"}, {"strategy": "blocks"}, {"hot_limit": 9}, {"rank": 14}])
def test_fit(skewed, stored, options):
    options = {"rank": 2, "reg": REG, "max_iter": 2, **options}
    model = ALSFactorizer(**options).fit_stored(stored, trace=True)
    users, items = als(triples(skewed), options["rank"], REG, 2)
    close(collected(model.user_factors), users, 1e-8)
    close(collected(model.item_factors), items, 1e-8)
    assert model.trace.count() == 2


def test_what_is_refused(spark, hand):
    path = workdir.new_run_dir(spark, "t")
    with pytest.raises(ValueError, match="2 times"):
        store_ratings(hand.union(hand), path)
    with pytest.raises(Exception, match="(?i)path"):  # no manifest was written
        open_ratings(spark, path)
    with pytest.raises(ValueError, match="one row per pair"):
        store_ratings(hand, path, on_duplicate="keep")
    last = store_ratings(hand.union(hand), workdir.new_run_dir(spark, "t"), 2, on_duplicate="last")
    assert last.rows == 7
    with pytest.raises(ValueError, match="gradient"):
        ALSFactorizer(solver="gradient").fit_stored(last)
    last.drop()
    empty = store_ratings(hand.limit(0), workdir.new_run_dir(spark, "t"))
    with pytest.raises(ValueError, match="no ratings"):
        ALSFactorizer().fit_stored(empty)
    empty.drop()

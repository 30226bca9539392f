"""Half-steps by conjugate gradients against numpy, their plans and their steps."""

import re

import numpy as np
import pytest

from ridgeline import ALSFactorizer, workdir
from ridgeline.operators import gradient
from ridgeline.operators.init import init_user_factors
from ridgeline.operators.layout import block_partitioning, build_layout
from ridgeline.plans.derive import order_ratings

from brute import als, close, collected, half, triples
from conftest import SF_DIR
from test_plans import above_cache, plan_of

REG = 0.1
WIDE = 3.0  # at rank 100: fewer steps


@pytest.fixture(scope="module")
def wide(spark, skewed):
    """Users at rank 100 with values of both signs."""
    rng = np.random.default_rng(5)
    users = {u: rng.normal(size=100) for u in {u for u, _, _ in triples(skewed)}}
    rows = [(int(u), [float(x) for x in f]) for u, f in users.items()]
    return users, spark.createDataFrame(rows, "id int, features array<double>").persist()


@pytest.mark.parametrize(
    "options", [{"strategy": "broadcast"}, {"strategy": "broadcast", "hot_limit": 7}, {"strategy": "blocks", "num_blocks": 3},
                {"strategy": "blocks", "num_blocks": 3, "hot_limit": 7}]
)
def test_rank_100(skewed, wide, options):
    users, table = wide
    found = gradient.half_step(skewed, table, "item", 100, WIDE, **options)
    close(collected(found), half(triples(skewed), users, "item", WIDE), 1e-7)


def steps_of(spark, path):
    return spark.read.parquet(path).groupBy("step").count().collect()


def test_solved_ids_leave_and_a_near_start_is_short(spark, skewed, wide):
    users, table = wide
    layout = build_layout(skewed, "item", 100, "broadcast", kernel="batches")
    ids = skewed.select("item_id").distinct().count()
    path = workdir.new_run_dir(spark, "t")
    found = gradient.solve(layout, table, 100, WIDE, path).persist()
    assert found.count() == ids == found.select("id").distinct().count()
    assert {r["id"]: r["n"] for r in found.collect()} == {
        r["item_id"]: r["count"] for r in skewed.groupBy("item_id").count().collect()
    }
    rows = {r["step"]: r["count"] for r in steps_of(spark, path)}
    assert rows[0] == ids and rows[max(rows)] < ids  # items of one rating are solved by one step
    near = workdir.new_run_dir(spark, "t")
    again = gradient.solve(layout, table, 100, WIDE, near, start=found.where("id % 2 = 0"), tolerance=1e-6)
    close(collected(again), half(triples(skewed), users, "item", WIDE), 1e-4)
    counts = {r["step"]: r["count"] for r in steps_of(spark, near)}
    assert counts[0] == ids and counts[1] <= sum(1 for i in collected(found) if i % 2)
    one = gradient.solve(layout, table, 100, WIDE, workdir.new_run_dir(spark, "t"), steps=1)
    assert one.count() == ids


@pytest.mark.parametrize("strategy,hot,exchanges", [("broadcast", None, 1), ("broadcast", 7, 1), ("blocks", None, 2)])
def test_no_row_moves_with_its_vector(spark, strategy, hot, exchanges):
    """Directions go to the ratings (and vectors to blocks); what comes back is one product per id."""
    ratings = order_ratings(spark, SF_DIR)
    users = workdir.write_table(init_user_factors(ratings, 2), workdir.new_run_dir(spark, "t"))
    layout = build_layout(ratings, "item", 2, strategy, num_blocks=4, hot_limit=hot, kernel="batches").persist()
    directions = workdir.write_table(
        ratings.selectExpr("item_id as id", "array(1D, 2D) as direction").dropDuplicates(["id"]), workdir.new_run_dir(spark, "t")
    )
    with block_partitioning(spark):
        plan = above_cache(plan_of(gradient.products(layout, users, directions, 2, first=False)))
    layout.unpersist()
    moved = re.findall(r"Exchange (?:hashpartitioning|shufflepartitionidpassthrough)\(([^)]*)\)", plan)
    assert len(moved) == exchanges, plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_fit(skewed, hand):
    model = ALSFactorizer(rank=3, reg=REG, max_iter=3, solver="gradient", hot_limit=9).fit(skewed)
    users, items = als(triples(skewed), 3, REG, 3)
    close(collected(model.user_factors), users, 1e-6)
    close(collected(model.item_factors), items, 1e-6)
    twice = ALSFactorizer(rank=2, reg=REG, max_iter=1, solver="gradient", on_duplicate="keep").fit(hand.union(hand))
    users, items = als(triples(hand) * 2, 2, REG, 1)
    close(collected(twice.item_factors), items, 1e-6)


def test_refusals(spark, hand):
    for wrong in ({"solver": "newton"}, {"solver": "gradient", "strategy": "shuffle"}, {"solver": "gradient", "kernel": "sums"}):
        with pytest.raises(ValueError):
            ALSFactorizer(**wrong)
    layout = build_layout(hand, "item", 2, "broadcast", kernel="sums")
    with pytest.raises(ValueError):
        gradient.solve(layout, init_user_factors(hand, 2), 2, REG, workdir.new_run_dir(spark, "t"))


def test_narrow_products_are_sums_in_the_plan(spark, hand):
    """Up to rank 12 no rating goes through Python; parts and weights count as in the batches."""
    users = init_user_factors(hand, 2)
    layout = build_layout(hand, "item", 2, "broadcast", kernel="batches")
    assert "MapInArrow" not in plan_of(gradient.products(layout, users, None, 2, first=True))
    f, rows = {r["id"]: np.array(r["features"]) for r in users.collect()}, triples(hand)
    found = {r["id"]: (r["n"], r["product"]) for r in gradient.products(layout, users, None, 2, first=True).collect()}
    for item in {i for _, i, _ in rows}:
        right = sum(f[u] * r for u, i, r in rows if i == item)
        assert found[item][0] == sum(i == item for _, i, _ in rows)
        assert np.allclose(found[item][1], [*right, *right])

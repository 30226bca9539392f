import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import ALSFactorizer
from ridgeline.operators import gate
from ridgeline.operators.init import init_user_factors
from ridgeline.operators.layout import build_layout, half_step, normal_equations

from brute import als, close, collected, half, start, triples

# Hand fixture: user factors after one and two iterations, 6 decimals.
USERS_1 = {1: [3.340038, 0.440273], 2: [2.260344, -0.65961], 3: [0.776941, -1.137942], 4: [2.413553, 0.484714]}
USERS_2 = {1: [2.982729, 0.263864], 2: [2.011629, -0.827446], 3: [0.915235, -1.100299], 4: [2.337756, 0.310944]}
ITEMS_2 = {1: [0.844175, -0.10228], 2: [0.615846, -2.09347], 3: [1.185014, 0.237986], 4: [1.775781, -2.13485]}


def fit(ratings, **options):
    options = {"rank": 2, "reg": 0.05, "max_iter": 2} | options
    return ALSFactorizer(**options).fit(ratings)


def test_hand_fixture(hand):
    close(collected(fit(hand, max_iter=1).user_factors), USERS_1, 1e-6)
    model = fit(hand)
    close(collected(model.user_factors), USERS_2, 1e-6)
    close(collected(model.item_factors), ITEMS_2, 1e-6)
    assert model.evaluate(hand).first()["mse"] == pytest.approx(0.032624, abs=1e-6)
    assert model.assert_complete(4, 4) is model
    with pytest.raises(ValueError, match="expected 5 user"):
        model.assert_complete(5, 4)


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle", "blocks"])
@pytest.mark.parametrize("hot_limit", [None, 8])
@pytest.mark.parametrize("rank", [3, 14])
def test_strategies_agree_under_skew(skewed, strategy, hot_limit, rank):
    model = fit(skewed, strategy=strategy, hot_limit=hot_limit, rank=rank, num_blocks=5)
    users, items = als(triples(skewed), rank, 0.05, 2)
    close(collected(model.user_factors), users, 1e-7)
    close(collected(model.item_factors), items, 1e-7)
    model.release()


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle", "blocks"])
def test_hot_entity_is_split(skewed, strategy):
    """With a limit of 8, no (block or partition, entity) group keeps 20 rows."""
    layout = build_layout(skewed, "item", 2, strategy, num_blocks=16, hot_limit=8)
    keys = ["other_id", "other_part"] if strategy == "shuffle" else layout.group_keys
    assert skewed.groupBy("item_id").count().agg(F.max("count")).first()[0] >= 59
    largest = layout.data.groupBy(*keys).count().agg(F.max("count")).first()[0]
    assert largest <= 20


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_result_does_not_depend_on_blocks_or_partitioning(skewed, blocks):
    base = collected(fit(skewed).user_factors)
    close(collected(fit(skewed.repartition(blocks), strategy="blocks", num_blocks=blocks).user_factors), base)


def test_half_steps_lower_the_objective(skewed):
    rows = triples(skewed)
    users, items = start(rows, 2), None

    def cost(u, m):
        sse = sum((r - u[a] @ m[b]) ** 2 for a, b, r in rows)
        return sse + 0.05 * sum(u[a] @ u[a] + m[b] @ m[b] for a, b, _ in rows)

    model = ALSFactorizer(rank=2, reg=0.05, max_iter=4).fit(skewed, trace=True, metrics=True)
    trace = [r["objective"] for r in model.trace.orderBy("iteration").collect()]
    for step in range(4):
        items = half(rows, users, "item", 0.05)
        after_items = cost(users, items)
        users = half(rows, items, "user", 0.05)
        after_users = cost(users, items)
        assert after_users <= after_items + 1e-9
        assert trace[step] == pytest.approx(after_users, rel=1e-9)
    assert trace == sorted(trace, reverse=True)
    metrics = model.metrics.collect()
    assert len(metrics) == 8
    assert {(r["side"], r["rows"]) for r in metrics} == {("user", 60), ("item", 60)}
    assert all(r["seconds"] > 0 for r in metrics)


def test_half_step_residual(skewed):
    users = init_user_factors(skewed, 2)
    solved = collected(half_step(skewed, users, "item", 2, 0.05))
    for row in normal_equations(skewed, users, "item", 2).collect():
        a = np.array([[row["a0_0"], row["a0_1"]], [row["a0_1"], row["a1_1"]]])
        residual = (a + 0.05 * row["n"] * np.eye(2)) @ solved[row["id"]] - [row["v0"], row["v1"]]
        assert np.abs(residual).max() < 1e-9


def test_duplicates(spark):
    rows = [(1, 1, 5, "2005-01-01"), (1, 1, 1, "2005-02-01"), (1, 2, 3, "2005-01-01"), (2, 1, 4, "2005-01-01")]
    ratings = spark.createDataFrame(rows, "user_id int, item_id int, rating int, rated_on string").select(
        "user_id", "item_id", F.col("rating").cast("smallint").alias("rating"), F.col("rated_on").cast("date").alias("rated_on")
    )
    for strategy in ("broadcast", "shuffle", "blocks"):
        with pytest.raises(ValueError, match="rated item 1 2 times"):
            fit(ratings, strategy=strategy)
    kept = [(1, 1, 5), (1, 1, 1), (1, 2, 3), (2, 1, 4)]
    for rank in (2, 13):
        users, items = als(kept, rank, 0.05, 2)
        model = fit(ratings, on_duplicate="keep", rank=rank)
        close(collected(model.user_factors), users)
        assert model.evaluate(ratings).first()["n"] == 4
    users, _ = als(kept[1:], 2, 0.05, 2)
    close(collected(fit(ratings, on_duplicate="last").user_factors), users)


def test_zero_ratings_count(spark):
    rows = [(1, 1, 0), (1, 2, 4), (2, 1, 3)]
    ratings = spark.createDataFrame(rows, "user_id int, item_id int, rating int")
    users, items = als(rows, 2, 0.05, 2)
    model = fit(ratings)
    close(collected(model.user_factors), users)
    assert model.evaluate(ratings).first()["n"] == 3


def test_parameters_and_expectations(hand):
    for bad in ({"rank": 0}, {"reg": 0.0}, {"max_iter": 0}, {"num_blocks": 0}, {"strategy": "x"}, {"on_duplicate": "x"}):
        with pytest.raises(ValueError):
            ALSFactorizer(**bad)
    with pytest.raises(ValueError, match="expected 9 users"):
        ALSFactorizer(rank=2, max_iter=1).fit(hand, expected_users=9)
    with pytest.raises(ValueError, match="no ratings"):
        ALSFactorizer(rank=2, max_iter=1).fit(hand.limit(0))


def test_more_than_ten_iterations(hand):
    users, _ = als(triples(hand), 2, 0.05, 12)
    close(collected(fit(hand, max_iter=12).user_factors), users, 1e-7)


def test_seed_changes_the_start_only_in_later_features(hand):
    a, b = (collected(init_user_factors(hand, 3, seed)) for seed in (0, 5))
    assert all(a[u][0] == b[u][0] and a[u][1] != b[u][1] for u in a)
    assert all(0 < x < 1 for u in a for x in a[u][1:])


def test_missing_vectors_broadcast_and_spread(skewed):
    arrived = init_user_factors(skewed, 2).filter("id >= 30")
    rows = triples(skewed)
    want = {}
    for item in {i for _, i, _ in rows}:
        users = [u for u, i, _ in rows if i == item]
        if any(u < 30 for u in users):
            want[item] = (len(users), sum(u >= 30 for u in users))
    for options in ({}, {"broadcast_limit": 0, "hot_limit": 8}):
        got = gate.missing_vectors(skewed, arrived, "item", **options).collect()
        assert {r["id"]: (r["expected"], r["received"]) for r in got} == want


def test_factor_rank_one(hand):
    users, items = als(triples(hand), 1, 0.05, 2)
    model = fit(hand, rank=1)
    close(collected(model.user_factors), users)
    close(collected(model.item_factors), items)

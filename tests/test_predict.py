import math

import numpy as np
import pytest

from ridgeline import ALSFactorizer, ALSModel
from ridgeline.operators import predict
from ridgeline.sources import dense

from brute import collected, triples

GRID = {"broadcast_limit": 0, "user_block": 16, "item_block": 7}


@pytest.fixture(scope="module")
def model(skewed):
    return ALSFactorizer(rank=3, reg=0.05, max_iter=2).fit(skewed)


def all_cells(model):
    users, items = collected(model.user_factors), collected(model.item_factors)
    return {(u, i): float(users[u] @ items[i]) for u in users for i in items}


@pytest.mark.parametrize("options", [{}, GRID], ids=["broadcast", "grid"])
def test_every_cell(model, options):
    got = {(r["user_id"], r["item_id"]): r["prediction"] for r in model.predict_all(**options).collect()}
    want = all_cells(model)
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)


@pytest.mark.parametrize("options", [{}, GRID], ids=["broadcast", "grid"])
def test_chosen_users_and_items(model, spark, options):
    users = spark.createDataFrame([(3,), (5,), (999,)], "user_id int")
    items = spark.createDataFrame([(0,), (9,)], "item_id int")
    got = model.predict_all(users, items, **options).collect()
    assert sorted((r["user_id"], r["item_id"]) for r in got) == [(3, 0), (3, 9), (5, 0), (5, 9)]


@pytest.mark.parametrize("options", [{}, GRID], ids=["broadcast", "grid"])
def test_rows_are_ordered(model, options):
    rows = model.predict_rows(**options).collect()
    cells = all_cells(model)
    items = sorted({i for _, i in cells})
    assert [r["user_id"] for r in rows] == sorted({u for u, _ in cells})
    for r in rows:
        np.testing.assert_allclose(r["predictions"], [cells[r["user_id"], i] for i in items], atol=1e-9)


@pytest.mark.parametrize("options", [{}, GRID], ids=["broadcast", "grid"])
@pytest.mark.parametrize("k", [1, 4, 1000])
@pytest.mark.parametrize("exclude", [True, False])
def test_recommend(model, skewed, options, k, exclude):
    cells = all_cells(model)
    rated = {(u, i) for u, i, _ in triples(skewed)} if exclude else set()
    want = {}
    for user in {u for u, _ in cells}:
        free = [(-p, i) for (u, i), p in cells.items() if u == user and (u, i) not in rated]
        want[user] = [i for _, i in sorted(free)[:k]]
    got = {u: {} for u in want}
    for r in model.recommend(k, exclude, **options).collect():
        got[r["user_id"]][r["rank"]] = r["item_id"]
    assert {u: [ranks[x] for x in sorted(ranks)] for u, ranks in got.items()} == want


def test_ties_go_to_the_lower_item():
    scores = np.array([[1.0, 2.0, 2.0, 2.0, -np.inf], [-np.inf] * 5])
    out = predict._best(np.array([7, 8]), np.array([10, 20, 30, 40, 50]), scores, 2).to_pydict()
    assert out["item_id"] == [20, 30] and out["rank"] == [1, 2] and out["user_id"] == [7, 7]


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0, "hot_limit": 8}], ids=["broadcast", "spread"])
def test_pairs_and_cold_start(model, spark, options):
    pairs = spark.createDataFrame([(1, 2), (0, 0), (1, 777), (888, 2)], "user_id int, item_id int")
    cells = all_cells(model)
    got = {(r["user_id"], r["item_id"]): r["prediction"] for r in model.predict_pairs(pairs, **options).collect()}
    assert got[1, 2] == pytest.approx(cells[1, 2]) and got[0, 0] == pytest.approx(cells[0, 0])
    assert math.isnan(got[1, 777]) and math.isnan(got[888, 2])
    assert model.predict_pairs(pairs, "drop", **options).count() == 2
    with pytest.raises(ValueError):
        model.predict_pairs(pairs, "guess")


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0, "hot_limit": 8}], ids=["broadcast", "spread"])
def test_evaluate_and_objective(model, skewed, options):
    cells = all_cells(model)
    rows = triples(skewed)
    se = sum((r - cells[u, i]) ** 2 for u, i, r in rows)
    row = model.evaluate(skewed, **options).first()
    assert row["n"] == len(rows) and row["mse"] == pytest.approx(se / len(rows))
    assert row["rmse"] == pytest.approx(math.sqrt(se / len(rows)))
    users, items = collected(model.user_factors), collected(model.item_factors)
    penalty = sum(users[u] @ users[u] + items[i] @ items[i] for u, i, _ in rows)
    assert model.objective(skewed, **options).first()["objective"] == pytest.approx(se + 0.05 * penalty)


@pytest.mark.parametrize("options", [{}, GRID], ids=["broadcast", "grid"])
def test_dense_file(model, skewed, spark, tmp_path, options):
    path = dense.write_dense_predictions(model, str(tmp_path), timestamped=True, **options)
    assert "prediction_matrix_" in path
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert "60 60 real" in lines and len(lines) == 61
    users = model.user_factors.selectExpr("id as user_id")
    items = model.item_factors.selectExpr("id as item_id")
    back = dense.read_dense_predictions(spark, path, users, items).collect()
    cells = all_cells(model)
    assert len(back) == len(cells)
    assert all(r["prediction"] == pytest.approx(cells[r["user_id"], r["item_id"]], abs=1e-9) for r in back)
    scored = dense.score_dense_predictions(spark, path, skewed).first()
    direct = model.evaluate(skewed).first()
    assert scored["n"] == direct["n"] and scored["mse"] == pytest.approx(direct["mse"])


def test_dense_file_in_many_splits(model, skewed, spark, tmp_path):
    path = dense.write_dense_predictions(model, f"{tmp_path}/m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        scored = dense.score_dense_predictions(spark, path, skewed).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert scored["mse"] == pytest.approx(model.evaluate(skewed).first()["mse"])


def test_save_and_load(model, spark, tmp_path):
    model.save(f"{tmp_path}/model")
    back = ALSModel.load(spark, f"{tmp_path}/model")
    assert (back.rank, back.reg, back.users, back.items) == (3, 0.05, 60, 60)
    before, after = collected(model.user_factors), collected(back.user_factors)
    assert all((before[u] == after[u]).all() for u in before) and before.keys() == after.keys()


def test_unrated(skewed, spark):
    rows = triples(skewed)
    got = {r["user_id"]: (r["rated"], r["unrated"]) for r in predict.unrated_counts(skewed).collect()}
    items = len({i for _, i, _ in rows})
    for user in {u for u, _, _ in rows}:
        rated = len({i for u, i, _ in rows if u == user})
        assert got[user] == (rated, items - rated)
    pairs = spark.createDataFrame([(0, 0), (5, 59)], "user_id int, item_id int")
    known = {(u, i) for u, i, _ in rows}
    assert {tuple(r) for r in predict.rated_pairs(pairs, skewed).collect()} == {(0, 0), (5, 59)} & known
    assert {tuple(r) for r in predict.unrated_pairs(pairs, skewed).collect()} == {(0, 0), (5, 59)} - known

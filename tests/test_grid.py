"""Rectangles of the grid: rows sent do not grow with the cells, searches leave cells out, results stay whole."""

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from ridgeline import ALSFactorizer
from ridgeline.operators import prune

CELLS = {"broadcast_limit": 0, "user_block": 4, "item_block": 3}
#: Room for about two blocks of three items of rank 3.
NARROW = {**CELLS, "grid_bytes": 170}


@pytest.fixture(scope="module")
def model(skewed):
    return ALSFactorizer(rank=3, reg=0.05, max_iter=2).fit(skewed)


def rows_sent(monkeypatch, run):
    sent, real = [], DataFrame.mapInArrow

    def counted(self, *args, **options):
        sent.append(self.count())
        return real(self, *args, **options)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrame, "mapInArrow", counted)
        run()
    return sent


def test_vectors_are_sent_per_task_and_not_per_cell(model, spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    (sent,) = rows_sent(monkeypatch, lambda: model.predict_all(**CELLS))
    assert sent <= model.users + model.items * min(15, 4 * cores)  # cells: 60 * 20 + 60 * 15
    (sent,) = rows_sent(monkeypatch, lambda: model.recommend(4, **CELLS))
    assert sent <= model.users + model.items * min(15, 4 * cores)


def test_narrow_rectangles_give_the_same(model):
    cells = [{(r.user_id, r.item_id): r.prediction for r in model.predict_all(**o).collect()} for o in ({}, NARROW)]
    assert cells[0].keys() == cells[1].keys() and len(cells[0]) == 3600
    assert all(cells[0][c] == pytest.approx(cells[1][c], abs=1e-9) for c in cells[0])
    rows = [[(r.user_id, r.predictions) for r in model.predict_rows(**o).collect()] for o in ({}, NARROW)]
    assert [u for u, _ in rows[0]] == [u for u, _ in rows[1]]
    np.testing.assert_allclose([p for _, p in rows[0]], [p for _, p in rows[1]], atol=1e-9)
    for exclude in (True, False):
        best = [
            sorted((r.user_id, r["rank"], r.item_id, r.prediction) for r in model.recommend(4, exclude, **o).collect())
            for o in ({}, CELLS, NARROW)
        ]
        assert best[0] == best[1] == best[2] and best[0]


def test_vectors_of_one_length_are_left_out_too():
    """Lengths alone tell nothing here: every item is as long as the others."""
    angle = np.random.default_rng(3).uniform(0, np.pi / 2, 20_000)
    matrix = np.column_stack([np.cos(angle), np.sin(angle)])
    lengths = np.ones(len(matrix))
    order = prune.arranged(matrix, lengths, 50) if hasattr(prune, "arranged") else np.arange(len(matrix))
    x = matrix[:40]
    none = np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    rows, places, values, _, read = prune.top_k(x, order, matrix[order], lengths, none, 5, 50)
    assert read.max() <= 60  # of 400
    want = np.sort(x @ matrix.T, axis=1)[:, :-6:-1]
    np.testing.assert_allclose(values.reshape(40, 5), want, atol=1e-12)


def test_equal_vectors_come_in_id_order_wherever_they_lie():
    r = np.random.default_rng(5)
    matrix = np.tile(r.normal(size=(7, 3)), (300, 1))
    ids = np.sort(r.choice(10**6, len(matrix), replace=False))
    x = r.normal(size=(9, 3))
    (found,) = prune.finder(ids, matrix, 4, 16)(np.arange(9), x, None)
    best = (x @ matrix[:7].T).argmax(axis=1)
    assert found.column("item_id").to_pylist() == [int(ids[b + 7 * n]) for b in best for n in range(4)]

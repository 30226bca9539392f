"""Pruned top-k equals the plain one, ties and rated cells included, and skips blocks."""

import numpy as np
import pytest

from ridgeline import ALSFactorizer
from ridgeline.operators import prune


def plain(x, ids, matrix, rated, k):
    out = []
    for row in range(len(x)):
        left = [p for p in range(len(ids)) if (row, p) not in rated]
        best = sorted(left, key=lambda p: (-(x[row] @ matrix[p]), ids[p]))[:k]
        out += [(row, int(ids[p]), n + 1) for n, p in enumerate(best)]
    return out


@pytest.mark.parametrize("width", [1, 3, 7, 100])
@pytest.mark.parametrize("k", [1, 4, 60])
def test_equals_all_cells(width, k):
    r = np.random.default_rng(width * 100 + k)
    x = r.integers(-2, 3, (20, 3)).astype(float)  # small whole numbers: many exact ties
    matrix = r.integers(-2, 3, (50, 3)).astype(float)
    lengths = np.linalg.norm(matrix, axis=1)
    order = np.argsort(-lengths, kind="stable")
    ids = r.permutation(1000)[:50]
    rated = {(int(a), int(b)) for a, b in r.integers(0, [20, 50], (120, 2))}
    cells = tuple(np.array(sorted(rated)).T)
    rows, places, _, ranks, read = prune.top_k(x, ids, matrix[order], lengths[order], cells, k, width)
    assert list(zip(rows.tolist(), ids[places].tolist(), ranks.tolist())) == plain(x, ids, matrix[order], rated, k)
    assert (read <= -(-50 // width)).all()


def test_blocks_are_skipped():
    r = np.random.default_rng(1)
    x = np.abs(r.normal(1, 0.1, (30, 4)))
    matrix = np.abs(r.normal(1, 0.1, (5000, 4))) * (1 / np.arange(1, 5001))[:, None]
    lengths = np.linalg.norm(matrix, axis=1)
    order = np.argsort(-lengths)
    none = np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    *_, read = prune.top_k(x, np.arange(5000), matrix[order], lengths[order], none, 10, 100)
    assert (read == 1).all()


def test_model_gives_the_same_both_ways(spark, skewed):
    model = ALSFactorizer(rank=3, reg=0.05, max_iter=2).fit(skewed)
    for exclude in (True, False):
        best = [
            sorted((r.user_id, r.item_id, r.rank) for r in model.recommend(4, exclude, prune=p).collect()) for p in (True, False)
        ]
        assert best[0] == best[1] and best[0]
    found = model.recommend(4, prune=True)
    row = prune.blocks_read(found, model.items).first()
    assert row.users > 0 and row.read <= row.all_blocks

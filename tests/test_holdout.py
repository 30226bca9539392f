"""Held-out cells and the end of a fit."""

import pytest

from ridgeline import ALSFactorizer
from ridgeline.operators.holdout import Stop, split_cells

from brute import als, close, collected, triples

REG = 0.1


def errors(cells, users, items):
    known = [(u, i, r) for u, i, r in cells if u in users and i in items]
    return sum((r - users[u] @ items[i]) ** 2 for u, i, r in known) / len(known)


def test_split(skewed):
    kept, held = split_cells(skewed, 0.25, seed=3)
    assert kept.intersect(held).isEmpty() and kept.count() + held.count() == skewed.count()
    again = split_cells(skewed.repartition(5), 0.25, seed=3)[1]
    assert set(map(tuple, again.collect())) == set(map(tuple, held.collect()))
    assert 0.1 < held.count() / skewed.count() < 0.4
    with pytest.raises(ValueError):
        split_cells(skewed, 0.0)


@pytest.mark.parametrize("patience,gain", [(1, 0.05), (2, 0.05), (1, 0.9)])
def test_stop_follows_the_rule(skewed, patience, gain):
    kept, held = split_cells(skewed, 0.2)
    most = 6
    model = ALSFactorizer(rank=2, reg=REG, max_iter=most).fit(kept, stop=Stop(held, gain, patience))
    best, least, rows = 0, float("inf"), []
    for i in range(1, most + 1):
        users, items = als(triples(kept), 2, REG, i)
        error = errors(triples(held), users, items)
        improved = error < least * (1 - gain)
        rows.append((i, errors(triples(kept), users, items), error, improved))
        if improved:
            best, least, chosen = i, error, (users, items)
        if i - best >= patience:
            break
    found = [tuple(r) for r in model.held_out.orderBy("iteration").collect()]
    assert [(r[0], r[3]) for r in found] == [(r[0], r[3]) for r in rows]
    for got, want in zip(found, rows):
        assert got[1:3] == pytest.approx(want[1:3], abs=1e-9)
    close(collected(model.user_factors), chosen[0])
    close(collected(model.item_factors), chosen[1])
    model.assert_complete().release()


def test_refusals(spark, hand):
    fit = ALSFactorizer(rank=2, reg=REG, max_iter=2)
    for wrong in ({"gain": 1.0}, {"patience": 0}):
        with pytest.raises(ValueError):
            Stop(hand, **wrong)
    with pytest.raises(ValueError, match="resumed"):
        fit.fit(hand, stop=Stop(hand), resume="/nowhere")
    with pytest.raises(ValueError, match="held-out"):
        fit.fit(hand, stop=Stop(spark.createDataFrame([(77, 1, 3)], hand.schema)))

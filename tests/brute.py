"""The same computations in plain numpy, for small fixtures."""

import numpy as np


def start(ratings, rank, seed=0):
    users = sorted({u for u, _, _ in ratings})
    out = {}
    for u in users:
        mine = [r for x, _, r in ratings if x == u]
        rest = [((u * 7919 + q * 104729 + seed) % 10007 + 1) / 10008 for q in range(1, rank)]
        out[u] = np.array([sum(mine) / len(mine), *rest])
    return out


def half(ratings, fixed, side, reg):
    own, other = (1, 0) if side == "item" else (0, 1)
    out = {}
    for key in sorted({t[own] for t in ratings}):
        rows = [t for t in ratings if t[own] == key]
        x = np.array([fixed[t[other]] for t in rows])
        r = np.array([t[2] for t in rows], float)
        a = x.T @ x + reg * len(rows) * np.eye(x.shape[1])
        out[key] = np.linalg.solve(a, x.T @ r)
    return out


def als(ratings, rank, reg, iterations):
    users, items = start(ratings, rank), None
    for _ in range(iterations):
        items = half(ratings, users, "item", reg)
        users = half(ratings, items, "user", reg)
    return users, items


def collected(factors):
    return {r["id"]: np.array(r["features"]) for r in factors.collect()}


def close(got, want, tol=1e-9):
    assert sorted(got) == sorted(want)
    for key in want:
        np.testing.assert_allclose(got[key], want[key], rtol=tol, atol=tol)


def triples(df):
    return [(r["user_id"], r["item_id"], int(r["rating"])) for r in df.collect()]

"""Vector operators against brute force."""

import numpy as np
import pytest

from ridgeline.llm import codes, queries, scan

SF_DIR = "/root/testdata/sf0.01"


def made(seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 24))
    rows = [(i, (rng.normal(size=24) * rng.uniform(0.5, 3)).tolist()) for i in range(300)]
    for i in range(300, 500):  # tight and loose groups, some pairs close to the threshold
        rows.append((i, (centre[i % 6] + rng.normal(size=24) * [0.05, 0.25, 0.4][i % 3]).tolist()))
    rows += [(500 + i, rows[3][1]) for i in range(40)]  # equal vectors
    rows += [(600, None), (601, []), (602, [0.0] * 24), (603, [1.0, None] + [0.0] * 22), (604, [float("nan")] * 24)]
    rows += [(605, [float("inf")] + [0.0] * 23), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (None, rows[0][1]), (10, rows[11][1])]
    return rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def links(rows, threshold=0.9):
    good = [k for k, (i, v) in enumerate(rows) if i is not None and usable(v)]
    count = dict.fromkeys(range(len(rows)), 0)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(good):
        for b in good[:n]:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                count[a] += 1
                count[b] += 1
                i, j = find(rows[a][0]), find(rows[b][0])
                root[max(i, j)] = min(i, j)
    return count, {i: find(i) for i in root}


@pytest.mark.parametrize("cell", [512, 16])
def test_links_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(codes, "CELL", cell)
    rows = made(1)
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, factor double")
    found = codes.near_duplicates(table).collect()
    count, roots = links(rows)
    assert sorted((r.vec_id or -1, r.n_links) for r in found) == sorted((i if i else -1 if i is None else 0 or -1, count[k]) for k, (i, _) in enumerate(rows))
    for r in found:
        assert r.component_id == (roots[r.vec_id] if r.vec_id is not None else None)
        assert r.kept == (r.vec_id is None or r.component_id == r.vec_id)


def test_links_of_empty_tables(spark):
    for rows in ([], [(1, None)]):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert [(r.n_links, r.kept) for r in codes.near_duplicates(table).collect()] == [(0, True)] * len(rows)


def test_links_of_test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    count, roots = links(rows)
    found = {r.vec_id: r for r in queries.op7_embedding_dedup(spark, SF_DIR).collect()}
    assert {i: found[i].n_links for i in found} == {i: count[k] for k, (i, _) in enumerate(rows)}
    assert {i: found[i].component_id for i in found} == roots


def best(rows, every, top=20):
    found = {}
    good = {}
    for i, v in rows:
        if i is not None and usable(v) and len(v) == 24:
            good.setdefault(i, []).append(np.array(v))
    for q in (i for i in good if i % every == 0):
        scores = {i: max(sum(a * b for a, b in zip(x, y)) for x in good[q] for y in good[i]) for i in good if i != q}
        found[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:top]
    return found


@pytest.mark.parametrize("sample,cell", [(8192, 4096), (64, 32)])
def test_nearest_recall_and_order(spark, monkeypatch, sample, cell):
    monkeypatch.setattr(scan, "SAMPLE", sample)
    monkeypatch.setattr(scan, "CELL", cell)
    rows = [r for r in made(2) if r[0] != 10]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    found = {}
    for r in scan.nearest(table, "id % 20 = 0").orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    wanted = best(rows, 20)
    assert found.keys() == wanted.keys()
    hits = 0
    for q, near in found.items():
        assert [r for *_, r in near] == list(range(1, 21))
        assert [(i, s) for i, s, _ in near] == sorted(((i, s) for i, s, _ in near), key=lambda x: (-x[1], x[0]))
        exact = dict(wanted[q])
        assert all(abs(s - exact[i]) < 1e-9 for i, s, _ in near if i in exact)
        hits += len({i for i, *_ in near} & exact.keys())
    assert hits / (20 * len(found)) >= 0.95


@pytest.mark.parametrize("copies", [lambda i: 2, lambda i: 1 + 60 * (i == 7)])
def test_nearest_with_repeated_rows(spark, copies):
    """Repeats of an id neither take places nor shrink the search around a query."""
    rows = [(i, v) for i, v in made(2) if i is None or i < 500]
    rows = [(i, v) for i, v in rows for _ in range(copies(i))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in scan.nearest(table, "id % 20 = 0").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    wanted = best(rows, 20)
    assert found.keys() == wanted.keys() and all(len(x) == 20 for x in found.values())
    assert sum(len(found[q] & dict(wanted[q]).keys()) for q in found) / (20 * len(found)) >= 0.95


def test_nearest_with_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = scan.nearest(table, "id % 20 = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(2, 1.0), (1, 0.0)]
    for empty in (table.limit(0), spark.createDataFrame([(0, None)], table.schema)):
        assert scan.nearest(empty, "id % 20 = 0").count() == 0


def test_nearest_of_test_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas()
    vectors, ids = np.array(table.embedding.tolist(), dtype=float), table.vec_id.to_numpy()
    hits = total = 0
    rows = queries.op8_ann(spark, SF_DIR).toPandas()
    for q, near in rows.groupby("query_id"):
        scores = vectors @ vectors[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]]) & set(near.vec_id))
        total += 20
    assert total == 20 * (ids % 20 == 0).sum() and hits / total >= 0.95

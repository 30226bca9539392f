"""Near duplicates and components against brute force."""

import os
import random

import pytest

from ridgeline import workdir
from ridgeline.llm import minhash, queries
from ridgeline.llm.components import components


def truth(rows, size, percent=80):
    """doc_id -> smallest linked id, by comparing all pairs."""
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}, [(i, len(s)) for i, s in sets]


def made(seed, n=160):
    """Groups of edited copies, chains, shared passages and short texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    bases = [[word() for _ in range(r.choice([3, 4, 20, 60, 150, 700]))] for _ in range(12)]
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w += passage
        rows.append((i, " ".join(w) if r.random() < 0.8 else "\n".join(w).upper()))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]
    rows += [(7, rows[7][1]), (3, rows[90][1]), (None, rows[1][1])]
    return rows


@pytest.mark.parametrize("seed,shingle", [(1, 4), (2, 5)])
def test_against_all_pairs(spark, seed, shingle):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, -1, "a") for i, t in rows], "doc_id long, text string, n int, sketch string")
    found = minhash.near_duplicates(docs, shingle=shingle).collect()
    roots, sizes = truth(rows, shingle)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in found) == sorted(
        (i is None, i or 0, n) for i, n in sizes
    )
    for r in found:
        assert r.component_id == (roots[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == roots[r.doc_id])


def test_small_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 8)
    monkeypatch.setattr(minhash, "PROFILE", 64)
    rows = made(5, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    roots, _ = truth(rows, 4)
    found = minhash.near_duplicates(docs, shingle=4).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == roots


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0


def test_query_on_test_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    roots, _ = truth(rows, 4)
    assert {r.doc_id: r.component_id for r in queries.op4_minhash(spark, sf_dir).collect()} == roots


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 1), (200, 201), (201, 200)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {i: 10 for i in range(10, 41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert {r.node: r.component for r in found} == expected and len(found) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_rows_of_one_id_count_once(spark):
    """Repeats add no rows to the lists, and lists of repeated members are told apart."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(3000)}"
    rows = []
    for i in range(0, 24, 2):
        w = [word() for _ in range(40)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:-1] + [word()]))]
    repeated = rows + rows[:6] + [rows[0]] * 40
    docs = spark.createDataFrame(repeated, "doc_id long, text string")
    found = minhash.near_duplicates(docs, shingle=4).collect()
    roots, _ = truth(rows, 4)
    assert len(found) == len(repeated) and all(x.component_id == roots[x.doc_id] for x in found)


def test_lists_of_ids_with_several_texts_hold_each_id_once(spark, monkeypatch):
    """Hashes of an id that stands twice in a list would cancel, and unlike lists look the same."""
    made_lists = []
    whole = minhash._rare_lists
    monkeypatch.setattr(minhash, "_rare_lists", lambda *a: made_lists.append(whole(*a)) or made_lists[-1])
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words)), (1, " ".join(words[:-1] + ["x"])), (1, " ".join(words)), (2, " ".join(words[:-1] + ["y"]))]
    rows += rows[:2] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, shingle=4).collect()
    assert len(found) == len(rows) and {r.component_id for r in found} == {1}
    assert made_lists[0].count() == made_lists[0].distinct().count() > 0


def test_tables_that_nothing_reads_are_deleted(spark):
    """The result reads prints, classes and labels; first sketches, texts, lists and pairs are gone."""
    before = set(os.listdir(workdir.shared_dir(spark).removeprefix("file:")))
    rows = made(3)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(workdir.shared_dir(spark).removeprefix("file:"))) - before}
    assert left <= {"signatures", "classes", "class-sketches", "components", "mixed-lists", "repeated-ids"}
    linked, _ = truth(rows, 3)
    assert {r.doc_id: r.component_id for r in found.where("doc_id is not null").collect()} == linked

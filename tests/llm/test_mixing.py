"""Mixing: rates against a plain solver, posteriors that learn, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import mixing, queries


def solve(tokens, p, targets, most):
    """Many plain projected gradient steps with token weights."""
    total = tokens.sum()
    rate = np.ones(len(tokens))
    for _ in range(20000):
        residual = (p * (rate * tokens)[:, None]).sum(axis=0) / total - targets / total
        rate = np.clip(rate - p @ residual, 0, most if most is not None else np.inf)
    return rate


@pytest.mark.parametrize("most,shares", [(None, [0.9, 0.2, 0.1]), (1.0, [0.5, 0.2, 0.1]), (1.0, [2.0, 0.0, 0.0])])
def test_rates_reach_the_best_totals(spark, most, shares):
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 400, 200)
    p = rng.dirichlet([0.4, 0.3, 0.3], 200)
    frame = spark.createDataFrame(
        [(i, int(t), *map(float, row)) for i, (t, row) in enumerate(zip(tokens, p))],
        "doc_id long, tokens long, p0 double, p1 double, p2 double",
    ).persist()
    targets = np.array(shares) * tokens.sum()
    rated = mixing.fit_rates(frame, targets.tolist(), most)
    found = np.array([r[0] for r in rated.orderBy("doc_id").select("rate").collect()])
    assert (found >= 0).all() and (most is None or (found <= most).all())
    gap = lambda r: np.square((p * (r * tokens)[:, None]).sum(axis=0) - targets).sum() / tokens.sum() ** 2
    assert gap(found) <= gap(solve(tokens, p, targets, most)) + 1e-6


def test_posteriors_and_totals(spark):
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["aaing", "bbing", "ccing"] if i % 3 else ["xxing", "yying", "zz##"], 40)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, rate double")
    labels = docs.where("doc_id < 150").select("doc_id", F.when(F.col("doc_id") % 3 != 0, "good").otherwise("junk").alias("domain"))
    rows = mixing.mix(docs, labels, {"good": 0.9, "junk": 0.1}, budget=0.7).collect()
    assert all((x.posterior.good > 0.5) == (x.doc_id % 3 != 0) for x in rows)
    total = sum(x.tokens for x in rows)
    assert sum(x.rate * x.tokens * x.posterior.junk for x in rows) / total == pytest.approx(0.07, abs=1e-4)
    assert all(x.copies in (int(x.rate), int(x.rate) + 1) for x in rows)


def test_rows_of_every_kind(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (None, None), (None, "c d e"), (4, "w " * 50000)]
    docs = spark.createDataFrame([(i, t, 5, 1.0, 7) for i, t in rows], "doc_id long, text string, tokens int, rate double, row int")
    labels = spark.createDataFrame([(3, "good"), (4, None), (None, "good"), (2, "other")], "doc_id long, domain string")
    found = mixing.mix(docs, labels, {"good": 1.0, "junk": 1.0}, budget=1.0).collect()
    want = [(1, 0), (2, 0), (3, 2), (3, 2), (None, 1), (None, 0), (None, 3), (4, 50000)]
    assert sorted(map(repr, ((x.doc_id, x.tokens) for x in found))) == sorted(map(repr, want))
    assert all(x.rate >= 0 and x.posterior.good + x.posterior.junk == pytest.approx(1) for x in found)
    empty = mixing.mix(docs.limit(0), labels, {"good": 1.0, "junk": 1.0}, budget=1.0)
    assert empty.count() == 0


def test_query_equals_a_plain_classifier_and_solver(spark):
    """Posteriors, rates and totals of the registered query against numpy on the same buckets."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    by_doc = {}
    for x in words.select("doc_id", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect():
        by_doc.setdefault(x.doc_id, []).append(x.b)
    labels = {x.doc_id: x.domain for x in mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    domains = sorted(mixing.SHARES)
    counts = np.zeros((2, mixing.BUCKETS))
    for i, d in labels.items():
        np.add.at(counts[domains.index(d)], by_doc.get(i, []), 1)
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * mixing.BUCKETS))
    logs[:, counts.sum(axis=0) == 0] = 0
    logs -= logs.mean(axis=0)
    n = np.array([sum(d == x for x in labels.values()) for d in domains])
    shares = np.log((n + 0.5) / (n.sum() + 1))
    rows = queries.op5_mixing(spark, sf_dir).collect()
    odds = np.array([logs[:, by_doc.get(x.doc_id, [])].sum(axis=1) / np.sqrt(max(len(by_doc.get(x.doc_id, [])), 1)) + shares for x in rows])
    p = np.exp(odds - odds.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose(p, [[x[d] for d in domains] for x in rows], atol=1e-9)
    tokens = np.array([len(by_doc.get(x.doc_id, [])) for x in rows])
    assert tokens.tolist() == [x.tokens for x in rows]
    targets = 0.95 * tokens.sum() * np.array([mixing.SHARES[d] for d in domains])
    gap = lambda r: np.square((p * (r * tokens)[:, None]).sum(axis=0) - targets).sum() / tokens.sum() ** 2
    assert gap(np.array([x.rate for x in rows])) <= gap(solve(tokens, p, targets, None)) + 1e-9


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = mixing.label_domains(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    plan = mixing.posteriors(docs, labels, ["good", "junk"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""Quality: the prior is found, held-out labels and negatives' labels are not read, odd rows get scores."""

import random
import zlib

import numpy as np
import pytest

from ridgeline.llm import positive, queries

SF_DIR = "/root/testdata/sf0.01"


def made(n, good, seed):
    """Prose, or text whose words end in marks."""
    r = random.Random(seed)
    rows, labels = [], []
    for _ in range(n):
        label = r.random() < good
        word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
        words = [word() + ("" if label else r.choice(["###", "$$$"]) if r.random() < 0.5 else "") for _ in range(r.randrange(30, 200))]
        rows.append(" ".join(words).encode())
        labels.append(int(label))
    return rows, np.array(labels)


@pytest.mark.parametrize("good", [0.3, 0.6, 0.9])
def test_prior_and_accuracy(good):
    texts, labels = made(3000, good, 1)
    rows = list(positive.inputs(texts))
    trusted = [r for r, label in zip(rows[:1500], labels) if label]
    model = positive.fit_rows(trusted, rows[1500:])
    assert abs(model.prior - good) < 0.07
    more, truth = made(600, good, 2)
    assert ((model.scores(more) >= positive.THRESHOLD) == truth).mean() > 0.97


def test_estimate_prior_by_brute_force():
    r = np.random.default_rng(3)
    good, bad = r.normal(2, 1, 4000), r.normal(-2, 1, 3000)
    mixed = np.concatenate([r.normal(2, 1, 2000), bad[:2000]])
    found = positive.estimate_prior(good, mixed)
    slack = np.sqrt(np.log(40) / 2 / 4000) * 2
    best = min(((mixed >= t).mean() + slack) / (good >= t).mean() for t in good)
    at = [(mixed >= t).mean() / (good >= t).mean() for t in good if ((mixed >= t).mean() + slack) / (good >= t).mean() == best]
    assert any(abs(found - x) < 1e-9 for x in at) and abs(found - 0.5) < 0.05


def test_risk_is_the_least_found_by_plain_descent():
    """The fitted risk is no worse than that of a plain search with numerical slopes."""
    texts, labels = made(300, 0.6, 4)
    rows = [np.array([int("#" in t.decode()), 2 + int("$" in t.decode())]) for t in texts]
    position = np.arange(4)
    p = positive._Rows([r for r, label in zip(rows, labels) if label], position)
    u = positive._Rows(rows, position)

    def risk(x):
        a, b = p.margins(x[:-1], x[-1]), u.margins(x[:-1], x[-1])
        soft = lambda z: np.logaddexp(0, z).mean()
        return 0.6 * soft(-a) + max(0.0, soft(b) - 0.6 * soft(a)) + positive.PENALTY / 2 * (x[:-1] ** 2).sum()

    x = positive.fit_nonnegative(p, u, 4, 0.6, steps=600)
    y = np.zeros(5)
    for _ in range(600):
        slope = np.array([(risk(y + d) - risk(y - d)) / 2e-4 for d in 1e-4 * np.eye(5)])
        y -= 0.3 * slope
    assert risk(x) <= risk(y) + 0.02


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame(
        [(1, "a fine text", 0.5, "x"), (1, "a fine text", 0.5, "x"), (2, None, 0.1, "y"), (3, "", 0.1, "y"), (None, "z " * 700_000, 0.2, "q")],
        "doc_id long, text string, score double, print string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (2, None), (None, 1), (9, 1)], "doc_id long, quality int")
    rows = positive.score_documents(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.score for r in positive.score_documents(docs, labels.where("quality = 0")).collect()} == {0.5}
    assert positive.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_one_row_per_document_is_fitted_on(spark):
    docs = spark.createDataFrame([(1, "same text")] * 3000 + [(i, f"other text {i}") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 20)], "doc_id long, quality int")
    model = positive.fit(docs, labels, positives=10, unlabelled=15)
    again = positive.fit(docs.distinct(), labels, positives=10, unlabelled=15)
    assert np.array_equal(model.weights, again.weights) and model.prior == again.prior


def test_held_out_accuracy_and_labels(spark):
    rows = queries.op13_quality(spark, SF_DIR).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == t for p, t in known]) > 0.95


def test_only_learnable_positives_matter(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    without = labels.where("quality = 1")
    one, two, three = (
        {r.doc_id: r.score for r in positive.score_documents(docs, x).collect()} for x in (labels, turned, without)
    )
    assert one == two == three

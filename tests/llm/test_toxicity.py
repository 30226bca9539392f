"""Toxicity: interactions are learned, held-out labels are not, odd rows get scores."""

import random
import zlib

import numpy as np

from ridgeline.llm import queries, toxicity

SF_DIR = "/root/testdata/sf0.01"


def made(n, seed):
    """Label 1 only if an insult and a group mention meet; each alone is harmless."""
    r = random.Random(seed)
    rows, labels = [], []
    for _ in range(n):
        insult, group = r.random() < 0.5, r.random() < 0.5
        filler = " ".join(f"w{r.randrange(40)}" for _ in range(12))
        rows.append(f"{filler} {'vermin' if insult else ''} {'neighbours' if group else ''}")
        labels.append(int(insult and group))
    return rows, np.array(labels)


def test_pairs_are_learned():
    texts, labels = made(1500, 1)
    model = toxicity.fit_rows(list(toxicity.terms(texts)), labels)
    more, truth = made(500, 2)
    assert (np.abs(model.scores(more) - truth) < 0.3).mean() > 0.97


def test_terms_that_are_neutral_alone_are_paired():
    """Each word is as frequent in toxic texts as in clean ones; only which two meet tells."""
    r = random.Random(3)
    texts, labels = [], []
    for _ in range(2000):
        group, insult = r.random() < 0.5, r.random() < 0.5
        filler = " ".join(f"w{r.randrange(40)}" for _ in range(12))
        texts.append(f"{filler} {'neighbours' if group else 'weather'} {'vermin' if insult else 'flowers'}")
        labels.append(int(group == insult))
    rows, labels = list(toxicity.terms(texts)), np.array(labels)
    model = toxicity.fit_rows(rows[:1500], labels[:1500])
    assert ((model.scores(texts[1500:]) >= toxicity.THRESHOLD) == labels[1500:]).mean() > 0.97
    assert len(model.inputs) == len(np.unique(np.concatenate(rows[:1500])))


def test_degenerate_labels():
    rows = list(toxicity.terms(["a b", "c d", None]))
    for labels in (np.zeros(3, int), np.ones(3, int), np.zeros(0, int)):
        model = toxicity.fit_rows(rows[: len(labels)], labels)
        scores = model.scores(["a b", "", None])
        assert np.isfinite(scores).all() and (scores >= 0).all() and (scores <= 1).all()


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame(
        [(1, "you vermin", 0.5, "x"), (1, "you vermin", 0.5, "x"), (2, None, 0.1, "y"), (3, "", 0.1, "y"), (None, "z " * 90000, 0.2, "q")],
        "doc_id long, text string, score double, label string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    empty = toxicity.score_documents(docs.limit(0), labels.limit(0))
    assert empty.count() == 0


def test_held_out_accuracy_and_labels(spark):
    rows = queries.op9_toxicity(spark, SF_DIR).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    kept = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == t for p, t in kept]) > 0.9


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").selectExpr("doc_id", "toxic")
    turned = labels.selectExpr(
        "doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic"
    )
    one = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert one == {r.doc_id: r.score for r in toxicity.score_documents(docs, turned).collect()}

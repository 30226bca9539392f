"""Backoff scores against plain counting."""

import math
import random
from collections import Counter

import pytest

from ridgeline.llm import backoff


def brute(rows, min_count):
    docs = [(t or "").encode().lower().split() for _, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for w in docs:
        one.update(w)
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    total = sum(one.values())
    out = []
    for (doc_id, _), w in zip(rows, docs):
        score, backed = 0.0, 0
        for i, x in enumerate(w):
            if i >= 2 and three[w[i - 2], w[i - 1], x] >= min_count:
                value = three[w[i - 2], w[i - 1], x] / two[w[i - 2], w[i - 1]]
            elif i >= 1 and two[w[i - 1], x] >= min_count:
                value = (0.4 if i >= 2 else 1) * two[w[i - 1], x] / one[w[i - 1]]
                backed += i >= 2
            else:
                value = 0.4 ** min(i, 2) * one[x] / total
                backed += i >= 1
            score += math.log(value)
        out.append((doc_id, len(w), round(score, 6), backed))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_count", [1, 2, 4])
@pytest.mark.parametrize("batch,entries", [(8 << 20, 1 << 20), (700, 64)])
def test_against_counting(spark, monkeypatch, min_count, batch, entries):
    monkeypatch.setattr(backoff, "BATCH_BYTES", batch)
    monkeypatch.setattr(backoff, "TABLE_ENTRIES", entries)
    r = random.Random(min_count)
    rows = [(i, " ".join(r.choice("aAbcdefgh") for _ in range(r.choice([0, 1, 2, 3, 40])))) for i in range(60)]
    rows += [(99, None), (98, ""), (97, " \n"), (None, "a b c"), (5, "a b"), (5, "a b"), (96, "x\ty\vz " * 2000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int")
    found = backoff.log_scores(docs, min_count).collect()
    got = sorted(((r.doc_id, r.n_words, round(r.log_score, 6), r.n_backed_off) for r in found), key=repr)
    assert got == brute(rows, min_count)


def test_equal_rows_are_counted_first(spark, monkeypatch):
    monkeypatch.setattr(backoff, "HOT_BYTES", 2000)
    monkeypatch.setattr(backoff, "PIECE", 7)
    monkeypatch.setattr(backoff, "BATCH_BYTES", 2000)
    r = random.Random(7)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(20))) for i in range(300)]
    rows += [(1000, "a b c a b d")] * 300 + [(1001, None)] * 80 + [(None, "")] * 80 + [(None, "a b x")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted, size, repeated = backoff._counted(docs)
    assert repeated and size == sum(len(t or "") for _, t in rows)
    copies = {(r.doc_id, r.text): r.copies for r in counted.collect() if r.copies > 1}
    assert copies == {(1000, "a b c a b d"): 300, (1001, None): 80, (None, ""): 80, (None, "a b x"): 60}
    found = backoff.log_scores(docs).collect()
    got = sorted(((r.doc_id, r.n_words, round(r.log_score, 6), r.n_backed_off) for r in found), key=repr)
    assert got == brute(rows, 2)


def test_empty_table(spark):
    assert backoff.log_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0

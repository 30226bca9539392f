"""Token rollups: additive, idempotent, right after any batch."""

import random
from collections import Counter

import pytest

from ridgeline.llm import queries, rollup, tokens

FIELDS = "op string, doc_id long, tokenizer string, source string, lang string, tokens long, seq int"


def totals(kept):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in kept.totals().collect()}


def replay(batches):
    state = {}
    for batch in batches:
        last = {}
        for c in batch:
            key, rank = (c[1], c[2]), (c[6], c[0], c[5] or 0)
            if c[1] is not None and c[2] is not None and (key not in last or rank > last[key][0]):
                last[key] = (rank, c)
        for key, (_, c) in last.items():
            if c[0] == "delete":
                state.pop(key, None)
            else:
                state[key] = (c[3], c[4], c[5] or 0)
    sums = {}
    for (_, tokenizer), (source, lang, n) in state.items():
        docs, total = sums.get((source, lang, tokenizer), (0, 0))
        sums[source, lang, tokenizer] = (docs + 1, total + n)
    return sums


@pytest.mark.parametrize("compact_after", [None, 1])
def test_batches_and_replays(spark, tmp_path, compact_after):
    r = random.Random(3)
    batches = []
    for b in range(4):
        batch = []
        for seq in range(60):
            op = r.choice(["insert", "insert", "revise", "delete"])
            batch.append((op, r.randrange(25), r.choice("xy"), r.choice(["s", "t", None]), r.choice(["en", None]), r.choice([None, 0, 5, 9]), seq))
        batches.append(batch)
    batches[2].append(("insert", None, "x", "s", "en", 5, 0))
    kept = rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    assert totals(kept) == {}
    for b, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, FIELDS).selectExpr("*", "1 as live", "2 as docs")
        assert kept.apply(b, frame)
        assert not kept.apply(b, frame)
        if b == compact_after:
            kept.compact()
        assert totals(kept) == replay(batches[: b + 1])
    assert not kept.apply(1, spark.createDataFrame(batches[3], FIELDS))
    assert totals(kept) == replay(batches)
    before = totals(kept)
    kept.apply(9, spark.createDataFrame([], FIELDS))
    assert totals(kept) == before
    with pytest.raises(ValueError):
        kept.apply(7, spark.createDataFrame([], FIELDS))


def test_compactions_prune(spark, tmp_path):
    """Deltas and entries are folded; what two compactions have folded is gone, also if a
    compaction broke off before its end."""
    kept, batches = rollup.TokenRollup(spark, str(tmp_path / "rollup")), []
    for b in range(6):
        batches.append([("revise", i, "x", "s" if i % 2 else None, "en", b + i, 0) for i in range(b, b + 4)])
        batches[-1].append(("delete", b - 1, "x", None, None, None, 1))
        kept.apply(b, spark.createDataFrame(batches[-1], FIELDS))
        if b in (1, 3):
            kept.compact()
            kept.compact()  # nothing new
        if b == 4:
            kept.compact()
            (tmp_path / "rollup" / "folded" / "batch_id=4" / "_SUCCESS").unlink()
        assert totals(kept) == replay(batches)
        assert not kept.apply(b, spark.createDataFrame(batches[0], FIELDS))
    assert kept.committed() == list(range(6))
    kept.compact()
    assert totals(kept) == replay(batches)
    assert kept._versions("deltas") == kept._versions("entries") == [4, 5]
    assert kept._versions("folded") == [3, 5]
    assert not kept.apply(0, spark.createDataFrame(batches[0], FIELDS)) and totals(kept) == replay(batches)


def history_truth(rows, count):
    """Totals after the three batches of ``document_history``, documents in one place."""
    docs = {i: (s, l, t) for i, s, l, t in rows if i is not None}
    first = {}
    for i, _, _, t in rows:
        if t is not None and i is not None:
            first[t] = min(i, first.get(t, i))
    sums = Counter()
    for i, (source, lang, text) in docs.items():
        if text is not None and first[text] != i:
            continue
        lines = list(dict.fromkeys((text or "").split("\n")))
        shorter = text is not None and len(lines) < len(text.split("\n"))
        sums[source, lang, "docs"] += 1
        sums[source, lang, "tokens"] += count("\n".join(lines) if shorter else text)
    return {(s, l): (sums[s, l, "docs"], sums[s, l, "tokens"]) for s, l, kind in sums if kind == "docs"}


def test_bpe_query_against_plain_counting(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text").collect()]
    encode = tokens.encoder(tokens.vocabulary_path())
    found = queries.op3_token_counts_bpe(spark, sf_dir).collect()
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in found if r.tokenizer == rollup.BPE}
    assert got == history_truth(rows, lambda t: len(encode.ids([t])[0]))
    plain = {tuple(r) for r in queries.op3_token_counts(spark, sf_dir).collect()}
    assert {tuple(r) for r in found if r.tokenizer != rollup.BPE} == plain


def test_history_of_odd_documents(spark, tmp_path):
    rows = [(1, "s", "en", None), (2, "s", "en", ""), (3, None, "en", "a b\na b\nc"), (4, "s", None, " \n"), (5, "s", "en", "x " * 50000),
            (6, "s", "en", ""), (7, "t", "en", "x " * 50000), (8, "s", "en", None)]
    docs = spark.createDataFrame([(*r, "?") for r in rows + [(None, "s", "en", "lost")]], "doc_id long, source string, lang string, text string, tokens string")
    kept = rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    for b, changes in enumerate(rollup.document_history(docs)):
        kept.apply(b, changes)
    got = {(s, l): v for (s, l, name), v in totals(kept).items() if name == "words-1"}
    assert got == history_truth(rows, lambda t: len((t or "").split()))


def test_unfinished_attempt_is_replaced(spark, tmp_path):
    kept = rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    frame = spark.createDataFrame([("insert", 1, "x", "s", "en", 5, 0)], FIELDS)
    kept.apply(0, frame)
    folder = tmp_path / "rollup" / "deltas" / "batch_id=0"
    (folder / "_SUCCESS").unlink()  # as if the driver had died before the commit
    assert totals(kept) == {} and kept.apply(0, frame)
    assert totals(kept) == {("s", "en", "x"): (1, 5)}


def test_bpe_counts(spark):
    texts = ["one two three", None, "", "thandble orst."]
    found = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in found.select(rollup.bpe_count(found["text"], tokens.vocabulary_path())).collect()]
    assert sorted(found) == sorted(len(x) for x in tokens.encoder(tokens.vocabulary_path()).ids(texts))

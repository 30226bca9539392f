"""Packing: every id in exactly one piece, gapless sequences, little padding."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ridgeline.llm import packing, tokens

TEXTS = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "no id"), (5, "word " * 9000), (6, "ab " * 130)]


@pytest.mark.parametrize("capacity", [16, 100, 2048])
def test_cut_covers_a_length(capacity):
    for length in range(1, 3 * capacity, 7):
        pieces = packing.cut(length, capacity)
        assert sum(n for n, _ in pieces) == length
        assert all(1 <= n and n * k <= capacity for n, k in pieces)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack_round_trip(spark, capacity):
    docs = spark.createDataFrame(TEXTS * 20, "doc_id long, text string").withColumnRenamed("doc_id", "key")
    docs = docs.selectExpr("key as doc_id", "text", "'x' as ids", "1 as start").coalesce(2)
    rows = packing.pack(docs, tokens.vocabulary_path(), capacity=capacity).collect()
    whole = Tokenizer.from_file(tokens.vocabulary_path())
    wanted = sorted((i is None, i or 0, whole.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in TEXTS * 20)
    by_sequence = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) <= capacity
    # documents come back whole: pieces of equal documents may swap, so compare sorted contents
    found = {}
    for r in sorted(rows, key=lambda r: r.start):
        found.setdefault((r.doc_id is None, r.doc_id or 0, r.doc_tokens), {}).setdefault(r.start, []).append(
            np.frombuffer(r.ids, "<u4").tolist()
        )
    expected = {}
    for missing, doc_id, ids in wanted:
        expected.setdefault((missing, doc_id, len(ids)), []).append(ids)
    assert found.keys() == expected.keys()
    for key, ids in expected.items():
        assert sum(len(x) for parts in found[key].values() for x in parts) == sum(map(len, ids))
        for start, parts in found[key].items():
            assert all(p == ids[0][start : start + len(p)] for p in parts)
    if capacity == 16:
        total = sum(r.length for r in rows)
        assert total / (capacity * len(by_sequence)) > 0.9


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, tokens.vocabulary_path()).count() == 0


def test_query_on_test_table(spark):
    from ridgeline.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    rows = queries.op10_packing(spark, sf_dir).collect()
    whole = Tokenizer.from_file(tokens.vocabulary_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for doc_id, parts in pieces.items():
        ids = np.array(whole.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)

"""Registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from ridgeline.llm import oracle, queries

from test_minhash import truth

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    got = queries.queries()[name](spark, SF_DIR)
    want = db.execute(oracle.oracle_sql()[name])
    names = [c[0] for c in want.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert sorted(got.columns) == sorted(names)
    found = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, rows))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = [r.doc_id for r in docs.collect()]
        assert len(left) == len(set(left)) and set(left) <= kept
        gone = kept - set(left)
        if name == "toxicity":
            wrong = [i for i in gone if i in labels and labels[i].toxic == 0]
            missed = [i for i in left if i in labels and labels[i].toxic == 1]
            assert len(wrong) <= 1 and len(missed) <= len(gone) + 1
        if name == "near_duplicates":
            before = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "toxicity")).collect()]
            roots, _ = truth(before, 5)
            assert set(left) == {i for i, root in roots.items() if i == root}
        if name == "mixing":
            assert len(gone) < 0.2 * len(kept)
        kept = set(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in packed} == kept


def test_dedup_stage_decides_per_row(spark):
    a, b = "a b c d e f", "something else entirely is said here"
    rows = [(1, a), (1, a), (None, a), (None, a), (2, a), (2, b), (3, "x"), (None, None), (4, ""), (None, "")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, component_id int, kept string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    want = [(1, a), (2, b), (3, "x"), (None, None), (4, ""), (None, "")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, want))
    nulls = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.drop_near_duplicates(spark, nulls, SF_DIR).collect()) == [a, b]


def test_mixing_stage_decides_per_row(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr(
        "if(doc_id % 2 = 0, doc_id, null) as doc_id", "text", "lang", "1 as row", "2 as tokens", "3 as rate", "4 as taken_id", "'x' as copies"
    )
    out = corpus_pipeline.mix_domains(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    left, there = (df.where("doc_id is null").count() for df in (out, docs))
    assert 0.5 * there < left < there


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(None, None, None), (None, "", "en"), (7, None, None), (7, "  ", ""), (8, "word " * 250_000, "en"), (9, "fine text here", None), (9, "fine text here", None)]
    docs = spark.createDataFrame(
        [(i, t, x, 1, "s", 2) for i, t, x in rows], "doc_id long, text string, lang string, score int, sequence_id string, print int"
    )
    out = stage(spark, docs, SF_DIR)
    if name == "packing":
        pieces = out.collect()
        assert {r.doc_id for r in pieces} == {None, 7, 8, 9}
    else:
        assert out.columns == docs.columns
        kept = [(r.doc_id, r.text) for r in out.collect()]
        assert set(kept) <= {(i, t) for i, t, _ in rows}
        if name == "near_duplicates":
            assert len(kept) == len(rows) - 1
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0

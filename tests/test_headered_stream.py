"""Headered text as a stream: headers carry over splits, files, batches and restarts."""

import os

import pytest

from ridgeline.streaming import headered

TEXT = ["1:", "5,3,2004-01-02", "6,4,2004-01-03", "2:", "5,1,2004-02-01", "bad", "-4,2,2004-01-01", "x:", "9,1,2004-01-01", "3:", "", "7,5,"]


@pytest.fixture
def paths(tmp_path):
    os.makedirs(f"{tmp_path}/in")
    return {n: f"{tmp_path}/{n}" for n in ("in", "table", "check")}


def put(paths, name, lines):
    with open(f"{paths['in']}/{name}", "w") as out:
        out.write("".join(f"{x}\n" for x in lines))


def run(spark, paths, **options):
    headered.headered_stream(spark, paths["in"], paths["table"], paths["check"], **options).awaitTermination()


def found(spark, paths):
    rows = headered.landed_ratings(spark, paths["table"]).collect()
    bad = headered.landed_rejects(spark, paths["table"]).collect()
    return sorted((r.item_id, r.user_id, r.rating) for r in rows), sorted((r.line, r.reason) for r in bad)


WANT = [(1, 5, 3), (1, 6, 4), (2, 5, 1), (3, 7, 5)]
BAD = [("", "missing_field"), ("-4,2,2004-01-01", "negative_id"), ("9,1,2004-01-01", "no_header"), ("bad", "missing_field"), ("x:", "bad_header")]


@pytest.mark.parametrize("cuts", [[2, 6], [1, 2], [5, 8], [10, 11]])
def test_text_cut_anywhere(spark, paths, cuts):
    bounds = [0, *cuts, len(TEXT)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        put(paths, f"part-{k}", TEXT[a:b])
        run(spark, paths)  # a new query each time
    assert found(spark, paths) == (WANT, BAD)


def test_splits_inside_an_item(spark, paths):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        put(paths, "a", ["8:"] + [f"{u},1,2004-01-01" for u in range(50)])
        put(paths, "b", [f"{u},2,2004-01-01" for u in range(50, 80)] + ["9:"])
        put(paths, "c", [f"{u},3,2004-01-01" for u in range(20)])
        run(spark, paths)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows, bad = found(spark, paths)
    assert not bad and rows == sorted([(8, u, 1 if u < 50 else 2) for u in range(80)] + [(9, u, 3) for u in range(20)])


def test_replayed_batch_changes_nothing(spark, paths):
    put(paths, "a", TEXT[:2])
    run(spark, paths)
    put(paths, "b", TEXT[2:5])
    run(spark, paths)
    before = found(spark, paths)
    lines = spark.read.text(f"{paths['in']}/b").selectExpr(
        "value", "_metadata.file_path as file", "_metadata.file_block_start as split_start"
    )
    headered.land_batch(lines, 1, paths["table"])
    assert found(spark, paths) == before == (WANT[:3], [])


def test_late_file_stops_the_stream(spark, paths):
    put(paths, "b", TEXT[:2])
    run(spark, paths)
    put(paths, "a", TEXT[2:])
    with pytest.raises(Exception, match="arrived after"):
        run(spark, paths)


def test_nothing_landed(spark, paths):
    assert found(spark, paths) == ([], [])

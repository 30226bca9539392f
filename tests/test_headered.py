from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from ridgeline.operators.quality import duplicated_pairs, profile, split_rejects
from ridgeline.plans.derive import order_ratings
from ridgeline.sources.headered import (
    read_headered_ratings,
    scan_headered_lines,
    write_headered_ratings,
)

from conftest import SF_DIR

BAD = """9,3,2005-01-01
1:
10,3,2005-09-06
11,5,2005-05-13
x:
10,1,2005-01-01
2:
12,abc,2005-01-01
12

-1,4,2005-01-01
10,4,2005-10-19
10,2,2005-10-20
13,99999,2005-01-01
14,4
3:
-4:
10,5,2005-01-01
5:
  20 , 2 , 2005-03-04
"""


@contextmanager
def split_size(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def key(row):
    return (row["user_id"], row["item_id"], row["rating"], str(row["rated_on"]))


@pytest.fixture
def bad_file(tmp_path):
    path = tmp_path / "bad.txt"
    path.write_text(BAD)
    return str(path)


@pytest.mark.parametrize("size", [16, 64, 1 << 20])
def test_rejects(spark, bad_file, size):
    with split_size(spark, size):
        good, rejects = split_rejects(scan_headered_lines(spark, bad_file))
        good, rejects = sorted(map(key, good.collect())), rejects.collect()
    assert good == [
        (10, 1, 3, "2005-09-06"),
        (10, 2, 2, "2005-10-20"),
        (11, 1, 5, "2005-05-13"),
        (14, 2, 4, "None"),
        (20, 5, 2, "2005-03-04"),
    ]
    assert Counter((r["reason"], r["line"]) for r in rejects) == Counter(
        [
            ("no_header", "9,3,2005-01-01"),
            ("bad_header", "x:"),
            ("no_header", "10,1,2005-01-01"),
            ("bad_number", "12,abc,2005-01-01"),
            ("missing_field", "12"),
            ("missing_field", ""),
            ("negative_id", "-1,4,2005-01-01"),
            ("duplicate", "10,4,2005-10-19"),
            ("bad_number", "13,99999,2005-01-01"),
            ("negative_id", "-4:"),
            ("negative_id", "10,5,2005-01-01"),
        ]
    )


def test_modes(spark, bad_file):
    assert read_headered_ratings(spark, bad_file, "quarantine").count() == 5
    with pytest.raises(Exception, match="unusable ratings line"):
        read_headered_ratings(spark, bad_file).count()
    with pytest.raises(ValueError):
        read_headered_ratings(spark, bad_file, "lenient")


def test_item_without_ratings_does_not_exist(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1:\n2:\n5,3,2005-01-01\n")
    assert [key(r)[:3] for r in read_headered_ratings(spark, str(tmp_path)).collect()] == [(5, 2, 3)]


def test_header_does_not_leak_into_the_next_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1:\n5,3,2005-01-01\n")
    (tmp_path / "b.txt").write_text("6,4,2005-01-01\n2:\n7,1,2005-01-01\n")
    with split_size(spark, 1 << 20):
        good, rejects = split_rejects(scan_headered_lines(spark, str(tmp_path)))
        assert sorted(key(r)[:3] for r in good.collect()) == [(5, 1, 3), (7, 2, 1)]
        assert [tuple(r) for r in rejects.collect()] == [("6,4,2005-01-01", "no_header")]


@pytest.mark.parametrize("size", [2048, 8192, 1 << 27])
@pytest.mark.parametrize("chunk_rows", [None, 10])
def test_round_trip_in_any_split(spark, tmp_path, size, chunk_rows):
    ratings = order_ratings(spark, SF_DIR, dated=True)
    write_headered_ratings(ratings, f"{tmp_path}/out", chunk_rows)
    with split_size(spark, size):
        back = sorted(map(key, read_headered_ratings(spark, f"{tmp_path}/out").collect()))
    assert back == sorted(map(key, ratings.collect()))


def test_items_ascend_and_hot_items_are_cut(spark, skewed, tmp_path):
    write_headered_ratings(skewed, f"{tmp_path}/out", 10)
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/out").coalesce(1).collect()]
    raw = scan_headered_lines(spark, f"{tmp_path}/out")
    assert raw.filter("is_header and line = '0:'").count() >= 4
    headers = [int(x[:-1]) for x in lines if x.endswith(":")]
    assert Counter(headers).keys() == {r["item_id"] for r in skewed.select("item_id").distinct().collect()}


def test_copies_of_one_line_are_cut_too(spark, tmp_path):
    rows = spark.range(100).select(
        F.lit(1).alias("user_id"), F.lit(7).alias("item_id"), F.lit(3).cast("smallint").alias("rating")
    )
    write_headered_ratings(rows, f"{tmp_path}/out", 10)
    raw = scan_headered_lines(spark, f"{tmp_path}/out")
    assert raw.filter("not is_header").count() == 100
    assert raw.filter("is_header").count() >= 4
    good, rejects = split_rejects(raw)
    assert good.count() == 1 and rejects.count() == 99


def test_profile_and_duplicates(spark, hand):
    row = profile(hand).first()
    assert (row["users"], row["items"], row["ratings"]) == (4, 4, 7)
    assert row["sparsity"] == pytest.approx(1 - 7 / 16)
    about = profile(hand, approximate=True).first()
    assert (about["users"], about["items"]) == (4, 4)
    twice = hand.unionByName(hand.limit(2))
    assert sorted(r["n"] for r in duplicated_pairs(twice).collect()) == [2, 2]


def test_lines_are_parsed_once(spark, tmp_path):
    """What reads the written table finds the fields in it; rejects and ratings split no line again."""
    (tmp_path / "a.txt").write_text("1:\n5,3,2024-01-02\n5,4,2024-01-03\n6, ,\n7\n8,x,\n9,2,never\n")
    good, rejects = split_rejects(scan_headered_lines(spark, str(tmp_path)))
    for frame in (good, rejects):
        assert "split(line" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.user_id, r.rating, r.rated_on is None) for r in good.collect()) == [(5, 4, False), (9, 2, True)]
    assert sorted(tuple(r) for r in rejects.collect()) == [
        ("5,3,2024-01-02", "duplicate"), ("6, ,", "missing_field"), ("7", "missing_field"), ("8,x,", "bad_number")
    ]

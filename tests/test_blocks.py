from pyspark.sql import functions as F

from ridgeline.operators import blocks

from brute import triples


def test_negative_ids_have_a_block(spark):
    rows = blocks.with_block(spark.createDataFrame([(-1,), (9,)], "id int"), "id", 4).collect()
    assert {r["id"]: r["block"] for r in rows} == {-1: 3, 9: 1}


def test_placed_blocks_share_a_partition(skewed):
    placed = blocks.with_block(skewed, "user_id", 4, place=True)
    seen = {(r["block"], r["part"]) for r in placed.withColumn("part", F.spark_partition_id()).collect()}
    assert len(seen) == 4


def test_long_lists_are_cut(skewed):
    rows = blocks.in_blocks(skewed, "item", max_entries=8).collect()
    assert max(len(r["entries"]) for r in rows) <= 20
    got = sorted((e["other_id"], r["id"], e["rating"]) for r in rows for e in r["entries"])
    assert got == sorted(triples(skewed))


def test_a_block_is_listed_once(skewed):
    rows = triples(skewed)
    for r in blocks.out_blocks(skewed, "item", 4).collect():
        assert r["blocks"] == sorted({u % 4 for u, i, _ in rows if i == r["id"]})


def test_dependents_cover_the_list(skewed):
    found = blocks.dependents_in_block(blocks.in_blocks(skewed, "user"), 4).collect()
    assert all(x % 4 == r["block"] for r in found for x in r["dependent_ids"])
    got = sorted((r["id"], x) for r in found for x in r["dependent_ids"])
    assert got == sorted((u, i) for u, i, _ in triples(skewed))


def test_volume_and_stats(skewed):
    rows = triples(skewed)
    got = {r["side"]: (r["all_to_all"], r["block_to_block"]) for r in blocks.comm_volume(skewed, 4).collect()}
    assert got["user"] == (len(rows), len({(u, i % 4) for u, i, _ in rows}))
    assert got["item"] == (len(rows), len({(i, u % 4) for u, i, _ in rows}))
    exact = {r["block"]: r["ids"] for r in blocks.block_stats(skewed, "user", 4).collect()}
    about = {r["block"]: r["ids"] for r in blocks.block_stats(skewed, "user", 4, approximate=True).collect()}
    assert exact == about == {b: 15 for b in range(4)}


def test_rekey_keeps_every_rating(skewed):
    for partitions in (None, 3):
        rows = blocks.rekey(skewed, "user", partitions).collect()
        assert sorted(tuple(r) for r in rows) == sorted(triples(skewed))

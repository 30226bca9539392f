import os

import pytest
from pyspark.sql import functions as F

from ridgeline import ALSFactorizer
from ridgeline.schemas import RATING_EVENTS
from ridgeline.streaming import counts, source, upsert

FIT = ALSFactorizer(rank=2, reg=0.05, max_iter=1)


def events(spark, rows):
    raw = spark.createDataFrame(rows, "user_id int, item_id int, rating int, at string, seq bigint")
    return raw.select(
        "user_id", "item_id", F.col("rating").cast("smallint").alias("rating"),
        F.col("at").cast("timestamp").alias("rated_at"), "seq",
    )


def put(spark, path, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(path)


def ratings_of(df):
    return {(r["user_id"], r["item_id"]): r["rating"] for r in df.collect()}


FIRST = [(1, 1, 2, "2024-01-02", 1), (1, 1, 5, "2024-01-03", 2), (2, 1, 3, "2024-01-01", 3)]
SECOND = [(1, 1, 4, "2024-01-01", 4), (2, 1, 1, "2024-02-01", 5), (7, 9, 5, "2024-01-01", 6)]


@pytest.fixture
def paths(tmp_path):
    return {n: f"{tmp_path}/{n}" for n in ("in", "table", "check")}


def test_restart_keeps_the_latest_and_refits(spark, paths):
    def run():
        stream = source.read_ratings_stream(spark, paths["in"])
        upsert.refit_stream(stream, paths["table"], paths["check"], 1, FIT).awaitTermination()

    put(spark, paths["in"], FIRST)
    run()
    assert ratings_of(upsert.current_ratings(spark, paths["table"])) == {(1, 1): 5, (2, 1): 3}
    assert upsert.latest_model(spark, paths["table"]).users == 2
    put(spark, paths["in"], SECOND)
    run()
    want = {(1, 1): 5, (2, 1): 1, (7, 9): 5}
    assert ratings_of(upsert.current_ratings(spark, paths["table"])) == want
    assert ratings_of(upsert.current_ratings(spark, paths["table"], up_to=0)) == {(1, 1): 5, (2, 1): 3}
    model = upsert.latest_model(spark, paths["table"])
    assert (model.users, model.items) == (3, 2)  # unseen ids are new rows


def test_replayed_batch_changes_nothing(spark, paths):
    for _ in range(2):
        upsert.write_delta(events(spark, FIRST), 0, paths["table"])
        upsert.write_delta(events(spark, SECOND), 1, paths["table"])
        upsert.compact(spark, paths["table"], 1)
    assert ratings_of(upsert.current_ratings(spark, paths["table"])) == {(1, 1): 5, (2, 1): 1, (7, 9): 5}


def test_unfinished_folder_is_ignored(spark, paths):
    upsert.write_delta(events(spark, FIRST), 0, paths["table"])
    upsert.compact(spark, paths["table"], 0)
    upsert.write_delta(events(spark, SECOND), 1, paths["table"])
    upsert.compact(spark, paths["table"], 1)
    os.remove(f"{paths['table']}/base/version=1/_SUCCESS")
    assert ratings_of(upsert.current_ratings(spark, paths["table"])) == {(1, 1): 5, (2, 1): 1, (7, 9): 5}


def test_prune_keeps_what_is_needed(spark, paths):
    for batch in range(4):
        upsert.write_delta(events(spark, FIRST if batch % 2 == 0 else SECOND), batch, paths["table"])
        upsert.compact(spark, paths["table"], batch)
    before = ratings_of(upsert.current_ratings(spark, paths["table"]))
    upsert.prune(spark, paths["table"])
    assert sorted(os.listdir(f"{paths['table']}/base")) == ["version=2", "version=3"]
    assert ratings_of(upsert.current_ratings(spark, paths["table"])) == before


def test_empty_table(spark, paths):
    assert upsert.current_ratings(spark, paths["table"]).count() == 0
    assert upsert.latest_model(spark, paths["table"]) is None
    assert counts.current_counts(spark, paths["table"]).count() == 0


@pytest.mark.parametrize("side", ["item", "user"])
def test_counts_grow_with_the_stream(spark, paths, side):
    def run():
        stream = source.read_ratings_stream(spark, paths["in"], max_files_per_trigger=1)
        running = counts.rating_counts_stream(stream, side)
        counts.write_counts_stream(running, paths["table"], paths["check"]).awaitTermination()
        return {r["id"]: (r["n"], r["total"]) for r in counts.current_counts(spark, paths["table"]).collect()}

    put(spark, paths["in"], FIRST)
    assert run() == ({1: (3, 10)} if side == "item" else {1: (2, 7), 2: (1, 3)})
    put(spark, paths["in"], SECOND)
    assert run() == ({1: (5, 15), 9: (1, 5)} if side == "item" else {1: (3, 11), 2: (2, 4), 7: (1, 5)})


def test_stream_of_json_files(spark, paths):
    events(spark, FIRST).write.json(paths["in"])
    stream = source.read_ratings_stream(spark, paths["in"], RATING_EVENTS, "json")
    assert stream.isStreaming
    upsert.upsert_stream(stream, paths["table"], paths["check"]).awaitTermination()
    assert ratings_of(upsert.current_ratings(spark, paths["table"])) == {(1, 1): 5, (2, 1): 3}

"""Rating lists as stream state: latest wins, restarts go on, hot lists are cut."""

import pytest
from pyspark.sql import functions as F

from ridgeline.streaming import lists, source

from test_streaming import events


def put(spark, path, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(path)


def run(spark, paths, side="item", parts=4, table=None):
    stream = source.read_ratings_stream(lists.stateful_session(spark), paths["in"], max_files_per_trigger=1)
    changes = lists.rating_lists_stream(stream, side, parts)
    lists.write_lists_stream(changes, paths["check"], table).awaitTermination()
    return lists.read_rating_lists(spark, paths["check"])


@pytest.fixture
def paths(tmp_path):
    return {n: f"{tmp_path}/{n}" for n in ("in", "table", "check")}


def test_lists_go_on_after_a_restart(spark, paths):
    put(spark, paths["in"], [(1, 1, 2, "2024-01-02", 1), (1, 1, 5, "2024-01-03", 2), (2, 1, 3, "2024-01-01", 3)])
    put(spark, paths["in"], [(u, 8, 1 + u % 5, "2024-01-01", u) for u in range(40)])
    first = run(spark, paths, table=paths["table"])
    assert {(r.id, r.other_id): r.rating for r in first.where("id = 1").collect()} == {(1, 1): 5, (1, 2): 3}
    put(spark, paths["in"], [(1, 1, 4, "2024-01-01", 4), (2, 1, 1, "2024-02-01", 5), (7, 9, 5, None, None), (7, 9, 5, None, None)])
    put(spark, paths["in"], [(None, 1, 3, "2024-01-01", 1), (3, None, 3, "2024-01-01", 1), (2, 1, 2, "2024-02-01", 5)])
    later = run(spark, paths, table=paths["table"])
    found = {(r.id, r.other_id): r.rating for r in later.collect()}
    # The earlier rating of (1, 1) changes nothing; of equal times the greater rating stays.
    assert found == {(1, 1): 5, (1, 2): 2, (9, 7): 5} | {(8, u): 1 + u % 5 for u in range(40)}
    # The hot list is kept in several parts, each in order and bounded.
    parts = {r.part: r.entries for r in lists.in_lists(later.where("id = 8")).collect()}
    assert len(parts) == 4 and sorted(e.other_id for p in parts.values() for e in p) == list(range(40))
    # The state of an earlier batch can be read too, and changed entries have landed.
    old = lists.read_rating_lists(spark, paths["check"], 1).where("id = 1 and other_id = 2").first()
    assert old.rating == 3
    landed = spark.read.parquet(paths["table"])
    assert landed.where("id = 1 and other_id = 2").agg(F.max_by("rating", "batch")).first()[0] == 2


def test_other_sessions_are_refused(spark, paths):
    put(spark, paths["in"], [(1, 1, 2, "2024-01-02", 1)])
    with pytest.raises(ValueError, match="stateful_session"):
        lists.rating_lists_stream(source.read_ratings_stream(spark, paths["in"]))
    with pytest.raises(ValueError, match="parts"):
        lists.rating_lists_stream(source.read_ratings_stream(lists.stateful_session(spark), paths["in"]), parts=0)


def test_entries_are_kept_by_an_aggregate_and_late_events_return_nothing(spark, paths):
    """No call into Python for each entry: the state operator is Spark's own."""
    put(spark, paths["in"], [(1, 1, 2, "2024-01-02", 1), (2, 1, 3, "2024-01-02", 2)])
    stream = lists.rating_lists_stream(source.read_ratings_stream(lists.stateful_session(spark), paths["in"]), "item", 4)
    query = lists.write_lists_stream(stream, paths["check"], paths["table"])
    query.awaitTermination()
    assert [o["operatorName"] for o in query.lastProgress["stateOperators"]] == ["stateStoreSave"]
    put(spark, paths["in"], [(1, 1, 5, "2024-01-01", 3), (2, 1, 3, "2024-01-02", 2), (3, 1, 1, "2024-01-02", 4)])
    run(spark, paths, table=paths["table"])
    landed = [(r.batch, r.other_id, r.rating) for r in spark.read.parquet(paths["table"]).collect()]
    assert sorted(landed) == [(0, 1, 2), (0, 2, 3), (1, 3, 1)]

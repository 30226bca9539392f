"""Sketched profile of a stream."""

import pytest
from pyspark.sql import functions as F

from ridgeline import workdir
from ridgeline.operators.quality import profile as exact_profile
from ridgeline.plans.derive import event_ratings, table
from ridgeline.streaming import profile

from conftest import SF_DIR


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_small_counts_are_exact(spark, hand):
    found = profile.estimates(profile.sketches(hand)).first()
    exact = exact_profile(hand).first()
    assert (found["users"], found["items"], found["ratings"]) == (exact["users"], exact["items"], exact["ratings"])
    assert found["cells"] == 7 and found["sparsity"] == pytest.approx(exact["sparsity"])
    assert (found["mean"], found["lowest"], found["highest"]) == (20 / 7, 1, 5)


def test_merge_of_parts_is_one_pass(spark):
    events = event_ratings(table(spark, SF_DIR, "events"))
    parts = [events.where(F.col("seq") % 3 == i) for i in range(3)]
    parts = [profile.sketches(p, ("rating",)) for p in parts]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    whole = profile.sketches(events, ("rating",))
    for by in (("rating",), ()):
        # A union of copies estimates by the registers alone, as a union of parts does.
        once = rows_of(profile.estimates(profile.merge(whole.unionByName(whole), by)).drop("ratings", "mean"))
        assert rows_of(profile.estimates(profile.merge(merged, by)).drop("ratings", "mean")) == once
    count = profile.merge(merged).first()["ratings"]
    assert count == events.count()


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, None, 3), (None, 2, None), (1, 2, 5), (1, 2, 5)], "user_id int, item_id int, rating smallint")
    found = profile.estimates(profile.sketches(rows)).first()
    assert (found["users"], found["items"], found["cells"], found["ratings"]) == (1, 1, 1, 4)
    assert profile.sketches(rows.limit(0)).count() == 0
    assert profile.merge(profile.sketches(rows.limit(0))).count() == 0
    with pytest.raises(ValueError, match="no batch"):
        profile.current_profile(spark, workdir.new_run_dir(spark, "t"))


@pytest.mark.parametrize("compact_every", [1, 2, 16])
def test_stream_with_a_restart(spark, skewed, compact_every):
    path = workdir.new_run_dir(spark, "t")
    skewed.repartition(4).write.parquet(f"{path}/in")

    def run():
        stream = spark.readStream.schema(skewed.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        profile.profile_stream(stream, f"{path}/table", f"{path}/checkpoint", compact_every=compact_every).awaitTermination()

    run()
    more = skewed.selectExpr("user_id + 1000 as user_id", "item_id", "rating")
    more.coalesce(1).write.mode("append").parquet(f"{path}/in")
    run()
    found = profile.current_profile(spark, f"{path}/table").first()
    exact = exact_profile(skewed.union(more)).first()
    assert (found["users"], found["items"], found["ratings"]) == (exact["users"], exact["items"], exact["ratings"])
    before = profile.current_profile(spark, f"{path}/table", up_to=3).first()
    assert before["ratings"] == skewed.count()
    assert len(workdir.list_versions(spark, f"{path}/table/base", "version")) <= 2
    assert len(workdir.list_versions(spark, f"{path}/table", "batch")) <= max(5, 2 * compact_every)
    if compact_every == 1:
        with pytest.raises(ValueError, match="up to 0"):
            profile.current_profile(spark, f"{path}/table", up_to=0)

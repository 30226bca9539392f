"""Streams leave a bounded number of folders, and replays change nothing."""

import os

from pyspark.sql import functions as F

from ridgeline import ALSFactorizer
from ridgeline.schemas import RATING_EVENTS
from ridgeline.streaming import counts, source, upsert


def put(spark, path, batch):
    rows = [(batch % 3, i, (batch + i) % 5 + 1, batch * 10 + i) for i in range(4)]
    frame = spark.createDataFrame(rows, "user_id int, item_id int, rating int, seq bigint")
    frame.select(
        "user_id", "item_id", F.col("rating").cast("smallint").alias("rating"),
        F.timestamp_seconds(F.col("seq") * 60).alias("rated_at"), "seq",
    ).coalesce(1).write.mode("append").parquet(path)


def folders(path, start):
    return [f for f in os.listdir(path) if f.startswith(start)] if os.path.isdir(path) else []


def stream_of(spark, path):
    return source.read_ratings_stream(spark, path, RATING_EVENTS, max_files_per_trigger=1)


def test_upserts_and_counts_stay_bounded(spark, tmp_path):
    files = str(tmp_path / "in")
    for batch in range(10):
        put(spark, files, batch)
    table, tally = str(tmp_path / "table"), str(tmp_path / "tally")
    upsert.upsert_stream(stream_of(spark, files), table, str(tmp_path / "c1"), compact_every=2).awaitTermination()
    running = counts.rating_counts_stream(stream_of(spark, files), "item")
    counts.write_counts_stream(running, tally, str(tmp_path / "c2"), compact_every=2).awaitTermination()
    assert len(folders(f"{table}/delta", "batch=")) <= 4 and len(folders(f"{table}/base", "version=")) <= 2
    assert len(folders(tally, "batch=")) <= 4 and len(folders(f"{tally}/base", "version=")) <= 2
    everything = spark.read.parquet(files)
    wanted = sorted(tuple(r) for r in upsert.latest_per_pair(everything).collect())
    assert sorted(tuple(r) for r in upsert.current_ratings(spark, table).select(*RATING_EVENTS.fieldNames()).collect()) == sorted(
        tuple(r) for r in upsert.latest_per_pair(everything).select(*RATING_EVENTS.fieldNames()).collect()
    ) and wanted
    totals = {r.item_id: (r.n, r.t) for r in everything.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("rating").alias("t")).collect()}
    assert {r.id: (r.n, r.total) for r in counts.current_counts(spark, tally).collect()} == totals
    # the last batch once more, after it was folded
    last = spark.read.schema(counts.SCHEMA).parquet(f"{tally}/batch=9")
    rows = spark.createDataFrame(last.collect(), last.schema)
    rows.write.mode("overwrite").parquet(f"{tally}/batch=9")
    counts._fold(spark, tally, 9)
    assert {r.id: (r.n, r.total) for r in counts.current_counts(spark, tally).collect()} == totals


def test_trailing_batches_are_fitted(spark, tmp_path):
    files, table = str(tmp_path / "in"), str(tmp_path / "table")
    for batch in range(4):
        put(spark, files, batch)
    fit = ALSFactorizer(rank=2, reg=0.05, max_iter=1)
    upsert.refit_stream(stream_of(spark, files), table, str(tmp_path / "c"), 3, fit).awaitTermination()
    assert upsert.refit_pending(spark, table, fit)
    assert not upsert.refit_pending(spark, table, fit)
    everything = upsert.latest_per_pair(spark.read.parquet(files))
    again = fit.fit(everything)
    got = sorted((r.id, *[round(x, 9) for x in r.features]) for r in upsert.latest_model(spark, table).user_factors.collect())
    assert got == sorted((r.id, *[round(x, 9) for x in r.features]) for r in again.user_factors.collect())
    again.release()

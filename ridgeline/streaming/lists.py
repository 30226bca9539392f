"""Per-entity rating lists kept by a stream.

The list of an entity is state of a streaming aggregate: one entry under (id, part, other_id)
with the latest rating. An entry is one key of the state store, so a new rating costs its
own size whatever the length of the list, and the entries of a hot id are kept by all tasks.
``part`` is a hash of the counterpart that bounds what ``in_lists`` gathers into one record;
the number of parts is fixed when the stream is first started, since an entry must be found
again where it was put.

State is written with each micro-batch below the checkpoint. ``read_rating_lists`` reads it
from there, also while the stream rests, and a restarted stream goes on from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.schemas import side_columns

#: The store that keeps entries on disk; the default one holds all of them in memory.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
#: Stands for a missing time or sequence: before all others.
_EARLIEST = -(1 << 63)


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in ``STORE``."""
    session = spark.newSession()
    session.conf.set(_STORE_KEY, STORE)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    return session


def rating_lists_stream(stream: DataFrame, side: str = "item", parts: int = 16) -> DataFrame:
    """Entries (id, part, other_id, rating) of the lists as a micro-batch replaces them.

    An entry holds the rating with the greatest (time, sequence, rating). Events that replace
    nothing return nothing; one that repeats the rating at a later time returns it again.
    ``stream`` has rating events and comes from a ``stateful_session``.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    if stream.sparkSession.conf.get(_STORE_KEY) != STORE:
        raise ValueError("read the stream from lists.stateful_session(spark)")
    own, other = side_columns(side)
    early = F.lit(_EARLIEST)
    now = F.unix_micros(F.current_timestamp())  # the same for a whole micro-batch, replayed or not
    rows = stream.where(F.col(own).isNotNull() & F.col(other).isNotNull() & F.col("rating").isNotNull()).select(
        F.col(own).alias("id"),
        F.pmod(F.xxhash64(other), F.lit(parts)).cast("int").alias("part"),
        F.col(other).alias("other_id"),
        F.coalesce(F.unix_micros("rated_at"), early).alias("at"),
        F.coalesce("seq", early).alias("seq"),
        F.col("rating").cast("int").alias("rating"),
        # Of equal events the first to arrive stays, so a replaced entry is one that arrived now.
        (-now).alias("arrived"),
    )
    latest = F.max(F.struct("at", "seq", "rating", "arrived")).alias("latest")
    entries = rows.groupBy("id", "part", "other_id").agg(latest)
    return entries.where(F.col("latest.arrived") == -now).select(
        "id", "part", "other_id", F.col("latest.rating").cast("smallint").alias("rating")
    )


def write_lists_stream(changes: DataFrame, checkpoint: str, table_path: str | None = None, trigger: dict | None = None):
    """Start the stream; with ``table_path``, changed entries land below ``batch=<id>`` too."""
    writer = changes.writeStream.outputMode("update")
    if table_path is None:
        writer = writer.format("noop")
    else:
        writer = writer.foreachBatch(
            lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        )
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_rating_lists(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Entries (id, part, other_id, rating) as the state had them after a micro-batch, the last by default."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    state = reader.load(checkpoint)
    return state.select(
        F.col("key.id").alias("id"),
        F.col("key.part").alias("part"),
        F.col("key.other_id").alias("other_id"),
        F.col("value.max.rating").cast("smallint").alias("rating"),
    )


def in_lists(entries: DataFrame) -> DataFrame:
    """(id, part, entries): one bounded, ordered list per part of an entity."""
    return entries.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("other_id", "rating"))).alias("entries"))

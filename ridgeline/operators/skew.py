"""Hot keys: finding them and spreading their rows.

An id is hot when it holds more than ``limit`` ratings. The limit is the caller's and
never depends on the data, so what one task, list or record holds is bounded by it. The
table of hot ids is broadcast while its counted rows are few; beyond that it is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline import workdir

#: Most rows of a hot-id table that are broadcast.
BROADCAST_IDS = 100_000
DEFAULT_HOT_ROWS = 1_000_000


def row_limit(wanted: int | None = None) -> int:
    """Row count above which an id is hot."""
    return max(DEFAULT_HOT_ROWS if wanted is None else wanted, 1)


def hot_ids(counts: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, parts) for ids above the limit. ``counts`` has columns key, n.

    Written, with the broadcast hint if its counted rows allow it.
    """
    spark = counts.sparkSession
    hot = counts.filter(F.col("n") > limit).select(
        key, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("parts")
    )
    hot = workdir.write_table(hot, workdir.new_run_dir(spark, "hot-ids"))
    return F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot


def find_hot(rows: DataFrame, key: str, wanted: int | None = None):
    """(hot ids or None, limit), from one counting pass over ``rows``.

    The per-id counts are written, so neither the largest nor the hot ids read
    the rows again.
    """
    spark = rows.sparkSession
    path = workdir.new_run_dir(spark, "counts")
    counts = workdir.write_table(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), path)
    most = counts.agg(F.max("n")).first()[0] or 0
    limit = row_limit(wanted)
    hot = hot_ids(counts, key, limit) if most > limit else None
    workdir.delete_dir(spark, path)
    return hot, limit


def spread(df: DataFrame, hot: DataFrame, key: str, by, out: str) -> DataFrame:
    """Add ``out``: 0 for ordinary ids, 0..parts-1 (by a hash of ``by``) for hot ones."""
    part = F.when(
        F.col("parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("parts")).cast("int")
    ).otherwise(F.lit(0))
    return df.join(hot, key, "left").withColumn(out, part).drop("parts")


def spread_copies(rows: DataFrame, hot: DataFrame, key: str, limit: int, out: str) -> DataFrame:
    """Like ``spread``, for rows that may be copies of each other.

    Equal rows are counted first (column ``copies``) and a large count is cut
    into pieces, so many copies of one row do not meet in one part. Parts depend
    on content only: a retried task places its rows as before.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("total"))
    pieces = F.sequence(F.lit(0), F.ceil(F.col("total") / limit).cast("int") - 1)
    cut = counted.withColumn("piece", F.explode(pieces)).withColumn(
        "copies", F.least(F.lit(limit), F.col("total") - F.col("piece") * limit).cast("int")
    )
    others = [c for c in columns if c != key]
    keyed = cut.withColumn("spread_by", F.xxhash64(*others, "piece"))
    return spread(keyed, hot, key, "spread_by", out).select(*columns, "copies", out)


def replicate(df: DataFrame, hot: DataFrame, key: str, out: str) -> DataFrame:
    """The matching side of ``spread``: one copy of a hot row per part."""
    parts = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    return (
        df.join(hot, key, "left").withColumn(out, F.explode(parts)).drop("parts")
    )


def join_vectors(
    rows: DataFrame,
    vectors: DataFrame,
    key: str,
    by: str,
    how: str = "inner",
    vector_rows: int | None = None,
    row_bytes: int = 64,
    broadcast_limit: int = 64 << 20,
    hot_limit: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join ``rows`` with one-row-per-key ``vectors``, safe for hot keys.

    The vector side is broadcast only if its counted size is under the limit;
    otherwise hot keys of ``rows`` are spread over ``hash(by)``. Keys are counted in ``counted``, a table
    of at least the same keys, or else ``rows`` are written and read twice.
    """
    if vector_rows is None:
        vector_rows = vectors.count()
    if vector_rows * row_bytes <= broadcast_limit:
        return rows.join(F.broadcast(vectors), key, how)
    if counted is None:
        rows = counted = workdir.write_table(rows, workdir.new_run_dir(rows.sparkSession, "spread-rows"))
    hot, _ = find_hot(counted, key, hot_limit)
    if hot is None:
        return rows.join(vectors, key, how)
    left = spread(rows, hot, key, by, "_part")
    right = replicate(vectors, hot, key, "_part")
    return left.join(right, [key, "_part"], how).drop("_part")

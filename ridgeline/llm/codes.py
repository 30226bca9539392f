"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random and coded by the signs of its components; the stored
correction factor is the inner product of the vector with its code. Dividing a code's
product with another rotated vector by it gives an unbiased estimate of the cosine, with a
confidence bound that follows from the factor. Only pairs whose estimate plus bound reaches
the threshold, from both sides, are computed again in double precision, and only those
results make links.

Which vectors are compared: the signs of several rotations form bands; vectors that agree
in all bits of a band share a bucket. Bits per band follow from the number of vectors, and
the number of bands from the wanted chance to miss a pair right at the threshold
(``MISS``). A bucket is split into cells of bounded size, each pair of blocks meeting once,
so hot buckets keep all their pairs. A pair counts in the first band it shares. Equal
vectors are one class with a count before anything else.

Cells add up links in place: they return one row per vector, not per pair.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are kept; vectors of different lengths do not link; rows that repeat
a vec_id are vectors of one id; a null vec_id has a null component; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import matrix, runs
from ridgeline.llm.components import components
from ridgeline.llm.vectors import fixed, parsed, rotation
from ridgeline.workdir import new_run_dir, write_table

THRESHOLD = 0.9
MISS = 0.002
#: Vectors of unrelated directions that share a bucket on average.
BUCKET = 256
CELL = 512
#: Standard deviations of the estimate that are allowed for.
BOUND = 4.0
_PAIRS = 1 << 15


def bands_for(count: int, threshold: float) -> tuple[int, int]:
    """(bits per band, bands) for so many vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(max(4, math.ceil(math.log2(max(count, 1) / BUCKET))), 48)
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree**bits)))


def _signs(unit: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs under as many rotations as the bands need, and the correction factors of the first."""
    dim = unit.shape[1]
    rotations = math.ceil(bits * bands / dim)
    turned = np.hstack([unit @ rotation(dim, seed) for seed in range(rotations)])
    factors = np.abs(turned[:, :dim]).sum(axis=1) / math.sqrt(dim)
    return turned >= 0, factors


def _band_keys(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    used = signs[:, : bits * bands].reshape(len(signs), bands, bits)
    return used @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def coded(classes: DataFrame, bits: int, bands: int) -> DataFrame:
    """Classes with packed signs, correction factor and the key of each band."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            for dim in sorted(set(dims.tolist())):
                part = batch.filter(pa.array(dims == dim))
                values = matrix(part.column("vec"), "<f8")
                unit = values / np.linalg.norm(values, axis=1, keepdims=True)
                signs, factors = _signs(unit, bits, bands)
                keys = _band_keys(signs, bits, bands)
                ends = np.arange(0, keys.size + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in ("id", "dim", "copies", "vec")],
                        pa.array([s.tobytes() for s in np.packbits(signs, axis=1)], type=pa.binary()),
                        pa.array(factors),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                    ],
                    names=["id", "dim", "copies", "vec", "signs", "factor", "keys"],
                )

    return classes.select("id", "dim", "copies", "vec").mapInArrow(
        task,
        "id long, dim int, copies long, vec binary, signs binary, factor double, keys array<long>",
    )


def _linked(
    values: np.ndarray, signs: np.ndarray, factors: np.ndarray, allowed: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Allowed pairs of one cell whose exact cosine reaches the threshold."""
    dim = values.shape[1]
    norms = np.sqrt((values * values).sum(axis=1))
    turned = (values / norms[:, None]) @ rotation(dim, 0)
    code = np.where(signs[:, :dim], 1.0, -1.0) / math.sqrt(dim)
    estimate = (code @ turned.T) / factors[:, None]
    spread = np.sqrt(np.maximum(1 - factors**2, 0) / (factors**2 * max(dim - 1, 1)))
    possible = estimate + BOUND * spread[:, None] >= threshold
    first, second = np.nonzero(possible & possible.T & allowed)
    close = np.zeros(len(first), dtype=bool)
    for at in range(0, len(first), _PAIRS):
        i, j = first[at : at + _PAIRS], second[at : at + _PAIRS]
        close[at : at + _PAIRS] = (values[i] * values[j]).sum(axis=1) / (norms[i] * norms[j]) >= threshold
    return first[close], second[close]


def _cell_rows(cell: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Links and local root of each vector of a cell."""
    band = cell["band"][0].as_py()
    values = matrix(cell["vec"], "<f8")
    signs = np.unpackbits(matrix(cell["signs"], np.uint8), axis=1).astype(bool)
    side = cell["side"].to_numpy()
    allowed = np.triu(np.ones((len(values), len(values)), dtype=bool), 1)
    if cell["low"][0].as_py() != cell["high"][0].as_py():
        allowed &= side[:, None] != side[None, :]
    first, second = _linked(values, signs, cell["factor"].to_numpy(), allowed, threshold)
    if len(first) == 0:
        return None
    keys = np.array(cell["keys"].to_pylist())
    new = np.concatenate(
        [
            (keys[first[at : at + _PAIRS]] == keys[second[at : at + _PAIRS]]).argmax(axis=1) == band
            for at in range(0, len(first), _PAIRS)
        ]
    )
    first, second = first[new], second[new]
    if len(first) == 0:
        return None
    ids, copies = cell["id"].to_numpy(), cell["copies"].to_numpy()
    links = np.bincount(first, copies[second], len(ids)) + np.bincount(second, copies[first], len(ids))
    root = ids.copy()
    while True:
        lower = root.copy()
        np.minimum.at(lower, first, root[second])
        np.minimum.at(lower, second, root[first])
        if (lower == root).all():
            break
        root = lower
    shown = links > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[shown]), pa.array(links[shown].astype(np.int64)), pa.array(root[shown])],
        names=["id", "links", "root"],
    )


def links_of(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, links, root) rows of all cells; links of one id add up, (id, root) are edges."""
    bits, bands = bands_for(classes.count(), threshold)
    codes = write_table(coded(classes, bits, bands), new_run_dir(classes.sparkSession, "vector-codes"))
    posts = codes.select("id", "dim", F.posexplode("keys").alias("band", "key"))
    sizes = (
        posts.groupBy("dim", "band", "key")
        .agg(F.count("*").alias("c"))
        .where("c > 1")
        .withColumn("blocks", F.ceil(F.col("c") / CELL).cast("int"))
        .drop("c")
    )
    cells = (
        codes.select("*", F.posexplode("keys").alias("band", "key"))
        .join(sizes, ["dim", "band", "key"])
        .withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("side", "other"))
        .withColumn("high", F.greatest("side", "other"))
        .drop("other", "blocks")
    )
    place = ["dim", "band", "key", "low", "high"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, place):
            if cell.num_rows > 1 and (rows := _cell_rows(cell, threshold)) is not None:
                yield rows

    return cells.repartition(*place).sortWithinPartitions(*place).mapInArrow(task, "id long, links long, root long")


def near_duplicates(
    table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (smallest linked id), kept."""
    spark = table.sparkSession
    rows = parsed(table, id_col, vector_col).withColumn("key", fixed(F.col("vec")))
    rows = write_table(rows, new_run_dir(spark, "vectors"))
    heads = rows.where("vec is not null and id is not null").groupBy("key").agg(
        F.min("id").alias("head"), F.count("*").alias("copies")
    )
    heads = write_table(heads, new_run_dir(spark, "vector-classes"))
    firsts = rows.where("vec is not null").dropDuplicates(["id", "key"]).withColumnRenamed("key", "own_key")
    classes = firsts.join(heads, (F.col("id") == F.col("head")) & (F.col("own_key") == F.col("key"))).select(
        F.col("head").alias("id"), "dim", "copies", "vec"
    )
    found = write_table(links_of(classes, threshold), new_run_dir(spark, "vector-links"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    repeated = rows.where("vec is not null and id is not null").groupBy("id").agg(
        F.min("key").alias("low"), F.max("key").alias("high")
    )
    two_vectors = (
        rows.join(repeated.where("low <> high"), "id", "left_semi")
        .join(heads, "key")
        .select(F.col("id").alias("a"), F.col("head").alias("b"))
    )
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(two_vectors))
    placed = (
        rows.drop("vec")
        .withColumn("key", F.when(F.col("id").isNotNull(), F.col("key")))
        .join(heads, "key", "left")
        .join(counts.withColumnRenamed("id", "head"), "head", "left")
        .join(labels.withColumnRenamed("node", "head"), "head", "left")
    )
    root = F.when(F.col("id").isNotNull(), F.coalesce("component", "head", "id"))
    return placed.select(
        F.col("id").alias("vec_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        root.alias("component_id"),
        F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"),
    )

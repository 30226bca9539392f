"""Nearest neighbours by largest inner product, with an adaptive dimension scan.

Vectors are made equally long by one more component, so that the largest inner product is
the smallest distance, and rotated at random, so that the distance over the first few
columns foretells the whole. They lie in lists around centroids. Within each probed list a
query reads the candidates in blocks of columns; after each block a hypothesis test
abandons every candidate whose partial distance is too long for it still to come as near as
the query's k-th neighbour in a sample. What is left is computed exactly, in double
precision and column order, on the original vectors.

Centroids, the number of lists to probe and the starting radius of a query come from a
sample of at most ``SAMPLE`` ids, the first by a hash, with one vector each; every vector is
in the index. The number of probes is what covers ``COVER`` of the true neighbours inside the
sample, so the recall holds for clustered and unclustered data alike. The sample's own
neighbours are candidates too, so every query gets k rows if there are so many vectors.
Lists are split into cells of bounded size; queries stream past a cell.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do those of another length than most have; a query's own id is no
candidate; rows that repeat a vec_id count once, with their best score; null ids take no
part; equal scores order by id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.arrow import matrix
from ridgeline.llm.vectors import parsed, rotation
from ridgeline.workdir import new_run_dir, write_table

TOP = 20
SAMPLE = 8192
MOST_LISTS = 256
COVER = 0.99
CELL = 4096
COLUMNS = 16
#: Significance of the test: standard deviations by which a partial distance may mislead.
MARGIN = 2.5
_QUERIES = 256
#: Share of candidates left below which single pairs are followed.
_SPARSE = 0.15


def exact_scores(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of corresponding rows, added in column order."""
    total = np.zeros(len(queries))
    for column in range(queries.shape[1]):
        total += queries[:, column] * others[:, column]
    return total


class Geometry:
    """What the sample teaches: length bound, rotation, centroids and the number of probes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, top: int):
        self.ids, self.vectors, self.top = ids, vectors, top
        self.square = longest
        self.turn = rotation(vectors.shape[1] + 1, 1)
        points = self.candidates(vectors)
        count = min(MOST_LISTS, max(1, math.isqrt(len(points))))
        self.centroids = _centroids(points, count)
        self.probes = self._probes(points)

    def candidates(self, vectors: np.ndarray) -> np.ndarray:
        """Rotated vectors of equal length."""
        rest = np.sqrt(np.maximum(self.square - (vectors * vectors).sum(axis=1), 0))
        return np.hstack([vectors, rest[:, None]]) @ self.turn

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors, np.zeros((len(vectors), 1))]) @ self.turn

    def ranked_lists(self, turned: np.ndarray) -> np.ndarray:
        """Lists from near to far."""
        return np.argsort(_distances(turned, self.centroids), axis=1, kind="stable")

    def nearest(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and exact scores of the sample's k nearest of each query, its own id aside."""
        rough = vectors @ self.vectors.T
        rough[ids[:, None] == self.ids[None, :]] = -np.inf
        for row, vector in zip(rough, vectors):
            k = min(self.top, len(row))
            close = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-9)
            close = close[np.isfinite(row[close])]
            scores = exact_scores(np.broadcast_to(vector, (len(close), len(vector))), self.vectors[close])
            best = np.lexsort((self.ids[close], -scores))[: self.top]
            yield self.ids[close][best], scores[best]

    def _probes(self, points: np.ndarray) -> int:
        chosen = np.arange(0, len(self.ids), max(1, len(self.ids) // 256))
        home = _distances(points, self.centroids).argmin(axis=1)
        place = dict(zip(self.ids.tolist(), home.tolist()))
        order = self.ranked_lists(self.queries(self.vectors[chosen]))
        rank = np.argsort(order, axis=1)
        needed = []
        for i, (ids, _) in enumerate(self.nearest(self.ids[chosen], self.vectors[chosen])):
            needed += [int(rank[i, place[x]]) + 1 for x in ids.tolist()]
        return int(np.quantile(needed, COVER, method="higher")) if needed else len(self.centroids)


def _distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (one * one).sum(axis=1)[:, None] + (other * other).sum(axis=1)[None, :] - 2 * one @ other.T


def _centroids(points: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's means from evenly spread starting points; an empty list keeps its centre."""
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        home = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        sizes = np.bincount(home, minlength=count)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def scan(queries: np.ndarray, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, candidate row) that survive every test; ``radius`` is a squared distance."""
    width = points.shape[1]
    partial = np.zeros((len(queries), len(points)))
    alive = np.ones(partial.shape, dtype=bool)
    pairs = None
    for start in range(0, width, COLUMNS):
        q, p = queries[:, start : start + COLUMNS], points[:, start : start + COLUMNS]
        seen = min(start + COLUMNS, width)
        slack = (1 + MARGIN / math.sqrt(seen)) ** 2 * seen / width if seen < width else 1 + 1e-9
        if pairs is None:
            partial += _distances(q, p)
            alive &= partial <= (radius * slack + 1e-9)[:, None]
            if alive.mean() < _SPARSE:
                pairs = np.nonzero(alive)
                lengths = partial[pairs]
        else:
            i, j = pairs
            lengths = lengths + ((q[i] - p[j]) ** 2).sum(axis=1)
            kept = lengths <= radius[i] * slack + 1e-9
            pairs, lengths = (i[kept], j[kept]), lengths[kept]
    return np.nonzero(alive) if pairs is None else pairs


def _cell_hits(part: dict, ids: np.ndarray, vectors: np.ndarray, geometry: Geometry) -> Iterator[pa.RecordBatch]:
    """The best candidates of one cell for a slice of queries."""
    points = geometry.candidates(vectors)
    for at in range(0, len(part["id"]), _QUERIES):
        own, wanted, least = (part[c][at : at + _QUERIES] for c in ("id", "vec", "least"))
        turned = geometry.queries(wanted)
        radius = (turned * turned).sum(axis=1) + geometry.square - 2 * least
        first, second = scan(turned, points, radius)
        scores = exact_scores(wanted[first], vectors[second])
        kept = (scores >= least[first]) & (own[first] != ids[second])
        first, second, scores = first[kept], second[kept], scores[kept]
        order = np.lexsort((-scores, ids[second], first))
        first, second, scores = first[order], second[order], scores[order]
        once = np.ones(len(first), dtype=bool)
        once[1:] = (first[1:] != first[:-1]) | (ids[second[1:]] != ids[second[:-1]])
        first, second, scores = first[once], second[once], scores[once]
        order = np.lexsort((ids[second], -scores, first))
        first, second, scores = first[order], second[order], scores[order]
        place = np.arange(len(first)) - np.searchsorted(first, first)
        best = place < geometry.top
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[first[best]]), pa.array(ids[second[best]]), pa.array(scores[best])],
            names=["query_id", "vec_id", "score"],
        )


def _learn(rows: DataFrame, top: int) -> Geometry | None:
    common = rows.groupBy("dim").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "dim").first()
    if common is None:
        return None
    rows = rows.where(F.col("dim") == common["dim"])
    ids = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("v").alias("v"))
    sample = sample.orderBy(F.xxhash64("id"), "id").toArrow()
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    longest = rows.agg(F.max(square)).first()[0]
    return Geometry(sample["id"].to_numpy(), np.array(sample["v"].to_pylist()), longest * (1 + 1e-12), top)


def nearest(
    table: DataFrame, is_query: str, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors found for the rows where ``is_query`` (on ``id``)."""
    spark = table.sparkSession
    rows = parsed(table, id_col, vector_col).where("vec is not null and id is not null")
    originals = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast("array<double>").alias("v"))
    rows = write_table(rows.dropDuplicates(["id", "vec"]), new_run_dir(spark, "ann-vectors"))
    usable = (
        originals.withColumn("dim", F.size("v"))
        .where("id is not null and dim > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
        .where("exists(v, x -> x <> 0)")
    )
    geometry = _learn(usable, top)
    if geometry is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.col("dim") == geometry.vectors.shape[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                points = geometry.candidates(matrix(part.column("vec"), "<f8"))
                home = _distances(points, geometry.centroids).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("vec"), pa.array(home)], names=["id", "vec", "list"]
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, vectors = part.column("id").to_numpy(), matrix(part.column("vec"), "<f8")
                lists = geometry.ranked_lists(geometry.queries(vectors))[:, : geometry.probes]
                found = list(geometry.nearest(ids, vectors))
                least = [s[-1] if len(s) >= top else -np.inf for _, s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("vec"),
                        pa.array(np.array(least)),
                        pa.array(list(lists.astype(np.int32)), type=pa.list_(pa.int32())),
                        pa.array([x for x, _ in found], type=pa.list_(pa.int64())),
                        pa.array([s for _, s in found], type=pa.list_(pa.float64())),
                    ],
                    names=["id", "vec", "least", "lists", "near", "scores"],
                )

    placed = write_table(rows.select("id", "vec").mapInArrow(place, "id long, vec binary, list int"), new_run_dir(spark, "ann-lists"))
    asked = write_table(
        rows.where(is_query).select("id", "vec").mapInArrow(
            ask, "id long, vec binary, least double, lists array<int>, near array<long>, scores array<double>"
        ),
        new_run_dir(spark, "ann-queries"),
    )
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    cells = placed.join(F.broadcast(sizes), "list").select(  # at most MOST_LISTS rows
        "list",
        F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell"),
        F.lit(0).alias("kind"),
        "id",
        "vec",
        F.lit(0.0).alias("least"),
    )
    probes = asked.select("id", "vec", "least", F.explode("lists").alias("list")).join(F.broadcast(sizes), "list")
    probes = probes.select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"),
        F.lit(1).alias("kind"),
        "id",
        "vec",
        "least",
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_at, ids, vectors = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "cell", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                here = tuple(keys[start, :2].tolist())
                if here != held_at:
                    held_at, ids, vectors = here, [], []
                if keys[start, 2] == 0:
                    ids.append(part.column("id").to_numpy())
                    vectors.append(matrix(part.column("vec"), "<f8"))
                elif ids:
                    asked_here = {
                        "id": part.column("id").to_numpy(),
                        "vec": matrix(part.column("vec"), "<f8"),
                        "least": part.column("least").to_numpy(),
                    }
                    yield from _cell_hits(asked_here, np.concatenate(ids), np.concatenate(vectors), geometry)

    both = cells.unionByName(probes).repartition("list", "cell").sortWithinPartitions("list", "cell", "kind")
    hits = both.mapInArrow(work, "query_id long, vec_id long, score double")
    own = asked.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "scores")).alias("x"))
    own = own.select("query_id", F.col("x.near").alias("vec_id"), F.col("x.scores").alias("score"))
    best = hits.union(own).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )

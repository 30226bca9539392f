"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch keeps the k
smallest. Copies of one word sequence are one class from the start. Inverted lists of the
retained values bring classes together: a class enters the lists of its rarest values only,
as many as two sketches that overlap enough cannot both avoid. The estimate from the sketch
of the union drops pairs that are too far away, and the exact Jaccard similarity of the
full sets decides about the rest.

Links are found in turns. First each class is compared with the first member of the list
it shares most often, which joins most of a large group with one pair per member. Then only
lists whose members are still in different components are looked at, in cells of bounded
size and with longer sketches. Sets that their sketch holds whole are decided on the spot,
and a cell returns a spanning forest of the links it finds. Of pairs that only an estimate
speaks for, each class returns the nearest; lists that have such pairs are looked at once
more, and all that are still in different components are returned. A pair is returned by the
first list it shares. Pairs inside a component add nothing and are never formed, so a group
of thousands does not make millions of pairs, and no list is capped or skipped; lists of the
same members are looked at once.

Sketch overlaps are random; the estimate is allowed to fall ``MARGIN`` standard deviations
short, so about three links in a million are missed. Sets of at most k shingles are compared
exactly throughout.

Defined cases: null, empty and blank texts have the empty set and no links; a text of fewer
words than a shingle is one shingle; rows that repeat a doc_id are one document; a row with
a null doc_id has no links, a null component and is kept; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ridgeline.llm.arrow import runs, text_bytes
from ridgeline.llm.components import components
from ridgeline.llm.words import sequence_hash, shingle_hashes, word_hashes
from ridgeline.workdir import delete_dir, new_run_dir, write_table

K = 64
#: Values kept of the sets that share lists.
PROFILE = 256
PERCENT = 80
MARGIN = 4.5
#: Rows of one side of a cell in which the members of a list are compared, about.
CELL = 1024


def least_overlap(k: int, percent: int) -> int:
    """Shared values, of the k smallest of a union, that a linked pair has almost surely."""
    share = percent / 100
    return max(1, math.floor(k * share - MARGIN * math.sqrt(k * share * (1 - share))))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct 63-bit shingle hashes, ascending."""
    return np.unique(shingle_hashes(words, size) >> np.uint64(1)).astype(np.int64)


def signatures(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, print_a, print_b, sketch) per row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, sketches = [], [], [], []
            for words in word_hashes(text_bytes(batch.column(1))):
                found = shingle_set(words, shingle)
                sizes.append(len(found))
                first.append(np.uint64(sequence_hash(words, 1)).astype(np.int64))
                second.append(np.uint64(sequence_hash(words, 2)).astype(np.int64))
                sketches.append(found[:k].copy())  # a view would hold the whole set
            ends = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *sketches])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(first, type=pa.int64()),
                    pa.array(second, type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "print_a", "print_b", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        task, "doc_id long, n_shingles long, print_a long, print_b long, sketch array<long>"
    )


def _rare_lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, id): each class in the lists of its rarest shared values."""
    held = F.least(F.col("n"), F.lit(k))
    needed = F.least(F.ceil(held * percent / 100), F.lit(least_overlap(k, percent)))
    key = ["id", "print_a", "print_b"]  # texts of one id are ranked each for itself
    posts = classes.select(
        *key, held.alias("held"), (held - needed + 1).alias("prefix"), F.explode("sketch").alias("value")
    )
    shared = posts.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    within = Window.partitionBy(*key)
    ranked = (
        posts.join(shared, "value")
        .withColumn("rank", F.row_number().over(within.orderBy("df", "value")))
        .withColumn("n_shared", F.count("*").over(within))
    )
    return (
        ranked.where(F.col("rank") <= F.col("prefix") - (F.col("held") - F.col("n_shared")))
        .select("value", "id")
        .distinct()
    )


def _estimate_passes(k: int, percent: int) -> Column:
    """Union-sketch test on columns (na, sketch_a, nb, sketch_b)."""
    union = F.array_sort(F.array_union("sketch_a", "sketch_b"))
    both = F.array_intersect("sketch_a", "sketch_b")
    partial = (F.col("na") > k) | (F.col("nb") > k)
    enough_partial = F.size(F.array_intersect(F.slice(union, 1, k), both)) >= least_overlap(k, percent)
    enough_whole = F.size(both) * 100 >= F.size(union) * percent
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sizes & F.when(partial, enough_partial).otherwise(enough_whole)


def _first_pairs(lists: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Each class with the first member of a list that it shares lists with most often."""
    heads = lists.groupBy("value").agg(F.min("id").alias("head"))
    overlaps = lists.join(heads, "value").where("id <> head").groupBy("id", "head").agg(F.count("*").alias("c"))
    best = overlaps.groupBy("id").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("best"))
    pairs = best.select(F.col("id").alias("a"), (-F.col("best.h")).alias("b"))
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sketch_a"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b"))
    return pairs.join(left, "a").join(right, "b").where(_estimate_passes(k, percent)).select("a", "b").distinct()


def profiles(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, n, sketch) with the PROFILE smallest values of each text's set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept = [], []
            for words in word_hashes(text_bytes(batch.column(1))):
                found = shingle_set(words, shingle)
                sizes.append(len(found))
                kept.append(found[:PROFILE].copy())
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *kept])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["id", "n", "sketch"],
            )

    return texts.select("id", "text").mapInArrow(task, "id long, n long, sketch array<long>")


def _overlaps(probes: list[np.ndarray], homes: list[np.ndarray]) -> np.ndarray:
    """Number of values that each probe shares with each home."""
    both = [*probes, *homes]
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, inverse, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    kept = counts[inverse] > 1
    owner, inverse = owner[kept], column[inverse[kept]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    overlap = np.zeros((len(probes), len(homes)), dtype=np.float32)
    columns = int((counts > 1).sum())
    width = min(4096, columns or 1)
    for start in range(0, columns, width):
        low, high = np.searchsorted(inverse, [start, start + width])
        block = np.zeros((len(both), width), dtype=np.float32)
        block[owner[low:high], inverse[low:high] - start] = 1
        overlap += block[: len(probes)] @ block[len(probes) :].T
    return overlap


class _Rows:
    """One side of a cell."""

    def __init__(self, cell: pa.Table):
        self.ids = cell["id"].to_numpy()
        self.labels = cell["component"].to_numpy()
        self.sizes = cell["n"].to_numpy()
        self.minor = np.array(cell["minor"].to_pylist(), dtype=bool)
        self.sketches = [np.array(x, dtype=np.int64) for x in cell["sketch"].to_pylist()]
        self.shared = cell["shared"].to_pylist()
        self.whole = self.sizes <= PROFILE
        last = np.iinfo(np.int64).max
        self.tops = np.array([last if w else x[-1] for w, x in zip(self.whole, self.sketches)], dtype=np.int64)

    def below(self, tops: np.ndarray) -> np.ndarray:
        """Number of values of each sketch up to each of ``tops``."""
        found = [np.searchsorted(x, tops, side="right") for x in self.sketches]
        return np.array(found, dtype=np.float32).reshape(len(self.sketches), len(tops))


def _close_pairs(probes: _Rows, homes: _Rows, value: int, percent: int) -> tuple[np.ndarray, ...]:
    """Pairs (probe row, home row) of different components that may be linked, whether that is
    certain, and their estimates; only pairs that share no earlier list, each from one side."""
    overlap = _overlaps(probes.sketches, homes.sketches)
    union = probes.below(homes.tops) + homes.below(probes.tops).T - overlap
    whole = probes.whole[:, None] & homes.whole[None, :]
    share = percent / 100
    slack = MARGIN * np.sqrt(share * (1 - share) / np.maximum(union, 1))
    passes = np.where(whole, overlap * 100 >= union * percent, overlap >= (share - slack) * union) & (overlap > 0)
    least = np.minimum(probes.sizes[:, None], homes.sizes[None, :])
    passes &= least * 100 >= np.maximum(probes.sizes[:, None], homes.sizes[None, :]) * percent
    passes &= probes.labels[:, None] != homes.labels[None, :]
    passes &= ~homes.minor[None, :] | (probes.ids[:, None] < homes.ids[None, :])
    first, second = np.nonzero(passes)
    here = [
        min(set(probes.shared[i]).intersection(homes.shared[j])) == value
        for i, j in zip(first.tolist(), second.tolist())
    ]
    first, second = first[np.array(here, dtype=bool)], second[np.array(here, dtype=bool)]
    return first, second, whole[first, second], overlap[first, second] / union[first, second]


def _forest(first: list[int], second: list[int]) -> np.ndarray:
    """Positions of pairs of labels that connect them as all pairs do."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root.setdefault(root[x], root[x])
        return x

    kept = []
    for at, (i, j) in enumerate(zip(first, second)):
        i, j = find(i), find(j)
        if i != j:
            root[i] = j
            kept.append(at)
    return np.array(kept, dtype=np.int64)


def _nearest(first: np.ndarray, second: np.ndarray, estimates: np.ndarray) -> np.ndarray:
    """Positions of the pairs of ids that are the best of one of the two."""
    one = np.concatenate([first, second])
    order = np.lexsort((-np.concatenate([estimates, estimates]), one))
    start = np.ones(len(one), dtype=bool)
    start[1:] = one[order][1:] != one[order][:-1]
    return np.unique(order[start] % len(first))


def _cell_pairs(cell: pa.Table, percent: int, nearest: bool) -> pa.RecordBatch | None:
    probe = cell["probe"]
    probes, homes = _Rows(cell.filter(probe)), _Rows(cell.filter(pc.invert(probe)))
    if len(probes.ids) == 0 or len(homes.ids) == 0:
        return None
    value = cell["value"][0].as_py()
    first, second, sure, estimates = _close_pairs(probes, homes, value, percent)
    a, b = probes.ids[first], homes.ids[second]
    certain, open_ = np.flatnonzero(sure), np.flatnonzero(~sure)
    labels = probes.labels[first[certain]].tolist(), homes.labels[second[certain]].tolist()
    certain = certain[_forest(*labels)]
    if nearest and len(open_):
        open_ = open_[_nearest(a[open_], b[open_], estimates[open_])]
    kept = np.concatenate([certain, open_])
    columns = [np.minimum(a, b)[kept], np.maximum(a, b)[kept], sure[kept], np.full(len(kept), value)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "sure", "value"])


def _mixed_pairs(lists: DataFrame, labels: DataFrame, profiled: DataFrame, percent: int, nearest: bool) -> DataFrame | None:
    """(a, b, sure, value) from lists that still hold several components; None if there is no such list."""
    spark = lists.sparkSession
    marked = lists.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    # Members of a list's largest component need not meet each other.
    groups = marked.groupBy("value", "component").agg(
        F.count("*").alias("c"),
        F.bit_xor(F.xxhash64("id")).alias("print_a"),
        F.bit_xor(F.xxhash64("id", F.lit(1))).alias("print_b"),
    )
    mixed = (
        groups.groupBy("value")
        .agg(
            F.count("*").alias("components"),
            F.sum("c").alias("c"),
            F.max(F.struct("c", "component")).alias("top"),
            F.bit_xor("print_a").alias("print_a"),
            F.bit_xor("print_b").alias("print_b"),
        )
        .where("components > 1")
        .groupBy("c", "print_a", "print_b", "top")
        .agg(F.min("value").alias("value"))
        .select(
            "value",
            F.col("top.component").alias("major"),
            F.ceil(F.col("c") / CELL).cast("int").alias("home_blocks"),
            F.ceil((F.col("c") - F.col("top.c")) / CELL).cast("int").alias("probe_blocks"),
        )
    )
    rows = write_table(marked.join(mixed, "value"), new_run_dir(spark, "mixed-lists"))
    if rows.isEmpty():
        return None
    of_id = rows.groupBy("id").agg(F.collect_set("value").alias("shared"))  # as many as lists a class enters
    described = profiled.join(of_id, "id")
    rows = rows.withColumn("minor", F.col("component") != F.col("major"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    common = ["value", "id", "component", "minor"]
    homes = rows.select(*common, F.lit(False).alias("probe"), up_to("probe_blocks").alias("low"), place("home_blocks", 1).alias("high"))
    probes = rows.where("minor").select(
        *common, F.lit(True).alias("probe"), place("probe_blocks", 2).alias("low"), up_to("home_blocks").alias("high")
    )
    cells = (
        homes.unionByName(probes)
        .join(described, "id")
        .select("value", "low", "high", "id", "component", "minor", "probe", "n", "sketch", "shared")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["value", "low", "high"]):
            if (found := _cell_pairs(cell, percent, nearest)) is not None:
                yield found

    found = cells.repartition("value", "low", "high").sortWithinPartitions("value", "low", "high")
    return found.mapInArrow(task, "a long, b long, sure boolean, value long")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            ones = word_hashes(text_bytes(batch.column(2)))
            others = word_hashes(text_bytes(batch.column(3)))
            for one, other in zip(ones, others):
                s, t = shingle_set(one, shingle), shingle_set(other, shingle)
                common = len(np.intersect1d(s, t, assume_unique=True))
                kept.append(common > 0 and common * 100 >= (len(s) + len(t) - common) * percent)
            yield batch.select(["a", "b"]).filter(pa.array(kept, type=pa.bool_()))

    return both.mapInArrow(task, "a long, b long")


def _as_edges(labels: DataFrame) -> DataFrame:
    """Components found so far, as a star for each."""
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = PERCENT,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked id), kept."""
    spark = docs.sparkSession

    folders: dict[str, list[str]] = {}

    def stored(df: DataFrame, label: str) -> DataFrame:
        folders.setdefault(label, []).append(new_run_dir(spark, label))
        return write_table(df, folders[label][-1])

    def dropped(*labels: str) -> None:
        """Delete tables that nothing reads any more."""
        for label in labels:
            for path in folders.pop(label, []):
                delete_dir(spark, path)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sketched = stored(signatures(rows, shingle, k), "sketches")
    signed = stored(sketched.drop("sketch"), "signatures")  # all that the result needs
    linkable = sketched.where("n_shingles > 0 and doc_id is not null")
    heads = linkable.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("id"))
    heads = stored(heads, "classes")
    classes = (
        linkable.withColumnRenamed("doc_id", "id")
        .join(heads, ["id", "print_a", "print_b"], "left_semi")
        .dropDuplicates(["id", "print_a", "print_b"])
        .select("id", "print_a", "print_b", F.col("n_shingles").alias("n"), "sketch")
    )
    classes = stored(classes, "class-sketches")
    dropped("sketches")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    lists = stored(_rare_lists(classes, k, percent), "rare-lists")
    members = lists.select("id").distinct()
    texts = rows.withColumnRenamed("doc_id", "id").join(members, "id", "left_semi")
    texts = stored(texts.dropDuplicates(["id", "text"]), "candidate-texts")
    edges = stored(_verified(_first_pairs(lists, classes, k, percent), texts, shingle, percent), "links")
    labels = components(edges)
    dropped("links")
    profiled = stored(profiles(texts, shingle), "profiles")
    for nearest in (True, False):
        pairs = _mixed_pairs(lists, labels, profiled, percent, nearest)
        if pairs is None:
            break
        pairs = stored(pairs, "near-pairs")
        unsure = pairs.where("not sure")
        found = pairs.where("sure").select("a", "b")
        done = unsure.isEmpty()
        if not done:
            found = found.union(stored(_verified(unsure.select("a", "b").distinct(), texts, shingle, percent), "links"))
        labels = components(_as_edges(labels).union(found))
        if done:
            break
        lists = lists.join(unsure.select("value").distinct(), "value", "left_semi")
    dropped("rare-lists", "candidate-texts", "profiles", "near-pairs", "links")
    several = linkable.groupBy("doc_id").agg(F.min("print_a").alias("low"), F.max("print_a").alias("high"))
    several = stored(several.where("low <> high"), "repeated-ids")
    if not several.isEmpty():
        two_texts = (
            linkable.join(several, "doc_id", "left_semi")
            .join(heads, ["print_a", "print_b"])
            .select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        )
        labels = components(_as_edges(labels).union(two_texts))
    placed = (
        signed.join(heads, ["print_a", "print_b"], "left")
        .join(labels.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")))
    )
    return placed.select(
        "doc_id",
        "n_shingles",
        F.col("root").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"),
    )

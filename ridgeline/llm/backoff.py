"""Stupid-backoff language-model scores of all documents.

The model is three n-gram count tables over the whole corpus: words, pairs and triples, the
latter two without the n-grams seen fewer than ``min_count`` times. A word scores the count
of its triple over that of the pair before; if the triple is not in the table, 0.4 times the
count of its pair over that of the word before; if that is missing too, 0.4 squared times
its own share of all words. The first words of a text start at the order they have. A
document's score is the sum of the logarithms.

The counts are a table partitioned by hash that is joined twice over. Documents are dealt
into batches of bounded size; a batch sends each of its distinct n-grams once, with its own
count, to the partition of the n-gram's hash. There the counts of all batches are added,
which is the count table, and every batch gets the totals of the n-grams it sent, in their
order. So a frequent n-gram costs one entry per batch and not one per occurrence, and no
table of n-grams is broadcast or held whole. N-grams are known by 64-bit hashes. Entries
travel as sorted, packed arrays.

Rows of one id and text that together would fill much of a batch are counted first, enter
their batch as one row with a number of copies, and are written out again after scoring.

Defined cases: words are those of ``words`` (A-Z in lower case); null, empty and blank texts
have no words and score 0; repeated rows are counted and scored each for itself; null ids
are kept; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import runs
from ridgeline.llm.words import mix, word_hashes
from ridgeline.operators import skew
from ridgeline.workdir import delete_dir, new_run_dir, write_table

BACKOFF = 0.4
MIN_COUNT = 2
#: Bytes of text in a batch, and n-grams in a partition of the count table, about.
BATCH_BYTES = 8 << 20
TABLE_ENTRIES = 1 << 20
#: Bytes of equal rows that are counted before they enter a batch, and what a row counts besides its text.
HOT_BYTES = 1 << 20
ROW_BYTES = 32
#: Copies written out at a time.
PIECE = 4096
_HELD_BYTES = 32 << 20

_ALL_WORDS = np.uint64(0x0123456789ABCDEF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pack(values: np.ndarray) -> bytes:
    """Bytes of the values, plane by plane, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(dtype).ravel()


class _Batch:
    """Words of a batch's documents, end to end, and the keys of their n-grams."""

    def __init__(self, texts: list[bytes | None], copies: np.ndarray):
        found = list(word_hashes(texts))
        self.lengths = np.array([len(w) for w in found], dtype=np.int64)
        words = np.concatenate([np.zeros(0, dtype=np.uint64), *found])
        starts = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        place = np.arange(len(words)) - starts
        self.second, self.third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        self.first = place == 0
        one = mix(words + np.uint64(1))
        two = mix(mix(words + np.uint64(2))[self.second - 1] * _STEP + words[self.second])
        three = mix(words + np.uint64(3))[self.third - 2] * _STEP + words[self.third - 1]
        three = mix(mix(three) * _STEP + words[self.third])
        self.keys = np.concatenate([one, two, three, np.array([_ALL_WORDS])])
        self.copies = np.repeat(copies, self.lengths)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(self.keys, return_inverse=True)
        weights = [self.copies, self.copies[self.second], self.copies[self.third], [self.copies.sum()]]
        return keys, np.bincount(inverse, np.concatenate(weights), len(keys))

    def scores(self, totals: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
        """Log score and number of backed-off words per document, given totals of the sorted keys."""
        keys, inverse = np.unique(self.keys, return_inverse=True)
        counts = totals[inverse].astype(np.float64)
        n, n2 = len(self.first), len(self.second)
        one, all_words = counts[:n], counts[-1]
        two = np.zeros(n)
        two[self.second] = counts[n : n + n2]
        three = np.zeros(n)
        three[self.third] = counts[n + n2 : -1]
        share = np.where(self.first, 1.0, np.where(self._at_second(), BACKOFF, BACKOFF**2)) * one / max(all_words, 1)
        by_pair = two >= min_count
        before = np.concatenate([[1.0], one[:-1]]) if n else one
        weight = np.where(self._at_second(), 1.0, BACKOFF)
        value = np.where(by_pair, weight * two / np.maximum(before, 1), share)
        by_triple = three >= min_count
        context = np.concatenate([[1.0], two[:-1]]) if n else two
        value = np.where(by_triple, three / np.maximum(context, 1), value)
        backed = ~self.first & ~by_triple & ~(by_pair & self._at_second())
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        logs = np.bincount(owner, np.log(value), len(self.lengths)).astype(np.float64)
        return logs, np.bincount(owner, backed, len(self.lengths)).astype(np.int64)

    def _at_second(self) -> np.ndarray:
        marked = np.zeros(len(self.first), dtype=bool)
        marked[self.second] = True
        marked[self.third] = False
        return marked


def _dealt(docs: DataFrame, batches: int) -> DataFrame:
    """(batch, docs): compressed bundles of documents."""
    import_schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary()), ("copies", pa.int64())])

    def bundle(held: dict[int, list[pa.RecordBatch]]) -> pa.RecordBatch:
        import zstandard

        blobs = []
        for parts in held.values():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, import_schema) as writer:
                writer.write_table(pa.Table.from_batches(parts).combine_chunks())
            blobs.append(zstandard.compress(sink.getvalue().to_pybytes(), 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), type=pa.int64()), pa.array(blobs, type=pa.binary())], names=["batch", "docs"]
        )

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0
        for part in rows:
            texts = part.column("text").cast(pa.large_binary())
            home = part.column("batch").to_numpy()
            own = pa.RecordBatch.from_arrays([part.column("doc_id"), texts, part.column("copies")], schema=import_schema)
            for batch in np.unique(home).tolist():
                held.setdefault(batch, []).append(own.filter(pa.array(home == batch)))
            size += own.nbytes
            if size > _HELD_BYTES:
                yield bundle(held)
                held, size = {}, 0
        if held:
            yield bundle(held)

    home = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch")
    return docs.select("doc_id", "text", "copies", home).mapInArrow(task, "batch long, docs binary")


def _opened(bundles: list[bytes]) -> pa.Table:
    import zstandard

    parts = [pa.ipc.open_stream(zstandard.decompress(b)).read_all() for b in bundles]
    return pa.concat_tables(parts).combine_chunks()


def _batch(table: pa.Table) -> _Batch:
    return _Batch(table.column("text").to_pylist(), table.column("copies").to_numpy())


def _counted(rows: DataFrame) -> tuple[DataFrame, int, bool]:
    """Rows with their number of copies, bytes of all texts, and whether any equal rows were counted.

    Only rows whose copies reach ``HOT_BYTES`` are grouped; the others pass as they are.
    """
    spark = rows.sparkSession
    path = new_run_dir(spark, "equal-rows")
    marked = rows.withColumn("print", F.xxhash64("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sums = marked.groupBy("print").agg(
        F.sum(size).alias("size"), F.sum(size + ROW_BYTES).alias("filled"), F.count("*").alias("found")
    )
    sums = write_table(sums, path)
    total = sums.agg(F.sum("size")).first()[0] or 0
    repeated = sums.select("print", F.when(F.col("found") > 1, F.col("filled")).otherwise(0).alias("n"))
    hot = skew.hot_ids(repeated, "print", HOT_BYTES).select("print")
    delete_dir(spark, path)
    if hot.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long")), total, False
    equal = marked.join(hot, "print", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    others = marked.join(hot, "print", "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    return others.unionByName(equal), total, True


def _written_out(scores: DataFrame) -> DataFrame:
    """A row per copy; copies of one row are dealt to many tasks."""
    pieces = F.sequence(F.lit(0), F.ceil(F.col("copies") / PIECE).cast("long") - 1)
    cut = scores.withColumn("piece", F.explode(pieces)).repartition("doc_id", "piece")
    size = F.least(F.lit(PIECE).cast("long"), F.col("copies") - F.col("piece") * PIECE)
    return cut.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop("copies", "piece", "copy")


def log_scores(docs: DataFrame, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, log_score, n_backed_off."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    counted, size, repeated = _counted(rows)
    batches = max(1, math.ceil(size / BATCH_BYTES))
    bits = max(0, math.ceil(math.log2(max(size / 2 / TABLE_ENTRIES, 1))))
    bundles = _dealt(counted, batches).repartition("batch")

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(parts, ["batch"]):
            keys, counts = _batch(_opened(group["docs"].to_pylist())).distinct()
            home = (keys >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
            starts = np.flatnonzero(np.diff(home, prepend=-1)).tolist()
            spans = list(zip(starts, [*starts[1:], len(keys)]))
            steps = np.diff(keys, prepend=np.uint64(0))
            steps[starts] = keys[starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(home[starts]),
                    pa.array([group["batch"][0].as_py()] * len(spans), type=pa.int64()),
                    pa.array([_pack(steps[a:b]) for a, b in spans], type=pa.binary()),
                    pa.array([_pack(counts[a:b].astype("<u8")) for a, b in spans], type=pa.binary()),
                ],
                names=["part", "batch", "steps", "counts"],
            )

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(parts, ["part"]):
            keys = [np.cumsum(_unpack(x, "<u8")) for x in group["steps"].to_pylist()]
            counts = np.concatenate([_unpack(x, "<u8") for x in group["counts"].to_pylist()])
            ends = np.cumsum([len(k) for k in keys])[:-1]
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(inverse, counts)[inverse].astype("<u8")
            yield pa.RecordBatch.from_arrays(
                [
                    *[group[c].combine_chunks() for c in ("batch", "part")],
                    pa.array([_pack(t) for t in np.split(totals, ends)], type=pa.binary()),
                ],
                names=["batch", "part", "totals"],
            )

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _opened(left["docs"].to_pylist())
        answers = right.sort_by("part")["totals"].to_pylist()
        batch = _batch(own)
        logs, backed = batch.scores(np.concatenate([_unpack(x, "<u8") for x in answers]), min_count)
        return pa.table(
            {
                "doc_id": own["doc_id"], "n_words": batch.lengths, "log_score": logs, "n_backed_off": backed,
                "copies": own["copies"],
            }
        )

    sent = bundles.sortWithinPartitions("batch").mapInArrow(
        send, "part long, batch long, steps binary, counts binary"
    )
    answers = sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "batch long, part long, totals binary")
    scores = (
        bundles.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(finish, "doc_id long, n_words long, log_score double, n_backed_off long, copies long")
    )
    return _written_out(scores) if repeated else scores.drop("copies")

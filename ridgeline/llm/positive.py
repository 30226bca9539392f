"""Quality from trusted positives and unlabelled web text: non-negative positive-unlabelled risk.

Documents marked as good are the positives; all other text is unlabelled, and its labels are
not read. With the share of good documents ``prior``, the risk of calling unlabelled text bad
contains that of the good documents among it, which the positives tell and which is taken out:
``prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])``. Where the second part
turns negative, the model has begun to learn rows by heart; the step then goes the other way.

The prior is estimated too: a model that only tells positives from unlabelled text is fitted
on one half of the sample; among the highest-scored rows of the other half, where hardly any
bad text is, the share of unlabelled rows over the share of positives is the prior. The
threshold with the least upper bound is taken.

A text's inputs are the shapes of its words (letters, capitals and digits in runs, marks as they
are) and measures of its words (repetition, most frequent and distinct words, length, capitals,
digits, marks, lines). Each is a share, and each bound that it reaches is an input; the model is
linear in them. Words themselves are no inputs: most occur in few documents, so they tell
single positives from unlabelled rows (measured: the prior came out as 0.94 to 0.99 where 0.86
is right, and most bad documents passed).

The fit reads at most ``POSITIVES`` and ``UNLABELLED`` documents, the first by a hash of id and
text, one row per document however often it occurs. One task fits on their hashed inputs and
the driver gets the model alone. Scoring reads every whole text.

Defined cases: a null or empty text has only its measures and gets a score like any other; a
document marked both good and bad is no positive; null labels and ids without a document are
not used; without positives or without unlabelled text every score is the constant 0.5;
repeated rows are scored each for itself; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.words import PIECE, pieces

BUCKETS = 1 << 18
#: Bounds of a measure; beyond the last a share is not told apart.
MOST_BOUNDS = 48
#: Most documents that are fitted on.
POSITIVES = 8_000
UNLABELLED = 12_000
#: Share of the sample rows that an input needs, and least number of them.
LEAST_SHARE = 0.002
LEAST_ROWS = 5
STEPS = 150
RATE = 0.05
PENALTY = 1e-3
THRESHOLD = 0.3

#: Letters as a and A, bytes beyond ASCII as a, digits as 0; all else as it is.
_SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_AGAIN = re.compile(rb"(.)\1+", re.DOTALL)


class _Measures:
    """Counts of one text, piece by piece."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.shapes: Counter = Counter()
        self.again = self.letters = self.capitals = self.digits = self.marks = self.lines = 0
        self.last = b""

    def add(self, piece: bytes) -> None:
        found = piece.translate(_LOWER).split()
        if not found:
            self.lines += piece.count(b"\n")
            return
        self.again += sum(map(operator.eq, found, found[1:])) + (found[0] == self.last)
        self.last = found[-1]
        self.words.update(found)
        drawn = piece.translate(_SHAPES)
        self.shapes.update(drawn.split())
        self.capitals += drawn.count(b"A")
        self.letters += drawn.count(b"a")
        self.digits += drawn.count(b"0")
        self.marks += sum(piece.count(c) for c in (b".", b",", b"!", b"?", b";", b":"))
        self.lines += piece.count(b"\n")

    def inputs(self) -> set[int]:
        """Buckets of all bounds that the shares of shapes and measures reach."""
        total = max(sum(self.words.values()), 1)
        kinds: Counter = Counter()
        plain = ending = 0
        for shape, n in self.shapes.items():
            kind = _AGAIN.sub(rb"\1", shape)
            kinds[kind[:12]] += n
            plain += n if b"a" not in kind and b"A" not in kind else 0
            ending += n if kind[-1:] not in b"aA0.," else 0
        out = {crc32(b"length %d" % total.bit_length()) % BUCKETS}
        size = max(self.letters + self.capitals + self.digits, 1)
        measures = (
            self.again / total,
            max(self.words.values(), default=0) / total,
            len(self.words) / total,
            self.capitals / size,
            self.digits / size,
            self.marks / total,
            self.lines / total,
            size / total / 64,
            plain / total,
            ending / total,
        )
        names = [b"measure %d" % k for k in range(len(measures))] + [b"shape " + k for k in kinds]
        for name, value in zip(names, [*measures, *(n / total for n in kinds.values())]):
            out.update(_bounds(name)[: _bounds_reached(value)])
        return out


def _bounds_reached(share: float) -> int:
    """How many bounds a share reaches: the first is zero, later ones are two to a doubling from 2**-10."""
    return 1 if share <= 0 else min(max(math.floor(2 * math.log2(share)) + 21, 1), MOST_BOUNDS)


@lru_cache(maxsize=1 << 14)
def _bounds(name: bytes) -> list[int]:
    return [crc32(b"%d " % k + name) % BUCKETS for k in range(MOST_BOUNDS)]


def inputs(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """The distinct buckets of each text, sorted."""
    for text in texts:
        text = text or b""
        found = _Measures()
        for piece in pieces(text) if len(text) > PIECE else (text,):
            found.add(piece)
        yield np.array(sorted(found.inputs()), dtype=np.int32)


@dataclass
class Model:
    """Sorted buckets with weights, the constant, and the estimated prior."""

    buckets: np.ndarray
    weights: np.ndarray
    constant: float
    prior: float

    def scores(self, texts: Iterable[bytes | None]) -> np.ndarray:
        margins = []
        for row in inputs(texts):
            at = np.searchsorted(self.buckets, row)
            at[at == len(self.buckets)] = 0
            known = self.buckets[at] == row if len(self.buckets) else np.zeros(len(row), dtype=bool)
            margins.append(self.constant + self.weights[at[known]].sum())
        return 1 / (1 + np.exp(-np.clip(np.array(margins, dtype=float), -30, 30)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class _Rows:
    """Rows as positions in the chosen buckets."""

    def __init__(self, rows: list[np.ndarray], position: np.ndarray):
        placed = [p[p >= 0] for r in rows for p in [position[r]]]
        self.n = len(placed)
        self.at = np.concatenate([*placed, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(p) for p in placed])

    def margins(self, weights: np.ndarray, constant: float) -> np.ndarray:
        return constant + np.bincount(self.owner, weights[self.at], self.n)

    def slope(self, per_row: np.ndarray, size: int) -> np.ndarray:
        return np.append(np.bincount(self.at, per_row[self.owner], size), per_row.sum())


def _descend(risk_and_slope, size: int, steps: int) -> np.ndarray:
    """Adam on a vector whose last entry is the constant; the vector of the least risk met."""
    x, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    best, least = x, np.inf
    for step in range(1, steps + 1):
        risk, g = risk_and_slope(x)
        risk += PENALTY / 2 * float(x[:-1] @ x[:-1])
        if risk < least:
            best, least = x, risk
        g = g + PENALTY * np.append(x[:-1], 0)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        x = x - RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return best


def fit_nonnegative(positive: _Rows, unlabelled: _Rows, size: int, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights and constant of the least non-negative risk under the logistic loss."""

    def risk_and_slope(x):
        p, u = positive.margins(x[:-1], x[-1]), unlabelled.margins(x[:-1], x[-1])
        p_one, u_one = 1 / (1 + np.exp(-p)), 1 / (1 + np.exp(-u))
        below = unlabelled.slope(u_one / unlabelled.n, size) - prior * positive.slope(p_one / positive.n, size)
        bad = _softplus(u).mean() - prior * _softplus(p).mean()
        risk = prior * _softplus(-p).mean() + max(0.0, bad)
        if bad < 0:
            return risk, -below
        return risk, below - prior * positive.slope((1 - p_one) / positive.n, size)

    return _descend(risk_and_slope, size, steps)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores, from held-out scores of both."""
    thresholds = np.unique(positive)
    of_positive = 1 - np.searchsorted(np.sort(positive), thresholds) / len(positive)
    of_unlabelled = 1 - np.searchsorted(np.sort(unlabelled), thresholds) / len(unlabelled)
    slack = np.sqrt(np.log(40) / 2 / len(positive)) + np.sqrt(np.log(40) / 2 / len(unlabelled))
    best = np.argmin((of_unlabelled + slack) / of_positive)
    return float(np.clip(of_unlabelled[best] / of_positive[best], 0.01, 0.99))


def fit_rows(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None = None) -> Model:
    """Model from the inputs of positives and unlabelled rows; the same rows give the same model."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, dtype=np.int32), np.zeros(0), 0.0, 0.5)
    seen = np.zeros(BUCKETS, dtype=np.int32)
    for row in [*positive, *unlabelled]:
        seen[row] += 1
    chosen = np.flatnonzero(seen >= max(LEAST_ROWS, LEAST_SHARE * (len(positive) + len(unlabelled))))
    position = np.full(BUCKETS, -1)
    position[chosen] = np.arange(len(chosen))
    size = len(chosen)
    if prior is None:
        halves = [[_Rows(rows[k::2], position) for k in range(2)] for rows in (positive, unlabelled)]
        (p0, p1), (u0, u1) = halves
        prior = 0.5
        if p1.n and u1.n:

            def risk_and_slope(x):
                p, u = p0.margins(x[:-1], x[-1]), u0.margins(x[:-1], x[-1])
                slope = u0.slope(1 / (1 + np.exp(-u)) / u0.n, size) - p0.slope(1 / (1 + np.exp(p)) / p0.n, size)
                return _softplus(-p).mean() + _softplus(u).mean(), slope

            x = _descend(risk_and_slope, size, STEPS // 2)
            prior = estimate_prior(p1.margins(x[:-1], x[-1]), u1.margins(x[:-1], x[-1]))
    x = fit_nonnegative(_Rows(positive, position), _Rows(unlabelled, position), size, prior)
    return Model(chosen.astype(np.int32), x[:-1], float(x[-1]), prior)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Model of ``labels`` (doc_id, quality) over ``docs`` (doc_id, text).

    Both samples are bounded before their texts are fetched. Only marks of 1 are used, apart
    from striking out documents that are marked both ways.
    """
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("print"))
    trusted = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("least"))
        .where("least = 1")
        .select("doc_id")
    )
    prints = rows.select("doc_id", "print")
    marked = prints.join(trusted, "doc_id").groupBy("doc_id").agg(F.min("print").alias("print"))
    marked = marked.orderBy("print", "doc_id").limit(positives).select("print", F.lit(True).alias("positive"))
    plain = prints.groupBy("print").agg(F.lit(False).alias("positive")).orderBy("print").limit(unlabelled)
    picked = marked.unionByName(plain).groupBy("print").agg(
        F.max("positive").alias("positive"), (~F.min("positive")).alias("unlabelled")
    )
    sample = rows.select("print", "text").join(F.broadcast(picked), "print").dropDuplicates(["print"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in inputs(batch.column(1).cast(pa.binary()).to_pylist())]
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["print", "positive", "unlabelled", "inputs"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, plain = [], []
        for batch in batches:
            for is_good, is_plain, found in zip(*(c.to_pylist() for c in batch.columns[1:])):
                row = np.frombuffer(found, dtype=np.int32)
                if is_good:
                    good.append(row)
                if is_plain:
                    plain.append(row)
        model = fit_rows(good, plain)
        parts = [model.buckets.tobytes(), model.weights.tobytes(), model.constant, model.prior]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in parts], names=["buckets", "weights", "constant", "prior"])

    ready = sample.select("print", "text", "positive", "unlabelled").mapInArrow(
        read, "print long, positive boolean, unlabelled boolean, inputs binary"
    )
    # The sample is bounded, and so is what the one task holds.
    found = ready.repartition(1).sortWithinPartitions("print").mapInArrow(
        learn, "buckets binary, weights binary, constant double, prior double"
    ).first()
    if found is None:
        return fit_rows([], [])
    return Model(
        np.frombuffer(found["buckets"], dtype=np.int32), np.frombuffer(found["weights"]), found["constant"], found["prior"]
    )


def score(model: Model, text: Column) -> Column:
    """Probability of label 1 for a text column."""

    @F.pandas_udf("double")
    def scored(batch: pd.Series) -> pd.Series:
        return pd.Series(model.scores(x.encode() if x else b"" for x in batch), dtype=float)

    return scored(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept out of fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Held-out labels are never used."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = docs.select(
        docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), score(model, docs["text"]).alias("score")
    )
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

"""Toxicity by a factorization machine over hashed terms.

Terms are runs of letters and digits (and all bytes beyond ASCII) of the whole text, and
their first bytes as stems, hashed into a fixed number of buckets. A text's inputs are the
buckets it contains that occur in the labelled rows. Besides a weight, each input has
a short factor vector; the product of two vectors is the weight of the pair, so words that
are harmful only together raise the score when they meet.

Fitting begins with the buckets that stand out by themselves and goes on from there with all
of them, so a term that is neutral alone takes part in pairs.

Defined cases: a null or empty text has no inputs and gets the score of the constant term;
labels that are null, unmatched or conflicting (the highest label of a document counts)
do no harm; without any usable label of one class the score is the constant rate; repeated
rows are scored each for itself; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.words import PIECE, hash_stems, pieces

BUCKETS = 1 << 20
#: Most labelled documents that are fitted on, and uses of terms in them, one document at least.
TRAIN_ROWS = 20_000
TRAIN_USES = 20_000_000
#: Buckets that fitting begins with, at most; it goes on with all.
INPUTS = 512
#: Chi-square below which a bucket may stand out by chance among all buckets.
LEAST_CHI = 20.0
FACTORS = 8
#: Passes over the rows with all buckets, and the step of AdaGrad.
EPOCHS = 12
RATE = 0.1
#: What damps steps of weights and of vectors: terms of few rows hardly move.
STEADY = 10_000.0
VECTOR_STEADY = 100.0
PENALTY = 1e-3
#: Size of a text's noise of vectors at the start.
START = 0.1
#: Uses of terms in one step, about, and least steps in a pass.
STEP_USES = 1 << 18
LEAST_STEPS = 8
#: Lengths of the stems in bytes.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The distinct hashed terms of each text, sorted."""
    for text in texts:
        found = []
        data = (text or "").encode()
        for piece in pieces(data) if len(data) > PIECE else [data]:
            kinds = hash_stems(np.frombuffer(piece, dtype=np.uint8), _BREAKS, STEMS)
            found += [(x ^ np.uint64(kind * 0x5DEECE66D)) & np.uint64(BUCKETS - 1) for kind, x in enumerate(kinds)]
        yield np.unique(np.concatenate(found)).astype(np.int32)


@dataclass
class Model:
    """Inputs (sorted buckets), constant, weights and factor vectors."""

    inputs: np.ndarray
    constant: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """Log-odds of rows given as positions in ``inputs``."""
        flat, starts, empty = _flat(rows)
        linear = _sums(self.weights[flat], starts, empty)
        vectors = self.factors[flat]
        together = _sums(vectors, starts, empty)
        alone = _sums(vectors**2, starts, empty)
        return self.constant + linear + 0.5 * (together**2 - alone).sum(axis=1)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        rows = []
        for found in terms(texts):
            at = np.searchsorted(self.inputs, found)
            known = at < len(self.inputs)
            known[known] = self.inputs[at[known]] == found[known]
            rows.append(at[known])
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate([*rows, np.zeros(1, dtype=np.int64)]).astype(np.int64)
    return flat, np.cumsum(lengths) - lengths, lengths == 0


def _sums(values: np.ndarray, starts: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Sums of the rows' values; the last value is a filler that keeps every start valid."""
    values = values.copy()
    values[-1] = 0
    if len(starts) == 0:
        return np.zeros((0, *values.shape[1:]))
    out = np.add.reduceat(values, starts, axis=0)
    out[empty] = 0
    return out


def select_inputs(rows: list[np.ndarray], labels: np.ndarray, most: int) -> np.ndarray:
    """The buckets whose presence departs most from chance (chi-square), sorted."""
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, labels):
        (toxic if label else clean)[row] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    seen = toxic + clean
    expected = seen * n1 / (n0 + n1)
    spread = expected * (n0 / (n0 + n1)) * (1 - seen / (n0 + n1))
    chi = np.where(seen >= 3, (toxic - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    kept = np.argsort(-chi, kind="stable")[:most]
    return np.sort(kept[chi[kept] > LEAST_CHI])


def fit_standing(
    rows: list[np.ndarray],
    labels: np.ndarray,
    inputs: int = INPUTS,
    factors: int = FACTORS,
    steps: int = 120,
    rate: float = 0.1,
    penalty: float = 2e-5,
) -> Model:
    """Full-batch Adam on the logistic loss over the buckets that stand out."""
    labels = labels.astype(float)
    share = (labels.sum() + 1) / (len(labels) + 2)
    chosen = np.zeros(0, dtype=np.int64)
    if 0 < labels.sum() < len(labels):
        chosen = select_inputs(rows, labels, inputs)
    position = np.full(BUCKETS, -1)
    position[chosen] = np.arange(len(chosen))
    placed = [(p := position[r])[p >= 0] for r in rows]
    start = np.random.default_rng(7).normal(0, 0.05, (len(chosen), factors))
    model = Model(chosen, float(np.log(share / (1 - share))), np.zeros(len(chosen)), start)
    if len(chosen) == 0:
        return Model(chosen, model.constant, np.zeros(1), np.zeros((1, factors)))
    flat, starts, empty = _flat(placed)
    owner = np.repeat(np.arange(len(placed)), [len(p) for p in placed])
    flat = flat[:-1]
    params = [np.array([model.constant]), model.weights, model.factors]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    n, m = len(labels), len(chosen)
    for step in range(1, steps + 1):
        constant, weights, vectors = params
        model.constant, model.weights, model.factors = float(constant[0]), weights, vectors
        both = _sums(np.vstack([vectors[flat], vectors[:1]]), starts, empty)
        error = 1 / (1 + np.exp(-np.clip(model.margins(placed), -30, 30))) - labels
        weight_slope = np.bincount(flat, error[owner], m) / n + penalty * weights
        per_use = error[owner, None] * (both[owner] - vectors[flat])
        vector_slope = np.column_stack([np.bincount(flat, per_use[:, f], m) for f in range(factors)]) / n
        slopes = [np.array([error.mean()]), weight_slope, vector_slope + penalty * vectors]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            scaled = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
            params[i] = params[i] - rate * scaled
    return Model(chosen, float(params[0][0]), params[1], params[2])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS) -> Model:
    """AdaGrad on the logistic loss over every term of the rows; the same rows give the same model.

    A step touches only the weights and vectors of its rows' terms.
    """
    labels = labels.astype(float)
    share = (labels.sum() + 1) / (len(labels) + 2)
    constant = float(np.log(share / (1 - share)))
    if not 0 < labels.sum() < len(labels) or not (uses := sum(map(len, rows))):
        return Model(np.zeros(0, dtype=np.int64), constant, np.zeros(1), np.zeros((1, factors)))
    used = np.zeros(BUCKETS, dtype=bool)
    for row in rows:
        used[row] = True
    chosen = np.flatnonzero(used)
    position = np.zeros(BUCKETS, dtype=np.int32)
    position[chosen] = np.arange(len(chosen))
    random = np.random.default_rng(7)
    order = random.permutation(len(rows))
    steps = max(LEAST_STEPS, uses // STEP_USES)
    parts = [p for p in np.array_split(order, min(steps, len(rows))) if len(p)]
    weights = np.zeros(len(chosen), dtype=np.float32)
    # Pairs start as noise that stays small in a text of usual length.
    vectors = random.normal(0, START / np.sqrt(uses / len(rows)), (len(chosen), factors)).astype(np.float32)
    first = fit_standing(rows, labels, factors=factors)
    if len(first.inputs):
        weights[position[first.inputs]] = first.weights
        vectors[position[first.inputs]] = first.factors
        constant = first.constant
    model = Model(chosen, constant, weights, vectors)
    weights_seen, vectors_seen = (np.zeros(len(chosen), dtype=np.float32) for _ in range(2))
    constant_seen = 0.0
    held = []
    # One array each for all parts: many arrays of the size of a part stay with the process after the fit.
    flats, owners = np.empty(uses, dtype=np.int32), np.empty(uses, dtype=np.min_scalar_type(max(map(len, parts))))
    end = 0
    for part in parts:
        lengths = np.array([len(rows[i]) for i in part])
        if lengths.sum() == 0:
            continue
        start, end = end, end + int(lengths.sum())
        flat, owner = flats[start:end], owners[start:end]
        here, flat[:] = np.unique(np.concatenate([position[rows[i]] for i in part]), return_inverse=True)
        by_term = np.argsort(flat, kind="stable")
        owner[:] = np.repeat(np.arange(len(part), dtype=owner.dtype), lengths)[by_term]
        uses_of = np.bincount(flat, minlength=len(here))
        held.append((labels[part], lengths, here, flat, owner, (np.cumsum(uses_of) - uses_of).astype(np.int32)))
    for _ in range(epochs):
        for at in random.permutation(len(held)):
            truth, lengths, here, flat, owner, first_use = held[at]
            w, v = weights[here], vectors[here]
            starts, empty = np.cumsum(lengths) - lengths, lengths == 0
            both = _sums(np.vstack([v[flat], v[:1]]), starts, empty)
            alone = _sums(np.append(((v * v).sum(axis=1))[flat], v[:1, 0]), starts, empty)
            linear = _sums(np.append(w[flat], w[:1]), starts, empty)
            margins = model.constant + linear + 0.5 * ((both**2).sum(axis=1) - alone)
            error = (1 / (1 + np.exp(-np.clip(margins, -30, 30))) - truth).astype(np.float32)
            sums = np.add.reduceat(error[owner], first_use)
            drawn = np.add.reduceat((error[:, None] * both)[owner], first_use, axis=0)
            weight_slope = sums + PENALTY * w
            vector_slope = drawn - sums[:, None] * v + PENALTY * v
            weights_seen[here] += weight_slope**2
            vectors_seen[here] += (vector_slope**2).mean(axis=1)
            weights[here] -= RATE * weight_slope / np.sqrt(weights_seen[here] + STEADY)
            vectors[here] -= RATE * vector_slope / np.sqrt(vectors_seen[here] + VECTOR_STEADY)[:, None]
            constant_seen += float(error.sum()) ** 2
            model.constant -= RATE * float(error.sum()) / np.sqrt(constant_seen + STEADY)
    return model


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, most_uses: int = TRAIN_USES) -> Model:
    """Fit on at most ``most_rows`` labelled documents, the first by a hash of their id.

    ``labels`` has (doc_id, toxic). Of rows that repeat an id one is fitted on, the first by a
    hash of its text, and documents are taken until their terms have ``most_uses`` uses.
    One task holds this sample and fits; the driver gets the model alone.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    marked = texts.join(F.broadcast(known), "doc_id").withColumn("print", F.xxhash64("text"))
    first = marked.groupBy("doc_id").agg(F.min("print").alias("print"))
    sample = marked.join(F.broadcast(first), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t.tobytes() for t in terms(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, type=pa.binary())],
                names=["doc_id", "label", "terms"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, uses = [], 0
        for batch in batches:
            for doc_id, label, found in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2)):
                row = np.frombuffer(found.as_buffer(), dtype=np.int32)  # not copied
                uses += len(row)
                if not sample or uses <= most_uses:
                    sample.append((doc_id, label, row))
        sample.sort(key=lambda row: row[0])
        model = fit_rows([r for _, _, r in sample], np.array([m for _, m, _ in sample], dtype=np.int64))
        kinds = (np.int32, np.float32, np.float32)
        parts = [x.astype(t).tobytes() for x, t in zip((model.inputs, model.weights, model.factors), kinds)]
        columns = [pa.array([x]) for x in (*parts, model.constant, model.factors.shape[1])]
        yield pa.RecordBatch.from_arrays(columns, names=["inputs", "weights", "factors", "constant", "width"])

    ready = sample.select("doc_id", "text", "label").mapInArrow(read, "doc_id long, label int, terms binary")
    found = (
        ready.repartition(1)
        .sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
        .mapInArrow(learn, "inputs binary, weights binary, factors binary, constant double, width long")
        .toArrow()  # a row would be copied several times on its way to Python
    )
    if found.num_rows == 0:
        return fit_rows([], np.zeros(0, dtype=np.int64))
    parts = zip(("inputs", "weights", "factors"), (np.int32, np.float32, np.float32))
    inputs, weights, factors = (np.frombuffer(found[name][0].as_buffer(), dtype=t) for name, t in parts)
    return Model(inputs, found["constant"][0].as_py(), weights, factors.reshape(-1, found["width"][0].as_py()))


def score(model: Model, text: Column) -> Column:
    """Probability of label 1 for a text column."""
    # As a broadcast it is written to a file piece by piece; inside the function it would be pickled in memory.
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batch: pa.Array) -> pa.Array:
        model = shared.value
        parts = [model.scores(batch.slice(i, 500).to_pylist()) for i in range(0, len(batch), 500)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return scored(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept out of fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Held-out labels are never used."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = docs.select(
        docs["doc_id"],
        held_out(docs["doc_id"]).alias("held_out"),
        score(model, docs["text"]).alias("score"),
    )
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

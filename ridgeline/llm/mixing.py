"""Mixing documents to target weights of domains they belong to softly.

A classifier fitted on a labelled table gives every document a posterior over the domains.
Rates r >= 0 per document are then fitted by projected gradient least squares, so that the
expected tokens of each domain, sum(rate * tokens * posterior), come close to their targets.
The gradient of a document is its posterior times the residual of the totals, so an
iteration is one grouped sum of as many numbers as there are domains, and a document's rate
is a column expression of its posterior: no state is kept per iteration. Steps have
Barzilai-Borwein length.

Everything is a DataFrame expression. The classifier is naive Bayes on whole words, hashed into
a fixed number of buckets; the sum of a document's evidence is divided by the root of its
word count, as neighbouring words are not independent. Tokens are words.

Defined cases: every row is a document of its own with its own rate and draw, whatever its
doc_id, null and repeated ones included; a text without words has no tokens and the posterior
of the labelled shares; labels that are null or name no target domain are not used; a domain
without labels gets a small share; an empty table gives an empty result; other columns are
never read. A total of zero tokens leaves every rate at one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.workdir import new_run_dir, write_table

#: Target shares of the registered query and of the pipeline.
SHARES = {"good": 0.95, "junk": 0.05}
BUCKETS = 1 << 16
#: Most labelled documents the classifier is fitted on.
TRAIN_ROWS = 20_000
SMOOTHING = 0.5
ITERATIONS = 40
TOLERANCE = 1e-6
#: Iterations whose steps are kept as one expression before the rates are written.
DEPTH = 6


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per word with its bucket; one row with nulls for a text without words."""
    words = F.explode_outer(F.split(F.col("text"), r"\s+")).alias("word")
    found = docs.select(*keep, words).withColumn("word", F.expr("nullif(word, '')"))
    return found.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))


def fit_evidence(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """Evidence per bucket and domain (at most BUCKETS rows) and the log shares of the domains."""
    sample = (
        labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_ROWS)
    )
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    shares = sample.agg(*[F.count_if(F.col("domain") == d) for d in domains]).first()
    total = sum(shares) + SMOOTHING * len(domains)
    log_shares = [math.log((n + SMOOTHING) / total) for n in shares]
    counts = write_table(
        _words(marked, "domain")
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(*[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]),
        new_run_dir(docs.sparkSession, "mixing-counts"),
    )
    sums = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(domains))]).first()
    logs = [
        F.log((F.col(f"n{i}") + SMOOTHING) / (sums[i] + SMOOTHING * BUCKETS)) for i in range(len(domains))
    ]
    middle = sum(logs[1:], logs[0]) / len(domains)
    return counts.select("bucket", *[(x - middle).alias(f"e{i}") for i, x in enumerate(logs)]), log_shares


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """(row, doc_id, tokens, p0, p1, ...) per row of (row, doc_id, text); ``row`` tells rows apart."""
    evidence, log_shares = fit_evidence(docs, labels, domains)
    k = range(len(domains))
    sums = (
        _words(docs, "row", "doc_id")
        .join(F.broadcast(evidence), "bucket", "left")
        .groupBy("row", "doc_id")
        .agg(F.count("word").alias("tokens"), *[F.coalesce(F.sum(f"e{i}"), F.lit(0.0)).alias(f"s{i}") for i in k])
    )
    scale = F.sqrt(F.greatest(F.col("tokens"), F.lit(1)))
    own = ["row", "doc_id", "tokens"]
    odds = sums.select(*own, *[(F.col(f"s{i}") / scale + log_shares[i]).alias(f"o{i}") for i in k])
    top = F.greatest(*[F.col(f"o{i}") for i in k]) if len(domains) > 1 else F.col("o0")
    weights = odds.select(*own, *[F.exp(F.col(f"o{i}") - top).alias(f"w{i}") for i in k])
    whole = sum((F.col(f"w{i}") for i in k), F.lit(0.0))
    return weights.select(*own, *[(F.col(f"w{i}") / whole).alias(f"p{i}") for i in k])


def _step(rate: Column, slopes: np.ndarray, most: float | None) -> Column:
    """The projected rate after one step along the posterior-weighted residual."""
    moved = rate - sum((F.col(f"p{i}") * float(s) for i, s in enumerate(slopes)), F.lit(0.0))
    moved = F.greatest(moved, F.lit(0.0))
    return F.least(moved, F.lit(float(most))) if most is not None else moved


def fit_rates(members: DataFrame, targets: list[float], most: float | None = None) -> DataFrame:
    """``members`` (tokens, p0, p1, ...) with the column ``rate`` for target token totals.

    A rate is an expression of the posterior that grows by a step per iteration; every
    ``DEPTH`` iterations it is written, so plans stay small however many iterations there are.
    """
    k = len(targets)
    moments = [F.sum(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k)]
    row = members.agg(F.sum("tokens"), *moments).first()
    if not row[0]:
        return members.withColumn("rate", F.lit(1.0))
    total = float(row[0])
    gram = np.array(row[1:], dtype=float).reshape(k, k) / total
    goal = np.array(targets, dtype=float) / total
    largest = float(np.linalg.eigvalsh(gram)[-1])
    shortest, longest = 1 / largest, 1e4 / largest
    columns, rated = members.columns, members
    rate = before = best = F.lit(1.0)
    size, last, best_gap = shortest, None, math.inf
    for iteration in range(ITERATIONS):
        if iteration and iteration % DEPTH == 0:
            rated = rated.select(*columns, rate.alias("rate"), before.alias("before"), best.alias("best"))
            rated = write_table(rated, new_run_dir(members.sparkSession, "mixing-rates"))
            rate, before, best = F.col("rate"), F.col("before"), F.col("best")
        moved = F.sum(F.col("tokens") * (rate - before) * (rate - before))
        row = rated.agg(*[F.sum(rate * F.col("tokens") * F.col(f"p{i}")) for i in range(k)], moved).first()
        residual = np.array(row[:k], dtype=float) / total - goal
        gap = float(residual @ residual)
        if gap < best_gap:
            best, best_gap = rate, gap
        if math.sqrt(gap) < TOLERANCE:
            break
        if last is not None:
            bend = float((residual - last) @ (residual - last))
            size = min(max(row[k] / total / bend, shortest), longest) if bend > 0 else shortest
        before, rate, last = rate, _step(rate, size * residual, most), residual
    return rated.select(*columns, best.alias("rate"))


def copies(rate: Column, *key: Column) -> Column:
    """How often a row is taken: the whole part of its rate, and once more by a hash of its key."""
    chance = F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    budget: float,
    most: float | None = None,
    row_col: str | None = None,
) -> DataFrame:
    """(row, doc_id, tokens, posterior, rate, copies) per row.

    ``labels`` has (doc_id, domain); ``targets`` gives each domain's share of a total of
    ``budget`` times the tokens there are; ``most`` bounds the rates. ``row_col`` names a
    column that tells rows apart; without one, rows are numbered as they are read.
    """
    domains = sorted(targets)
    row = F.monotonically_increasing_id() if row_col is None else docs[row_col]
    rows = docs.select(
        row.cast("long").alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")
    )
    members = write_table(posteriors(rows, labels, domains), new_run_dir(docs.sparkSession, "mixing-members"))
    tokens = members.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = sum(targets.values())
    rated = fit_rates(members, [budget * tokens * targets[d] / shares for d in domains], most)
    return rated.select(
        "row",
        "doc_id",
        "tokens",
        F.struct(*[F.col(f"p{i}").alias(d) for i, d in enumerate(domains)]).alias("posterior"),
        "rate",
        copies(F.col("rate"), F.col("doc_id"), F.col("row")).alias("copies"),
    )


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality labels."""
    domain = F.expr("case quality when 1 then 'good' when 0 then 'junk' end")
    return labels.select("doc_id", domain.alias("domain"))

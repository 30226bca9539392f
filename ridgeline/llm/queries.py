"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import (
    backoff,
    codes,
    minhash,
    mixing,
    packing,
    pages,
    positive,
    quotes,
    repair,
    rollup,
    scan,
    stripes,
    tokens,
    toxicity,
)
from ridgeline.workdir import new_run_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff.log_scores(_table(spark, sf_dir, "documents"))
    return scores.withColumn("log_score", F.round("log_score", 4))


def op2_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = quotes.with_quotations(_table(spark, sf_dir, "conversations"))
    found = quotes.conversations(sent).drop("thread", "parent_thread", "root_thread")
    numbers = {"conv_id": F.col("message").bitwiseAND(F.lit((1 << 32) - 1)), "turn": F.shiftright("message", 32)}
    return found.withColumns(numbers)


def _rolled_up(spark: SparkSession, sf_dir: str, vocabulary: str | None) -> DataFrame:
    kept = rollup.TokenRollup(spark, new_run_dir(spark, "token-rollup"))
    history = rollup.document_history(_table(spark, sf_dir, "documents"), vocabulary)
    for batch_id, changes in enumerate(history):
        kept.apply(batch_id, changes)
    kept.apply(1, history[1])  # sent again: must change nothing
    return kept.totals()


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled_up(spark, sf_dir, None)


def op3_token_counts_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ids of the BPE vocabulary besides, which SQL cannot count."""
    return _rolled_up(spark, sf_dir, tokens.vocabulary_path())


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    mixed = mixing.mix(docs, mixing.label_domains(labels), mixing.SHARES, budget=0.95)
    return mixed.select("doc_id", "tokens", "posterior.*", "rate", "copies")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.nearest(_table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, labels.select("doc_id", "toxic"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, tokens.vocabulary_path())
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(_table(spark, sf_dir, "conversations"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.SourceAudit(_table(spark, sf_dir, "documents")).report()


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return positive.score_documents(docs, labels.select("doc_id", "quality"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_lm_scoring,
        op2_quotations,
        op3_token_counts,
        op3_token_counts_bpe,
        op4_minhash,
        op5_mixing,
        op6_html,
        op7_embedding_dedup,
        op8_ann,
        op9_toxicity,
        op10_packing,
        op11_conversation_repair,
        op12_source_audit,
        op13_quality,
    )
    return {q.__name__: q for q in registered}

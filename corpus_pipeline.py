"""From raw documents to packed training sequences, one Parquet table per stage.

Columns other than doc_id and text pass through every filtering stage, whatever their names
(only ``_pipeline_row`` is taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import minhash, mixing, packing, tokens, toxicity
from ridgeline.workdir import new_run_dir, write_table


ROW = "_pipeline_row"


def _numbered(docs: DataFrame, label: str) -> DataFrame:
    """The documents as a table with a number per row, which tells rows apart that ids do not."""
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    return write_table(numbered, new_run_dir(docs.sparkSession, f"pipeline-{label}-rows"))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Each row is scored by its own text, so rows that repeat an id or have none are judged
    each for itself; null and empty texts get the score of the constant term. Without labels
    of both classes every score is that constant. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.score(model, docs["text"]) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, null ids last.

    Rows are compared and kept one by one, whatever their ids: a unique text stays though
    another row of its id is a copy, and of equal rows one stays. Texts that are null, empty or
    blank are no copies of anything and all stay. An empty table stays empty.
    """
    rows = _numbered(docs, "near_duplicates")
    found = minhash.near_duplicates(rows, shingle=5, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    kept = (
        rows.select(ROW, "doc_id").join(found, ROW)
        .groupBy("component_id").agg(F.min(first)[ROW].alias(ROW))
        .select(ROW)
    )
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn at the rates that bring the domains to their shares, each at most once.

    Each row has its own rate and draw, so rows without an id, or with the same, are not kept or
    dropped together. Texts without words have the rate of the labelled shares. An empty
    table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = _numbered(docs, "mixing")
    mixed = mixing.mix(rows, mixing.label_domains(labels), mixing.SHARES, budget=0.95, most=1.0, row_col=ROW)
    taken = mixed.where("copies > 0").select(F.col("row").alias(ROW))
    return rows.join(taken, ROW, "left_semi").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens.

    Each row is a document of its own; null and empty texts are the end token alone. An empty
    table gives no pieces.
    """
    pieces = packing.pack(docs, tokens.vocabulary_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Models, sketches and tokens have no SQL counterpart; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage reads its predecessor's table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), new_run_dir(spark, f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)

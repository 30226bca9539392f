"""Token totals by source, language and tokenizer version, kept up by batches of changes.

A batch brings inserted, deleted and revised counts per document and tokenizer. It is turned
into signed rows against what earlier batches left, summed by group, and stored as one table
of additive deltas; the totals are the sum of all committed deltas. A batch is committed
when its delta table is complete. Everything a batch writes has its number in the path and
replaces what an unfinished attempt left; a committed batch is skipped, so batches can be
sent again.

Batches are applied one after the other. ``compact`` folds the document entries and the
deltas of committed batches into one table each, so that looking up and adding up stay
cheap, and removes what the compaction before it had folded already: frames made since then
can still be read.

Defined cases: of several changes of one (doc_id, tokenizer) in a batch the one with the
greatest ``seq`` counts, then the greatest (op, tokens); an insert of a known document
revises it, a revision of an unknown one inserts it, a deletion of an unknown one does
nothing; null sources and languages are groups of their own; null token counts are zero;
changes without doc_id or tokenizer are left out; an empty batch is committed and changes
nothing; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.tokens import encoder
from ridgeline.workdir import delete_dir, list_versions

_KEYS = ["doc_id", "tokenizer"]
_GROUPS = ["source", "lang", "tokenizer"]
_ENTRY = "doc_id long, tokenizer string, source string, lang string, tokens long, live boolean, batch_id long"
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long, batch_id long"


def bpe_count(text: Column, vocabulary: str) -> Column:
    """Number of ids of a text in the word BPE vocabulary; null texts have none."""

    @F.pandas_udf("long")
    def counted(batch: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else None for t in batch]
        encode = encoder(vocabulary)
        return pd.Series([len(x) for i in range(0, len(texts), 1000) for x in encode.ids(texts[i : i + 1000])], dtype="int64")

    return counted(text)


@dataclass
class TokenRollup:
    """The rollup stored below ``path``, a folder that all executors share."""

    spark: SparkSession
    path: str

    def _versions(self, kind: str) -> list[int]:
        return list_versions(self.spark, f"{self.path}/{kind}", "batch_id")

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.path}/{kind}/batch_id={batch_id}"

    def _base(self) -> int | None:
        """The last batch that a finished compaction has folded in."""
        return max(self._versions("folded"), default=None)

    def committed(self) -> list[int]:
        base, found = self._base(), set(self._versions("deltas"))
        if base is not None:
            found |= {r.done for r in self.spark.read.schema("done long").parquet(self._folder("folded", base)).collect()}
        return sorted(found)

    def _later(self, kind: str, schema: str) -> DataFrame:
        """What committed batches after the last compaction wrote."""
        base, done = self._base(), set(self.committed())
        folders = [self._folder(kind, b) for b in self._versions(kind) if b in done and (base is None or b > base)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders)

    def _state(self) -> DataFrame:
        """The newest entry per document and tokenizer."""
        value = F.struct("batch_id", "source", "lang", "tokens", "live")
        newest = self._later("entries", _ENTRY).groupBy(*_KEYS).agg(F.max(value).alias("e")).select(*_KEYS, "e.*")
        base = self._base()
        if base is None:
            return newest
        folded = self.spark.read.schema(_ENTRY.replace(", batch_id long", "")).parquet(self._folder("bases", base))
        kept = folded.join(newest.select(*_KEYS), _KEYS, "left_anti")
        return kept.unionByName(newest.drop("batch_id"))

    def apply(self, batch_id: int, changes: DataFrame) -> bool:
        """Apply (op, doc_id, tokenizer, source, lang, tokens, seq); False if the batch was committed before."""
        done = self.committed()
        if batch_id in done:
            return False
        if done and batch_id < done[-1]:
            raise ValueError(f"batch {batch_id} comes after batch {done[-1]}")
        value = F.struct("seq", "op", F.coalesce("tokens", F.lit(0)).alias("tokens"), "source", "lang")
        newest = (
            changes.where("doc_id is not null and tokenizer is not null and op in ('insert', 'delete', 'revise')")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer")
            .agg(F.max(value).alias("c"))
            .select(*_KEYS, "c.op", "c.source", "c.lang", F.col("c.tokens").cast("long").alias("tokens"))
        )
        state = self._state().where("live").select(
            *_KEYS, F.col("source").alias("was_source"), F.col("lang").alias("was_lang"), F.col("tokens").alias("was_tokens")
        )
        joined = newest.join(state, _KEYS, "left").where("op <> 'delete' or was_tokens is not null")
        entries = joined.select(
            *_KEYS, "source", "lang", "tokens", (F.col("op") != "delete").alias("live"), "was_source", "was_lang", "was_tokens"
        )
        folder = self._folder("entries", batch_id)
        entries.write.mode("overwrite").parquet(folder)
        entries = self.spark.read.schema(entries.schema).parquet(folder)
        plus = entries.where("live").select(*_GROUPS, F.lit(1).alias("docs"), "tokens")
        minus = entries.where("was_tokens is not null").select(
            F.col("was_source").alias("source"), F.col("was_lang").alias("lang"), "tokenizer",
            F.lit(-1).alias("docs"), (-F.col("was_tokens")).alias("tokens"),
        )
        deltas = plus.unionByName(minus).groupBy(*_GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(self._folder("deltas", batch_id))
        return True

    def compact(self) -> None:
        """Fold the entries and deltas of all committed batches; finished when ``folded`` is written."""
        done, before = self.committed(), self._base()
        if not done or done[-1] == before:
            return
        state = self._state().where("live").select(*_KEYS, "source", "lang", "tokens", "live")
        state.write.mode("overwrite").parquet(self._folder("bases", done[-1]))
        self.totals().write.mode("overwrite").parquet(self._folder("sums", done[-1]))
        ids = self.spark.createDataFrame([(b,) for b in done], "done long").coalesce(1)
        ids.write.mode("overwrite").parquet(self._folder("folded", done[-1]))
        if before is None:
            return
        for kind in ("entries", "deltas"):
            for old in self._versions(kind):
                if old <= before:
                    delete_dir(self.spark, self._folder(kind, old))
        for kind in ("bases", "sums", "folded"):
            for old in self._versions(kind):
                if old < before:
                    delete_dir(self.spark, self._folder(kind, old))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of all committed batches."""
        deltas, base = self._later("deltas", _DELTA).drop("batch_id"), self._base()
        if base is not None:
            deltas = deltas.unionByName(self.spark.read.schema(_DELTA.replace(", batch_id long", "")).parquet(self._folder("sums", base)))
        sums = deltas.groupBy(*_GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))


#: Name of the counts by the word BPE vocabulary.
BPE = "word_bpe_49k"


def counted(docs: DataFrame, text: Column, vocabulary: str | None = None) -> DataFrame:
    """One row per document and tokenizer: words and bytes by plain expressions, and ids of the
    word BPE vocabulary if it is given."""
    counts = [
        F.struct(F.lit("words-1").alias("tokenizer"), word_count(text).cast("long").alias("tokens")),
        F.struct(F.lit("bytes-1").alias("tokenizer"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("tokens")),
    ]
    if vocabulary is not None:
        docs = docs.withColumn("_ids", bpe_count(text, vocabulary))
        counts.append(F.struct(F.lit(BPE).alias("tokenizer"), F.col("_ids").alias("tokens")))
    return docs.select("doc_id", "source", "lang", F.inline(F.array(*counts)))


def document_history(docs: DataFrame, vocabulary: str | None = None) -> list[DataFrame]:
    """Three batches of changes from a documents table: all documents come in; the counts of
    those with repeated lines are revised to their distinct lines; all but the first of each
    set of equal texts are deleted.

    Null texts count nothing and are copies of nothing; rows without doc_id have changes
    without one, which a rollup leaves out; of rows that repeat a doc_id the rollup keeps one.
    """
    base = docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    fields = ["op", "doc_id", "tokenizer", "source", "lang", "tokens", F.lit(0).alias("seq")]
    come = counted(base, F.col("text"), vocabulary).withColumn("op", F.lit("insert")).select(*fields)
    lines = F.split("text", "\n")
    shorter = base.where(F.size(lines) > F.size(F.array_distinct(lines)))
    revised = counted(shorter, F.array_join(F.array_distinct(lines), "\n"), vocabulary)
    revised = revised.withColumn("op", F.lit("revise")).select(*fields)
    prints = base.where("text is not null").select("doc_id", F.md5("text").alias("print"))
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    copies = prints.join(first, "print").where("doc_id <> first").select("doc_id").distinct()
    tokenizers = ["words-1", "bytes-1"] + ([BPE] if vocabulary is not None else [])
    gone = copies.select(
        F.lit("delete").alias("op"), "doc_id", F.explode(F.array(*[F.lit(t) for t in tokenizers])).alias("tokenizer"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
        F.lit(None).cast("long").alias("tokens"), F.lit(0).alias("seq"),
    )
    return [come, revised, gone]

"""How the sources of a language differ in their words, from stripes folded inside the mappers.

A task folds whole documents into stripes: for each language and term the number of
documents and the count in each source. Stripes leave the task when they are many and at its
end, so memory follows a bound and not the input. They meet again by (language, term), where
only terms of enough documents stay. All counts and shares are integers, so nothing depends
on partitioning.

A source's share of a term is ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))`` with
``N`` the source's count of all V kept terms. Two things are derived:

* ``term_leads``: the terms that a source uses more than its language does;
* ``pair_distances``: sum of absolute differences of shares over all kept terms, for every
  pair of sources. A term that two sources lack contributes a constant, and one that a single
  source has contributes by its share alone, so only histograms of shares and the pairs that
  meet in a stripe are summed; no source is filled up with zeros.

Defined cases: null text, language and source count as empty strings; texts without terms
(empty, digits only) still make their source occur; repeated rows count each; a language
without kept terms has distances 0 and no leads; a source alone in its language has no pairs;
an empty table gives an empty result; other columns are never read. A long text is read in
pieces and counted as one document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.words import PIECE, pieces
from ridgeline.workdir import new_run_dir, write_table

SCALE = 1_000_000_000
PRIOR = 5
#: Documents of its language that a term needs.
LEAST_DOCUMENTS = 30
#: Leading terms reported per source.
LEADS = 50
#: Entries of a task's stripes that make them leave.
HELD_ENTRIES = 600_000
#: Pairs of one task that are held before they leave.
HELD_PAIRS = 1 << 20
#: Parts of a language's sources when distances are put together.
BLOCKS = 64

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STRIPE = "lang string, term string, documents long, sources array<string>, counts array<long>"


class _Fold:
    """Stripes of the documents seen so far: per language, terms to documents and to counts by source."""

    def __init__(self) -> None:
        self.documents: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}
        self.grown = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        documents = self.documents.setdefault(lang, Counter())
        counts = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        seen: set[bytes] = set()
        for piece in pieces(text) if len(text) > PIECE else (text,):
            found = _TERM.findall(piece.translate(_LOWER))
            counts.update(found)
            seen.update(found)
        documents.update(seen)
        self.grown += len(seen)

    def full(self, most: int) -> bool:
        if self.grown < most // 4:
            return False
        entries = sum(map(len, self.documents.values()))
        entries += sum(len(c) for by_source in self.counts.values() for c in by_source.values())
        self.grown = 0 if entries < most else self.grown
        return entries >= most

    def stripes(self) -> Iterator[pa.RecordBatch]:
        """What is held, a batch or more per language; nothing is held afterwards."""
        for lang, documents in self.documents.items():
            terms = list(documents)
            place = {t: i for i, t in enumerate(terms)}
            sources = list(self.counts[lang])
            at, whose, count = [], [], []
            for k, source in enumerate(sources):
                held = self.counts[lang][source]
                at.append(np.fromiter((place[t] for t in held), np.int64, len(held)))
                count.append(np.fromiter(held.values(), np.int64, len(held)))
                whose.append(np.full(len(held), k, dtype=np.int32))
            at, whose, count = np.concatenate(at), np.concatenate(whose), np.concatenate(count)
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=len(terms)))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            names = pa.DictionaryArray.from_arrays(whose[order], pa.array(sources, pa.string())).cast(pa.string())
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(np.fromiter(documents.values(), np.int64, len(terms))),
                    pa.ListArray.from_arrays(offsets, names),
                    pa.ListArray.from_arrays(offsets, pa.array(count[order])),
                ],
                names=["lang", "term", "documents", "sources", "counts"],
            )
            for start in range(0, len(terms), 20_000):
                yield batch.slice(start, 20_000)
        self.__init__()


def fold_stripes(docs: DataFrame, held: int = HELD_ENTRIES) -> DataFrame:
    """Partial stripes: each task folds its documents, whatever their number, into a bounded table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold()
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                fold.add(lang, source, text)
                if fold.full(held):
                    yield from fold.stripes()
        yield from fold.stripes()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(task, _STRIPE)


def merge_stripes(parts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One stripe per (language, term) that ``least`` documents have; sources in order of name.

    Rows arrive sorted by key. Documents are summed for a whole batch at once; only stripes
    that stay, and the one that is open at a batch's end, are added up source by source.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, documents, counts = None, 0, {}

        def stripe(key, documents, counts):
            names = sorted(counts, key=str.encode)
            return *key, documents, names, [counts[s] for s in names]

        def rows(found):
            columns = zip(*found)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["lang", "term", "documents", "sources", "counts"],
            )

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            langs, terms = batch.column(0), batch.column(1)
            new = np.ones(n, dtype=bool)
            if n > 1:
                changed = pc.or_(pc.not_equal(langs[1:], langs[:-1]), pc.not_equal(terms[1:], terms[:-1]))
                new[1:] = changed.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            sums = np.add.reduceat(batch.column(2).to_numpy(), starts)
            found = []
            for i in range(len(starts)):
                first, last = i == 0, i == len(starts) - 1
                if not (first or last or sums[i] >= least):
                    continue
                here = (langs[int(starts[i])].as_py(), terms[int(starts[i])].as_py())
                if here != key:
                    if key is not None and documents >= least:
                        found.append(stripe(key, documents, counts))
                    key, documents, counts = here, 0, {}
                documents += int(sums[i])
                part = batch.slice(int(starts[i]), int(ends[i] - starts[i]))
                for source, count in zip(part.column(3).flatten().to_pylist(), part.column(4).flatten().to_pylist()):
                    counts[source] = counts.get(source, 0) + count
            if found:
                yield rows(found)
        if key is not None and documents >= least:
            yield rows([stripe(key, documents, counts)])

    dealt = parts.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(task, _STRIPE)


def _share(count: str, total: str, terms: str) -> Column:
    """The exact share; 0 where there are no kept terms. Decimals hold the product of large counts."""
    scaled = f"cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(19,0))"
    return F.expr(f"if({terms} = 0, 0, 1 + ({scaled}) div cast(greatest({total} + {PRIOR} * {terms}, 1) as decimal(19,0)))")


def _stripe_total() -> Column:
    return F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)


class SourceAudit:
    """Merged stripes of a documents table (lang, source, text) and what they tell.

    ``stripes`` has (lang, term, documents, sources, counts); ``groups`` one row per language
    and source that occurs: (lang, source, total, own_terms, terms, lang_total, unseen), where
    ``unseen`` is the share of a kept term that the source lacks.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS, held: int = HELD_ENTRIES):
        spark = docs.sparkSession
        rows = docs.select(
            *[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
        )
        self.stripes = write_table(merge_stripes(fold_stripes(rows, held), least), new_run_dir(spark, "stripes"))
        entries = self._entries()
        counted = entries.groupBy("lang", "source").agg(
            F.sum("count").alias("total"), F.count(F.lit(1)).alias("own_terms")
        )
        by_lang = self.stripes.groupBy("lang").agg(
            F.count(F.lit(1)).alias("terms"), F.sum(_stripe_total()).alias("lang_total")
        )
        numbers = ("total", "own_terms", "terms", "lang_total")
        groups = (
            rows.select("lang", "source").distinct()
            .join(counted, ["lang", "source"], "left")
            .join(by_lang, "lang", "left")
            .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
        )
        groups = groups.withColumn("unseen", _share("0", "total", "terms"))
        self.groups = write_table(groups, new_run_dir(spark, "stripe-groups"))

    def _entries(self) -> DataFrame:
        """(lang, term, term_total, source, count) per source of a stripe."""
        pairs = F.explode(F.arrays_zip("sources", "counts")).alias("entry")
        found = self.stripes.select("lang", "term", _stripe_total().alias("term_total"), pairs)
        entry = [F.col("entry.sources").alias("source"), F.col("entry.counts").alias("count")]
        return found.select("lang", "term", "term_total", *entry)

    def shares(self) -> DataFrame:
        """(lang, term, source, count, share, lang_share, unseen) for counts above zero."""
        found = self._entries().join(self.groups, ["lang", "source"])
        return found.select(
            "lang", "term", "source", "count",
            _share("count", "total", "terms").alias("share"),
            _share("term_total", "lang_total", "terms").alias("lang_share"),
            "unseen",
        )

    def term_leads(self, most: int = LEADS) -> DataFrame:
        """(lang, source, term, lead, rank): terms whose share exceeds the language's, largest lead first."""
        lead = (F.col("share") - F.col("lang_share")).alias("lead")
        ahead = self.shares().where("share > lang_share").select("lang", "source", "term", lead)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("lead"), "term")
        return ahead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def pair_distances(self) -> DataFrame:
        """(lang, source, other, distance) for every ordered pair of sources of a language.

        With all terms of source s against what other o has for a term it lacks, summed from
        s's histogram, X(s, o) + X(o, s) counts a term that both lack twice and the ones that
        both have wrongly; the first is corrected by a constant, the second in the stripes.
        """
        shares = self.shares()
        seen = shares.groupBy("lang", "source", "share").agg(
            F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("lacked_twice")
        )
        lacked = self.groups.select(
            "lang", "source", F.col("unseen").alias("share"),
            (F.col("terms") - F.col("own_terms")).alias("n"), F.col("terms").alias("lacked_twice"),
        )
        block = F.pmod(F.xxhash64("source"), F.lit(BLOCKS)).alias("block")
        histograms = seen.unionByName(lacked).select("*", block)
        others = self.groups.select(
            "lang", F.col("source").alias("other"), F.col("unseen").alias("other_unseen"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))).alias("block"),
        )
        gap = F.abs(F.col("share") - F.col("other_unseen"))
        twice = F.when(F.col("source") < F.col("other"), F.col("lacked_twice")).otherwise(F.lit(0))
        apart = (
            histograms.join(others, ["lang", "block"])
            .where("source <> other")
            .groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"))
            .agg(F.sum((F.col("n") - twice) * gap).alias("distance"))
        )
        both = apart.unionByName(meetings(shares))
        sums = both.groupBy("lang", "a", "b").agg(F.sum("distance").alias("distance"))
        sides = [F.struct(F.col(x).alias("source"), F.col(y).alias("other")) for x, y in ("ab", "ba")]
        return sums.select("lang", F.explode(F.array(*sides)).alias("side"), "distance").select("lang", "side.*", "distance")

    def report(self, most: int = LEADS) -> DataFrame:
        """(lang, source, part, item, value, rank): distances to all other sources, leading terms to ``most``."""
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = self.pair_distances().select(
            "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.col("distance").alias("value")
        )
        terms = self.term_leads(most).select(
            "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("lead").alias("value"), "rank"
        )
        return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def meetings(shares: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """(lang, a, b, distance): what pairs of sources that share a term change, added up inside the tasks.

    Each stripe gives |p - q| - |p - q0| - |p0 - q| + |p0 - q0| for each two of its sources,
    in blocks of bounded size; a task leaves with one sum per pair it met.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        whose: list[tuple[str, str]] = []
        keys, sums, waiting = [], [], 0

        def compress():
            key, value = np.concatenate(keys), np.concatenate(sums)
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            keys[:], sums[:] = [key[starts]], [np.add.reduceat(value, starts)]

        def leave():
            first, second = keys[0] >> 32, keys[0] & 0xFFFFFFFF
            columns = [[whose[i][0] for i in first], [whose[i][1] for i in first], [whose[i][1] for i in second]]
            out = [pa.array(c, pa.string()) for c in columns] + [pa.array(sums[0])]
            keys.clear(), sums.clear(), names.clear(), whose.clear()
            return pa.RecordBatch.from_arrays(out, names=["lang", "a", "b", "distance"])

        for batch in batches:
            for lang, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = []
                for entry in found:
                    name = (lang, entry["source"])
                    if name not in names:
                        names[name] = len(whose)
                        whose.append(name)
                    ids.append(names[name])
                ids = np.array(ids, dtype=np.int64)
                p = np.array([e["share"] for e in found], dtype=np.int64)
                p0 = np.array([e["unseen"] for e in found], dtype=np.int64)
                n = len(ids)
                step = max(1, held // n)
                for start in range(0, n, step):
                    i, j = np.nonzero(np.arange(n) > np.arange(start, min(start + step, n))[:, None])
                    i += start
                    change = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
                    keys.append(ids[i] << 32 | ids[j])  # sources come in order of name, so i is the lesser
                    sums.append(change)
                    waiting += len(i)
                    if waiting > 2 * held:
                        compress()
                        waiting = len(keys[0])
                        if waiting > held:
                            yield leave()
                            waiting = 0
                            names.update({(lang, e["source"]): k for k, e in enumerate(found)})
                            whose.extend((lang, e["source"]) for e in found)
                            ids = np.arange(n, dtype=np.int64)
        if waiting:
            compress()
            yield leave()

    entry = F.struct("source", "share", "unseen")
    stripes = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    stripes = stripes.where(F.size("found") > 1).select("lang", "found")
    return stripes.mapInArrow(task, "lang string, a string, b string, distance long")

"""Main text of HTML pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. A word's score is the log-odds, learned from
labelled pages, that a word below such open elements belongs to the main text; a tag's
score is negative and stronger the more the tag is found outside of it. A linear scan finds
the contiguous region of the largest sum. Inside the region, words whose own score is
negative (an advert or a form between two paragraphs) are left out.

Labelled pages are those with an ``article`` or ``main`` element: their words inside are
positive, all others negative. Counts are taken over all pages and hashed into a fixed
number of buckets; a fixed list of element and class names of page furniture adds prior
counts, so pages of unseen layout and tables without labelled pages work too. Names speak
only on parts of a page: not on ``body``, nor on what wraps the main element or most words.

Text of a block has its character references decoded and white space runs turned into one
space; blocks are joined in page order by one space. Inline tags leave no space.

Defined cases: null, empty and text-free pages give an empty text; unclosed elements end
with their parent, comments, scripts and styles that are not closed reach to the end of the
page; repeated rows are read each for itself; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
PRIOR = 25.0
SMOOTHING = 5.0
#: Bounds of a word's score and of what a tag takes away.
MOST = 4.0
#: What open elements can speak for a word; against it each may say up to MOST.
FEATURE_MOST = 2.0
TAG_LEAST, TAG_MOST = 0.2, 1.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|button)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")

# Elements of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul".split()
)
#: Containers that say nothing by themselves; only their names do.
_NEUTRAL = frozenset("html body div span section center table tbody tr td b i em strong font".split())
_MAIN = frozenset(["article", "main"])
# Names of page furniture.
_FURNITURE = frozenset(
    "head title nav footer aside form ad ads advert advertisement banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disclaimer dialog login menu modal newsletter notice pagination popup promo "
    "promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe "
    "tags toolbar widget".split()
)


#: Words that make a class name the state of a page, such as ``has-sidebar``, not the name of a part.
_STATES = frozenset("has have no not with without is hide show enabled disabled open opened closed active".split())
#: Elements that stay furniture whatever part of the page they hold.
_ALWAYS = frozenset("nav footer aside title".split())
#: From this share of a page's words on, an element is a wrapper unless it is furniture by its whole name.
WRAPPER = 0.5


class _Element:
    """An element with the words below it, the features it adds and those in force below it."""

    __slots__ = ("name", "parent", "parts", "furniture", "words", "main", "features", "context")

    def __init__(self, name: str, rest: str, parent: _Element | None):
        self.name, self.parent, self.words, self.main = name, parent, 0, False
        self.context: frozenset[str] = frozenset()
        self.parts: list[str] = []
        self.furniture = name in _ALWAYS
        for groups in _NAMES.findall(rest) if rest and name not in ("html", "body") else ():
            for token in "".join(groups).lower().split():
                parts = _PART.findall(token)
                if parts and _STATES.isdisjoint(parts):
                    self.parts += parts
                    self.furniture |= _FURNITURE.issuperset(parts)

    def ancestors(self) -> Iterator[_Element]:
        above = self.parent
        while above is not None:
            yield above
            above = above.parent


class Page:
    """Words and tags of a page in order, each with its innermost element, and what the elements are.

    The main elements are the outermost ``article`` and ``main`` that are neither named nor placed as
    furniture (an ``article`` of the class ``comment``); if all are, the largest, where it has most
    of the page's words. What holds a main element, or most words without being furniture by
    its whole name, is a wrapper and says nothing about the words below it.
    """

    def __init__(self, page: str):
        self.items: list[tuple[str, str, int, _Element | None]] = []
        self.elements: list[_Element] = []
        self.words = 0
        self._read(page)
        for element in reversed(self.elements):  # children come after their parents
            if element.parent is not None:
                element.parent.words += element.words
            else:
                self.words += element.words
        self._judge()

    def _read(self, page: str) -> None:
        open_: list[_Element] = []
        for token in _TOKEN.finditer(page):
            text, name = token["text"], token["name"]
            if text is not None:
                n = len(text.split())
                if open_:
                    open_[-1].words += n
                else:
                    self.words += n
                self.items.append(("text", text, n, open_[-1] if open_ else None))
            elif name is not None:
                name = name.lower()
                if token["end"]:
                    at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i].name == name), None)
                    if at is not None:
                        del open_[at:]
                else:
                    if name in _CLOSES_P or name == "li":
                        closed = "li" if name == "li" else "p"
                        for i in range(len(open_) - 1, -1, -1):
                            if open_[i].name == closed:
                                del open_[i:]
                                break
                            if open_[i].name not in _INLINE:
                                break
                    if name not in _VOID:
                        open_.append(_Element(name, token["rest"], open_[-1] if open_ else None))
                        self.elements.append(open_[-1])
                self.items.append(("tag", name, 0, open_[-1] if open_ else None))
            elif token["raw"]:
                self.items.append(("tag", token["raw"].lower(), 0, open_[-1] if open_ else None))

    def _judge(self) -> None:
        below_furniture, below_main = set(), set()
        clear, placed = [], []
        for element in self.elements:
            if element.parent in below_furniture or (element.furniture and element.name not in _MAIN):
                below_furniture.add(element)
            if element.parent in below_main:
                below_main.add(element)
            elif element.name in _MAIN:
                named = element.furniture and element.name == "article"
                if not named:
                    below_main.add(element)
                (placed if named or element in below_furniture else clear).append(element)
        mains = clear
        if not clear and placed:
            largest = max(placed, key=lambda element: element.words)
            mains = [largest] if largest.words >= WRAPPER * self.words else []
        wrappers = {above for element in mains for above in element.ancestors()}
        for element in self.elements:
            above = element.parent
            is_main = element in mains
            large = element.words >= WRAPPER * self.words and not element.furniture
            added = [] if element.name in _NEUTRAL else [element.name]
            if element in wrappers or (large and not is_main):
                added = [name for name in added if name not in _FURNITURE]
            elif not is_main:
                added += ["." + part for part in element.parts]
                if element.name in _MAIN and element.furniture:
                    added.remove(element.name)
            inside = above is not None and above.main
            if element.name == "header" and not inside and element not in wrappers:
                added.append("page-header")
            element.main = is_main or (inside and not (element.furniture and not large))
            element.features = tuple(added)
            element.context = (above.context if above is not None else frozenset()).union([element.features] if added else [])
        self.labelled = bool(mains)


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


_NO_CONTEXT: frozenset[tuple[str, ...]] = frozenset()


def count_page(page: str, words: np.ndarray, tags: np.ndarray) -> bool:
    """Add a labelled page's words and tags, inside and outside, to counts by bucket; False if not labelled."""
    if "<article" not in (low := page.lower()) and "<main" not in low:
        return False
    read = Page(page)
    if not read.labelled:
        return False
    below: Counter[tuple[frozenset, int]] = Counter()
    for kind, value, n, element in read.items:
        inside = int(element is not None and element.main)
        if kind == "tag":
            tags[_bucket(value), inside] += 1
        elif n:
            below[element.context if element is not None else _NO_CONTEXT, inside] += n
    for (context, inside), n in below.items():
        words[BUCKETS, inside] += n
        for feature in {f for features in context for f in features}:
            words[_bucket(feature), inside] += n
    return True


class Weights:
    """Scores of words by their open elements and of tags."""

    def __init__(self, words: np.ndarray, tags: np.ndarray):
        words, tags = words.astype(float), tags.astype(float)
        share = (words[BUCKETS] + PRIOR) / (words[BUCKETS] + PRIOR).sum()
        counts = words[:BUCKETS].copy()
        for name in _FURNITURE | {"page-header"}:
            for feature in (name, "." + name):
                counts[_bucket(feature), 0] += PRIOR
        smoothed = (counts + SMOOTHING * share) / share
        self.words = np.clip(np.log(smoothed[:, 1] / smoothed[:, 0]), -MOST, FEATURE_MOST)
        self.tags = -np.clip(np.log((tags[:, 0] + 1) / (tags[:, 1] + 1)), TAG_LEAST, TAG_MOST)
        self.tags[[_bucket(name) for name in _NEUTRAL]] = -TAG_LEAST
        self._known: dict[frozenset, float] = {}

    def word(self, context: frozenset[tuple[str, ...]]) -> float:
        """Score of a word below elements that add these features.

        Elements speak one by one, each at most ``FEATURE_MOST`` for a word and ``MOST`` against it,
        and all that speak for it together no more than one, so one that is clearly furniture decides.
        """
        if context not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            said = [
                float(np.clip(sum(self.words[_bucket(f)] for f in features), -MOST, FEATURE_MOST)) for features in context
            ]
            speaks_for = min(sum(x for x in said if x > 0), FEATURE_MOST)
            against = max(sum(x for x in said if x < 0), -MOST)
            self._known[context] = 1 + speaks_for + against
        return self._known[context]

    def tag(self, name: str) -> float:
        return float(self.tags[_bucket(name)])


def extract_text(page: str | None, weights: Weights) -> str:
    """The main text of one page."""
    scores: list[float] = []
    texts: list[str | None] = []
    for kind, value, n, element in Page(page or "").items:
        if kind == "tag":
            scores.append(weights.tag(value))
            texts.append(None if value not in _INLINE else "")
        else:
            score = weights.word(element.context if element is not None else _NO_CONTEXT)
            scores.append(score * n)
            texts.append(value if score > 0 else "" if n else value)
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, last = total, start, i + 1
    blocks, block = [], []
    for text in [*texts[first:last], None]:
        if text is None:
            blocks.append(" ".join(html.unescape("".join(block)).split()))
            block = []
        else:
            block.append(text)
    return " ".join(b for b in blocks if b)


def fit(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all labelled pages; at most BUCKETS rows reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((BUCKETS + 1, 2), dtype=np.int64)
        tags = np.zeros((BUCKETS, 2), dtype=np.int64)
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if page:
                    count_page(page, words, tags)
        counts = np.hstack([words, np.vstack([tags, np.zeros((1, 2), dtype=np.int64)])])
        used = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *[pa.array(counts[used, i]) for i in range(4)]],
            names=["bucket", "c0", "c1", "c2", "c3"],
        )

    columns = ["c0", "c1", "c2", "c3"]
    counted = pages.select(pages[html_col].cast("string")).mapInArrow(
        task, "bucket int, " + ", ".join(f"{c} long" for c in columns)
    )
    sums = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    words, tags = np.zeros((BUCKETS + 1, 2)), np.zeros((BUCKETS, 2))
    for row in sums:
        words[row["bucket"]] = row["c0"], row["c1"]
        if row["bucket"] < BUCKETS:
            tags[row["bucket"]] = row["c2"], row["c3"]
    return Weights(words, tags)


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text) per page."""
    weights = weights or fit(pages)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract_text(page, weights) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, type=pa.string())],
                    names=["page_id", "url", "text"],
                )

    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        pages["html"].cast("string").alias("html"),
    )
    return rows.mapInArrow(task, "page_id long, url string, text string")

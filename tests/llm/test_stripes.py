"""Source audit against a plain count of everything; spills, blocks and odd rows."""

import random
import re
from collections import Counter, defaultdict

from ridgeline.llm import stripes

SCHEMA = "doc_id long, text string, lang string, source string, term string, documents int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, most=50):
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(lowered(text or ""))
        groups.add((lang, source))
        documents[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            leads = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(leads)[:most])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def made(seed=3):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "c", "é", "zÜ", "Q") for b in ("x", "Y", "ñ", "")]
    rows = []
    for i in range(400):
        text = " ".join(r.choice(words[: r.randrange(1, 20)]) + r.choice(["", ".", "7", "-", "\x0b"]) for _ in range(r.randrange(40)))
        source = "big" if r.random() < 0.4 else r.choice(["s1", "s2", "Ä", "", None, "s3"])
        rows.append((i, text, r.choice(["en", "de", None]), source, "x", 1))
    rows += [(1, "Abx Abx", "en", "big", "x", 1)] * 5
    rows += [(None, None, "fr", "alone", "x", 1), (7, "", "en", "silent", "x", 1), (8, "12 34", "en", "digits", "x", 1)]
    rows.append((9, "longword " * 200_000 + "abx", "en", "long", "x", 1))
    return rows


def report(audit, **options):
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in audit.report(**options).select(*columns).collect())


def test_equals_plain_counts(spark):
    rows = made()
    want = brute(rows, 30)
    data = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert report(stripes.SourceAudit(data)) == want
    assert report(stripes.SourceAudit(data, held=8)) == want  # stripes leave after every few words
    assert report(stripes.SourceAudit(data, least=3), most=2) == brute(rows, 3, 2)


def test_few_held_pairs(spark):
    rows = made(5)
    shares = stripes.SourceAudit(spark.createDataFrame(rows, SCHEMA), least=2).shares().persist()
    sums = [
        sorted(map(tuple, stripes.meetings(shares, held).groupBy("lang", "a", "b").sum("distance").collect()))
        for held in (1 << 20, 3)
    ]
    assert sums[0] == sums[1] and sums[0]


def test_empty_and_nothing_kept(spark):
    data = spark.createDataFrame(made(), SCHEMA)
    assert report(stripes.SourceAudit(data.limit(0))) == []
    few = report(stripes.SourceAudit(data, least=10**6))
    assert few and all(part == "pair" and value == 0 for _, _, part, _, value, _ in few)

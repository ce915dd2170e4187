"""The audit against plain sums over every kept term."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from clauselake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least_docs, most):
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    docs = [(lang or "", source or "", TERM.findall(fold(text))) for text, lang, source in rows]
    groups = sorted({d[:2] for d in docs})
    out = set()
    for lang in {g[0] for g in groups}:
        mine = [d for d in docs if d[0] == lang]
        used = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in used.items() if n >= least_docs}
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            for t in terms:
                if t in kept:
                    counts["source", source][t] += 1
                    counts["lang", ""][t] += 1
        share = lambda g, t: 1 + 10**9 * (counts[g][t] + 1) // (sum(counts[g].values()) + len(kept))
        sources = [s for x, s in groups if x == lang]
        for a in sources:
            pairs, terms = [], []
            for b in sources:
                if a != b:
                    pairs.append((-sum((share(("source", a), t) - share(("source", b), t)) ** 2 // share(("source", b), t) for t in kept), b.encode()))
            for t in kept:
                p, q = share(("source", a), t), share(("lang", ""), t)
                if counts["source", a][t] and p > q:
                    terms.append((-((p - q) ** 2 // q), t.encode()))
            for part, found, last in (("pair", pairs, 10**9), ("term", terms, most)):
                out |= {(lang, a, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found), 1) if k <= last}
    return out


def made(seed):
    rng = random.Random(seed)
    words = ["Apple", "apple", "ÉTÉ", "été", "日本", "pear-tree", "x1y2z", "don't", "Zebra", "😀", "the", "The", "of", "ﬁne", "a\x00b"]
    rows = [(" ".join(rng.choice(words[: rng.randrange(3, 16)]) for _ in range(rng.randrange(30))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "é", None])) for _ in range(120)]
    return rows + [(None, "de", "a"), ("", "de", "b"), ("once only", "de", "c"), ("word " * 20_000, "en", "a")]


SCHEMA = "text string, lang string, source string"


def test_equals_sums_over_all_terms(spark):
    for seed, most in ((1, 200), (2, 3)):
        rows = made(seed)
        got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), most=most).collect()]
        assert len(got) == len(set(got))
        assert set(got) == plain(rows, 3, most)


def test_counts_in_portions(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS_HELD", 5)
    rows = made(3)[:40]
    found = divergence.term_counts(spark.createDataFrame(rows, SCHEMA))
    assert found.groupBy("lang", "source", "term").count().where("count > 1").count() == 0
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()} == plain(rows, 3, 200)


def test_large_counts_are_exact(spark):
    """Products of counts and the scale pass 64 bits."""
    df = spark.range(1).select(divergence.share(F.lit(5 * 10**12).cast("long"), F.lit(7 * 10**12).cast("long")).alias("p"), divergence.share(F.lit(0).cast("long"), F.lit(0).cast("long")).alias("none"))
    assert tuple(df.first()) == (1 + 10**9 * (5 * 10**12 + 1) // (7 * 10**12), 1 + 10**9)


def test_odd_rows_and_empty_table(spark, odd, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    clash = odd.withColumns({"term": F.lit("x"), "n": F.lit(0), "docs": F.lit(1), "item": F.lit("i"), "value": F.lit(2)})
    assert {tuple(r) for r in divergence.audit(clash, least_docs=1).collect()} == plain(rows, 1, 200)
    assert divergence.audit(no_docs).count() == 0

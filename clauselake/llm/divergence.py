"""Source divergence audit: how far each source's use of words is from its neighbours' and from its language's.

Each language keeps the terms that enough of its documents use. A group (a language's
rows of one source) and the language as a whole give every kept term a smoothed share,
also those that they never use. Sums over all kept terms are never taken term by term:
with f the price of a term, split by the supports of the two groups,

    sum f(a, b) = terms * f(0, 0)                                   both without the term
                + sum over a's terms of f(a, 0) - f(0, 0)           from a's histogram of counts
                + sum over b's terms of f(0, b) - f(0, 0)           from b's histogram of counts
                + sum over shared terms of f(a, b) - f(a, 0) - f(0, b) + f(0, 0)

so that only terms which both groups use are joined, by posting lists, and a term that
one of them uses costs a share of a histogram row. All arithmetic is on whole numbers.

At scale: words are counted before the shuffle; a hot source or language has as many rows
as it has terms. Posting lists have a row a source. Pairs of groups, which the result
lists anyway, are dealt by the second group's share, and the best terms of a group are
chosen within shares of its terms first.

Defined results: null text, language and source are empty ones; repeated rows count as
often as they occur; a group without a kept term has its pairs and no terms; a language
with no kept term has pairs of value 0; ties go by the item's bytes; an empty table gives
an empty result; texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.shared import written

#: Bytes of a text by what they are to a term: A-Z lower-cased, all other ASCII but letters between terms.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Terms of documents that a task adds up before it passes them on.
TERMS_HELD = 500_000
#: Shares add up to about this.
SCALE = 1_000_000_000
#: Groups are dealt into so many shares where all pairs of a language are priced, and terms where the best are chosen.
SHARES = 16


def share(count: Column, total: Column) -> Column:
    """Smoothed share of a count, exact: products may pass 64 bits."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), F.greatest(total, F.lit(1)).cast("decimal(20,0)"))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it). Tasks count what they read, a bounded number of terms at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        times: list[int] = []
        of: list[tuple[str, str, int]] = []  # group of so many words

        def told() -> Iterator[pa.RecordBatch]:
            groups = pa.table({"lang": pa.array([g[0] for g in of], pa.string()), "source": pa.array([g[1] for g in of], pa.string())})
            found = groups.take(pa.array(np.repeat(np.arange(len(of)), [g[2] for g in of])))
            found = found.append_column("term", pa.array(words, pa.binary()).cast(pa.string())).append_column("n", pa.array(times, pa.int64()))
            sums = found.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
            yield from sums.rename_columns(["lang", "source", "term", "n", "docs"]).to_batches()

        for batch in batches:
            for lang, source, text in zip(*batch.to_pydict().values(), strict=True):
                counts = Counter((text or "").encode().translate(FOLD).split())
                words += counts
                times += counts.values()
                of.append((lang or "", source or "", len(counts)))
                if len(words) >= TERMS_HELD:
                    yield from told()
                    words, times, of = [], [], []
        if words:
            yield from told()

    counted = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_postings(docs: DataFrame, least_docs: int) -> DataFrame:
    """Posting lists of the kept terms: lang, source, term, n, lang_n (the language's count), leads (one row a term)."""
    term = Window.partitionBy("lang", "term")
    rows = term_counts(docs).withColumns({"lang_n": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "leads": F.row_number().over(term.orderBy("source")) == 1})
    return rows.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "leads")


def groups_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Every group that occurs: lang, source, terms (kept in the language), total and lang_total (what its shares are of)."""
    found = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = postings.where("leads").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_size"))
    whole = found.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "terms", "lang_size"])
    return whole.select("lang", "source", "terms", (F.col("size") + F.col("terms")).alias("total"), (F.col("lang_size") + F.col("terms")).alias("lang_total"))


def divergences(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value: the sum of prices over all kept terms."""
    none = F.lit(0).cast("long")
    others = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"), F.pmod(F.xxhash64("source"), F.lit(SHARES)).alias("share"))
    dealt = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<bigint>"))
    zero, item_zero = share(none, F.col("total")), share(none, F.col("item_total"))

    pairs = groups.withColumn("share", dealt).join(others, ["lang", "share"]).where("source != item")
    constant = pairs.select("lang", "source", "item", (F.col("terms") * F.when(F.col("terms") > 0, price(zero, item_zero)).otherwise(0)).alias("value"))

    bars = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups, ["lang", "source"])
    bars = bars.select("lang", "source", "total", share(F.col("n"), F.col("total")).alias("p"), "times").withColumn("share", dealt)
    across = bars.join(others, ["lang", "share"]).where("source != item")
    ahead = across.select("lang", "source", "item", (F.col("times") * (price(F.col("p"), item_zero) - price(zero, item_zero))).alias("value"))
    behind = across.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * (price(item_zero, F.col("p")) - price(item_zero, zero))).alias("value"))

    shares = postings.join(groups, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("total")).alias("p"), zero.alias("p0"))
    second = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    overlap = shares.join(second, ["lang", "term"]).where("source != item").select("lang", "source", "item", (price(p, q) - price(p, q0) - price(p0, q) + price(p0, q0)).alias("value"))

    return constant.unionByName(ahead).unionByName(behind).unionByName(overlap).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def excess_terms(postings: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """The terms that each group uses more than its language, by price: lang, source, item, value, at most ``most`` a group."""
    p, q = share(F.col("n"), F.col("total")), share(F.col("lang_n"), F.col("lang_total"))
    rows = postings.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"), F.pmod(F.xxhash64("item"), F.lit(SHARES)).alias("share"))
    part = Window.partitionBy("lang", "source", "share").orderBy(F.desc("value"), "item")
    return rows.withColumn("place", F.row_number().over(part)).where(F.col("place") <= most).drop("place", "share")


def audit(docs: DataFrame, least_docs: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: all pairs of sources, and each group's first ``most`` terms."""
    postings = written(kept_postings(docs, least_docs), "postings")
    groups = written(groups_of(docs, postings), "groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = divergences(postings, groups).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = excess_terms(postings, groups, most).withColumn("rank", rank).where(F.col("rank") <= most).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")

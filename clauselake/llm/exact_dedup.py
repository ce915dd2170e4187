"""Exact dedup over an extendible-hash index that lies in shared files.

The index is built and asked with DataFrame operations alone:

1. every text is normalised (A-Z lower-cased, null read as empty) and hashed. The
   directory starts with one bucket and doubles: a bucket with more than
   ``bucket_entries`` different hashes is split by one more leading bit (``directory``);
2. each document finds its bucket by its slot of the directory and is inserted there.
   Copies are combined before they are shuffled, byte by byte of their texts, so a
   group of any size is a counter a task and never a list;
3. a bucket is a contiguous range of hashes and is written by the one task that owns
   it. Its entries that share a hash form a chain, told apart by their digests;
4. a lookup goes from the document's slot to the bucket and along the chain of its hash
   to the entry whose digest has the same 32 bytes (``probe``). Two different texts in a
   chain with one digest stop the build, so equal digests are equal texts.

A text that many documents share is a hot key of the lookup: its slot says into how
many shares its documents are dealt, and its bucket's chains go to each of them.

Defined results: null text counts as empty text. Rows with a null id are looked up
as well and are kept only if their group has no id at all. Repeated rows (same id,
same text) are each returned with the same values; of ties for the largest id
``deduplicated`` keeps one row. Very long texts are compared whole. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import ascii_lower, written

#: Doublings beyond the even depth; a bucket that is overfull even then is kept so.
SPARE_DEPTH = 4
MAX_DEPTH = 40
#: A text's documents are dealt into so many shares as it has of this many parts of all rows.
PARTS = 256
#: A directory of so many slots at most (40 bytes each) goes to every task; a larger one is joined.
BROADCAST_SLOTS = 100_000
#: Copies of a directory that is joined, so that a hot slot meets several.
SALTS = 64


class Index(NamedTuple):
    """``slots``: slot, depth, bucket, shares. ``chains``: bucket, depth, h, chain of (digest, keep_id, group_size), shares."""

    slots: DataFrame
    n_slots: int
    deepest: int
    chains: DataFrame


def normalised(text: Column) -> Column:
    """A-Z to lower case, null to empty. ``lower`` is the quick way where every character is one byte."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def _hashed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"), *more)
    return texts.withColumn("h", F.xxhash64("norm"))


def slot(h: Column, depth: Column | int) -> Column:
    """The leading ``depth`` bits of a 64-bit hash as a number from 0."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    bits = F.call_function("shiftrightunsigned", h, F.lit(64 - MAX_DEPTH))
    return F.call_function("shiftright", bits, F.lit(MAX_DEPTH) - depth)


def directory(hashes: DataFrame, deepest: int, rows: int, bucket_entries: int) -> DataFrame:
    """slot, depth, bucket, shares: for each slot of the deepest level, its bucket, that bucket's own depth, and the shares of its hottest text.

    ``hashes`` has a row a hash: h and the number of its rows. One pass counts hashes
    at the deepest level; the counts of the shallower levels are their sums. A bucket
    is the shallowest prefix that is not overfull.
    """
    slots = hashes.groupBy(slot(F.col("h"), deepest).alias("slot")).agg(F.count("*").alias("n"), F.max("rows").alias("hottest"))
    levels = slots.select("slot", "n", "hottest", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth")).withColumn(
        "prefix", F.call_function("shiftright", F.col("slot"), (F.lit(deepest) - F.col("depth")).cast("int"))
    )
    loads = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("load"))
    fits = (F.col("load") <= bucket_entries) | (F.col("depth") == deepest)
    found = levels.join(loads, ["depth", "prefix"]).groupBy("slot").agg(F.min(F.when(fits, F.col("depth"))).alias("depth"), F.first("hottest").alias("hottest"))
    spare = (F.lit(deepest) - F.col("depth")).cast("int")
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("slot"), spare), spare)
    return found.select("slot", "depth", bucket.alias("bucket"), F.ceil(F.col("hottest") * PARTS / rows).cast("int").alias("shares"))


def located(rows: DataFrame, slots: DataFrame, n_slots: int, deepest: int) -> DataFrame:
    """``rows`` (with h) beside the directory's entry of their slot. A hash whose slot is not in the directory has no row."""
    rows = rows.withColumn("slot", slot(F.col("h"), deepest))
    if n_slots <= BROADCAST_SLOTS:
        return rows.join(F.broadcast(slots), "slot")
    salted = slots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["slot", "salt"]).drop("salt")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 16_384) -> Index:
    """Write the index of ``docs``. ``keep_id`` of an entry is the largest id among its copies."""
    rows = _hashed(docs, id_col, text_col)
    hashes = written(rows.groupBy("h").agg(F.count("*").alias("rows")), "hashes")
    n, total = hashes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    deepest = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n / bucket_entries)))) + SPARE_DEPTH)
    slots = written(directory(hashes, deepest, max(total, 1), bucket_entries), "directory")
    n_slots = slots.count()

    placed = located(rows, slots, n_slots, deepest).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    entries = placed.groupBy("bucket", "depth", "h", "digest", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.max("shares").alias("shares")).drop("norm")
    chains = entries.groupBy("bucket", "depth", "h").agg(F.sort_array(F.collect_list(F.struct("digest", "keep_id", "group_size"))).alias("chain"), F.max("shares").alias("shares"))
    told_apart = F.size(F.array_distinct(F.transform("chain", lambda x: x["digest"]))) == F.size("chain")
    h = F.when(told_apart, F.col("h")).otherwise(F.raise_error(F.lit("two different texts share hash and digest")).cast("long"))
    owned = chains.withColumn("h", h).repartitionByRange(F.col("bucket")).sortWithinPartitions("bucket", "h")
    return Index(slots, n_slots, deepest, written(owned, "hash-index"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 16_384) -> DataFrame:
    """Write the index of ``docs`` and return its chains, one row a hash."""
    return build(docs, id_col, text_col, bucket_entries).chains


def _looked_up(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (id, norm, h, ...) beside keep_id, group_size and digest of their entry; those without one are left out."""
    share = F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share")
    placed = located(rows.withColumn("digest", F.unhex(F.sha2("norm", 256))), index.slots, index.n_slots, index.deepest)
    asked = placed.select("bucket", share, *[c for c in rows.columns if c != "norm"], "digest")
    chains = index.chains.select("bucket", "h", "chain", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    met = asked.join(chains, ["bucket", "h", "share"])
    entry = F.try_element_at(F.filter("chain", lambda x: x["digest"] == F.col("digest")), F.lit(1))
    return met.withColumn("entry", entry).where("entry is not null").select("*", "entry.keep_id", "entry.group_size")


def probe(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document whose text is in the index: id, keep_id, group_size, kept, text_sha256."""
    found = _looked_up(_hashed(docs, id_col, text_col), index)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 16_384) -> DataFrame:
    """Group ``docs`` by normalised text; of each group the row with the largest id stays."""
    return probe(docs, build(docs, id_col, text_col, bucket_entries), id_col, text_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 16_384) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows (same id and text) stay once."""
    index = build(docs, id_col, text_col, bucket_entries)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = _looked_up(_hashed(docs, id_col, text_col, whole), index).where(F.col("id").eqNullSafe(F.col("keep_id")))
    return found.dropDuplicates(["h", "digest"]).select("row.*")

"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct word shingles. Two documents are linked if the
shared part of their sets is at least ``percent`` of their union.

1. Documents with equal sets form a class; all that follows is about classes, each
   standing for its smallest id.
2. A signature has 60 MinHash symbols of 16 bits. Its distance to another is the
   number of symbols that differ. It is split into 12 chunks of 5 symbols. Two
   signatures at a distance of at most 12 * 2 - 1 = 23 have, by the pigeonhole
   principle, a chunk with at most one error. The allowed errors are enumerated: each
   chunk gives 5 keys, each leaving one symbol out, so both have a key in common.
   At a similarity of 0.8, a share of 1 - 1e-7 of all pairs has such a key.
3. Classes that share a key are compared by two bits of each symbol, by set size and
   by parities: the shingles fall into 1,024 bins, and two sets differ in at least as
   many shingles as bins in which one has an odd and the other an even number. Then
   they are compared by their full sets, which are made from the texts again.

Pairs are not listed within a key; see ``grouping.linked``. Where a key still holds
many unlinked classes, as those that share a long passage do, they are joined by the
least used shingles of their sets instead: any two that can be linked share one (``_rare``).

Defined results: null and empty texts have no shingles and are linked with nothing;
a text of fewer words than a shingle is one shingle. A row with a null id is reported
under the smallest id of its class and never stands for it, unless no row of the
class has an id. Repeated rows are each returned. Texts that share an id are each
compared. Ids are whole numbers; a tie for the smallest is one id. Very long texts are
read whole, one at a time. Other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.grouping import confirmed, linked, texts_of
from clauselake.llm.shared import held_by_worker, slices, written

CHUNKS, CHUNK_SYMBOLS, ERRORS = 12, 5, 1
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Symbols whose two low bits may differ: 9 are expected at 0.8, with a deviation of 2.8.
SKETCH_DISTANCE = 24
#: Bins of the parities, as a power of two, and the columns of 64 bits that hold them.
BIN_BITS = 10
PARITIES = [f"odd{k}" for k in range((1 << BIN_BITS) // 64)]

#: Bins in which uses of shingles are counted, and slices in which they are added up.
USE_BINS, USE_SLICES = 1 << 16, 16

_RANDOM = np.random.default_rng(20240607)
_MULTIPLY = _RANDOM.integers(1, 2**63, (SYMBOLS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 2**63, (SYMBOLS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEYS = _RANDOM.integers(1, 2**63, (CHUNKS, CHUNK_SYMBOLS, CHUNK_SYMBOLS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEYS[:, np.arange(CHUNK_SYMBOLS), np.arange(CHUNK_SYMBOLS)] = 0  # the symbol left out
_KEY_ADD = _RANDOM.integers(1, 2**63, (CHUNKS, CHUNK_SYMBOLS), dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the 64 (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xCF1BBCDCB7A56463)
    return x ^ (x >> np.uint64(29))


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; A-Z count as lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(held_by_worker("words", _WordHashes).__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    rolled = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + h[k : len(h) - width + 1 + k]
    return np.unique(_mixed(rolled))


def signature(shingles: np.ndarray) -> np.ndarray:
    """60 symbols of 16 bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[None, at : at + 2048] * _MULTIPLY + _ADD).min(axis=1))
    return _mixed(least) >> np.uint64(48)


def _prints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, set_a, set_b (hashes of the whole set), low and high (two bits of each symbol), parities, keys."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            signatures = np.array([signature(s) for s in sets], np.uint64).reshape(-1, SYMBOLS)
            chunks = signatures.reshape(-1, CHUNKS, 1, CHUNK_SYMBOLS)
            keys = _mixed((chunks * _KEYS).sum(axis=3, dtype=np.uint64) + _KEY_ADD).reshape(-1, SYMBOLS).view(np.int64)
            bits = np.uint64(1) << np.arange(SYMBOLS, dtype=np.uint64)
            low = ((signatures & np.uint64(1)) * bits).sum(axis=1, dtype=np.uint64).view(np.int64)
            high = ((signatures >> np.uint64(1) & np.uint64(1)) * bits).sum(axis=1, dtype=np.uint64).view(np.int64)
            odd = np.array([np.packbits(np.bincount(s >> np.uint64(64 - BIN_BITS), minlength=1 << BIN_BITS) & 1) for s in sets], np.uint8).reshape(len(sets), -1).view(np.int64)
            whole = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([(w >> 64) - 2**63 for w in whole], pa.int64()),
                    pa.array([(w & (2**64 - 1)) - 2**63 for w in whole], pa.int64()),
                    pa.array(low),
                    pa.array(high),
                    *(pa.array(odd[:, k]) for k in range(len(PARITIES))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SYMBOLS), pa.array(keys.ravel())),
                ],
                names=["id", "n", "set_a", "set_b", "low", "high", *PARITIES, "keys"],
            )

    return rows.mapInArrow(run, "id long, n long, set_a long, set_b long, low long, high long, " + "".join(f"{p} long, " for p in PARITIES) + "keys array<long>")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Signature bits, sizes and parities allow a link. Sizes and parities rule out none that is there."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    several_texts = (F.col(f"texts_{a}") > 1) | (F.col(f"texts_{b}") > 1)
    differ = F.col(f"low_{a}").bitwiseXOR(F.col(f"low_{b}")).bitwiseOR(F.col(f"high_{a}").bitwiseXOR(F.col(f"high_{b}")))
    apart = sum((F.bit_count(F.col(f"{p}_{a}").bitwiseXOR(F.col(f"{p}_{b}"))) for p in PARITIES), F.lit(0))
    near_sets = (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * apart <= (100 - percent) * (n_a + n_b))
    return several_texts | ((F.bit_count(differ) <= SKETCH_DISTANCE) & near_sets)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The shared part of two sets is ``percent`` of their union or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0 or 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int(np.count_nonzero(b[at] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _uses(texts: DataFrame, width: int) -> np.ndarray:
    """How many sets of ``texts`` (text) have shingles in each of ``USE_BINS`` bins. Tasks send slices of their sums, which tasks add up; the driver gets the bins."""
    size = USE_BINS // USE_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(USE_BINS, np.int64)
        for batch in slices(batches, 50):
            for text in batch.column(0).to_pylist():
                total += np.bincount(use_bin(shingle_set(text, width)), minlength=USE_BINS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(USE_SLICES), pa.int32()), pa.array([total[k * size : k * size + size].tobytes() for k in range(USE_SLICES)])], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()])], names=["slice", "counts"])

    found = texts.mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(add, "slice int, counts binary")
    uses = np.zeros(USE_BINS, np.int64)
    for k, counts in found.collect():  # a row a slice
        uses[k * size : k * size + size] = np.frombuffer(counts, np.int64)
    return uses


def use_bin(shingles: np.ndarray) -> np.ndarray:
    return (_mixed(shingles) % np.uint64(USE_BINS)).astype(np.int64)


def least_used(shingles: np.ndarray, uses: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set that stay after its ``percent`` most used ones, in one order for all sets: by uses of their bin, then by hash."""
    n = len(shingles) * (100 - percent) // 100 + 1
    return shingles[np.lexsort((shingles, uses[use_bin(shingles)]))[:n]]


def _rare(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """node and key: shingles by which two linked nodes must meet, the least used of each set.

    Two sets of which ``percent`` of the union is shared have a shingle in common among
    those that remain of each after its ``percent`` last ones, in any order that is the same
    for all. Uses are counted among ``nodes`` by bins of shingles, so that what is
    common to many comes last; only what remains becomes a row, and a shingle of one
    node alone is no key.
    """
    rows = written(texts.join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), "heavy-texts")
    uses = _uses(rows.select("text"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            kept = [least_used(shingle_set(text, width), uses, percent) for text in batch.column(1).to_pylist()]
            node = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(k) for k in kept])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(kept).view(np.int64))], names=["node", "key"])

    keys = written(rows.select("id", "text").mapInArrow(run, "node long, key long").distinct(), "rare-shingles")
    several = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-rare-shingles")
    return keys.join(several, "key").select("node", "key")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cross_budget: int = 16) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links), kept (the id is its component's)."""
    prints = written(_prints(docs, width, id_col, text_col), "prints")
    # All but the id follows from the set.
    alike = [F.first(c).alias(c) for c in ("n", "low", "high", *PARITIES, "keys")]
    classes = written(prints.where("n > 0").groupBy("set_a", "set_b").agg(F.min("id").alias("node"), *alike), "classes").where("node is not null")
    sketches = written(classes.groupBy("node").agg(F.max("n").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"), *[F.max(p).alias(p) for p in PARITIES], F.count("*").alias("texts")), "sketches")
    # An id with several texts passes every comparison of sketches and meets the sets.
    labels = linked(
        classes.select("node", F.explode("keys").alias("key")),
        sketches,
        lambda a, b: _may_link(a, b, percent),
        lambda pairs, texts: confirmed(pairs, texts, lambda text: shingle_set(text, width), lambda x, y: _alike(x, y, percent)),
        lambda nodes: texts_of(nodes, docs, id_col, text_col),
        lambda nodes, texts: _rare(nodes, texts, width, percent),
        cross_budget,
    )

    standing = classes.select("set_a", "set_b", "node")
    rooted = standing.join(labels.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("set_a", "set_b", F.coalesce("root", "node").alias("component"))
    return (
        prints.select("id", F.col("n").alias("n_shingles"), "set_a", "set_b")
        .join(rooted, ["set_a", "set_b"], "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id stands for its group, with all their columns. Without an id, rows stay if nothing with an id is in their group."""
    kept = near_dedup(docs, id_col=id_col, **options).where("kept").select(F.col(f"`{id_col}`").alias("keep")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("keep"))).select("row.*")

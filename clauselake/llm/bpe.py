"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The parts of a pre-token form a linked list. Every pair of neighbours that the rank
file can merge stands in the bucket of its rank, which holds list positions. A bitmap
of several levels marks the buckets that are not empty: the next rank to merge is
found by find-first-set from the top level down. Positions whose pair has changed
since are stale and skipped when they come up. A merge touches two pairs, so a
pre-token of n bytes takes O(n log n), however long it is. The pre-tokens that a batch
of texts needs share one queue, so a bucket serves all of them at once.

Texts are cut at spaces where the pattern cuts too, so pieces are encoded once each
and remembered. The memory is bounded: the newest ``remembered`` pieces and the
generation before them.

Defined results: a null text is read as empty and has no tokens. Repeated rows are
each returned; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import held_by_worker, no_cycles

#: Bits of a word of the bitmap: two levels reach 65,536 ranks, three reach 16 million.
WORD_BITS, WORD_SHIFT, WORD_MASK = 256, 8, 255
#: A space after white space: such texts are cut by the pattern alone.
SPACE_RUN = re.compile(r"\s ")
#: Longer pieces are encoded each time.
REMEMBERED_CHARS = 64
#: Rows whose ids are held at once.
ROWS = 1000
#: Characters of texts that are cut at once. What is made of them, and new pieces over what is remembered, are in a worker's memory together.
CHARS = 300_000


class RankQueue:
    """Buckets of positions by rank. A hierarchical bitmap marks those that are not empty."""

    __slots__ = ("buckets", "levels")

    def __init__(self, n_ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        while True:
            n_ranks = (n_ranks + WORD_BITS - 1) // WORD_BITS
            self.levels.append([0] * n_ranks)
            if n_ranks <= 1:
                break

    def open(self, rank: int, positions: list[int]) -> None:
        """Add a bucket for a rank that has none."""
        self.buckets[rank] = positions
        for level in self.levels:
            at = rank >> WORD_SHIFT
            word = level[at]
            level[at] = word | (1 << (rank & WORD_MASK))
            if word:
                break
            rank = at

    def take(self) -> tuple[int, list[int]] | None:
        """The bucket of the least rank, which leaves the queue."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return None
            rank = rank << WORD_SHIFT | (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            word = level[at >> WORD_SHIFT] = level[at >> WORD_SHIFT] ^ (1 << (at & WORD_MASK))
            if word:
                break
            at >>= WORD_SHIFT
        return rank, self.buckets.pop(rank)


class Memory:
    """Values of pieces of text: the newest ``most`` and the generation before."""

    def __init__(self, make: Callable[[list[str]], list], most: int) -> None:
        self.make, self.most = make, most
        self.known: dict = {}
        self.old: dict = {}
        self.long: list[str] = []

    def look_up(self, lists: list[list[str]]) -> dict:
        """The value of each piece in the lists, and of others. Those not known are made in one call."""
        self.values([*set(chain.from_iterable(lists))])
        return self.known

    def values(self, different: list[str]) -> list:
        """The value of each piece; no piece stands twice. Those not known are made in one call."""
        for p in self.long:
            del self.known[p]
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        values = [*map(self.known.get, different)]
        missing = [i for i, v in enumerate(values) if v is None]
        unknown: list[str] = []
        places: list[int] = []
        for i in missing:
            if (v := self.old.get(p := different[i])) is None:
                unknown.append(p)
                places.append(i)
            else:
                self.known[p] = values[i] = v
        made = self.make(unknown)
        self.known.update(zip(unknown, made, strict=True))
        for i, v in zip(places, made, strict=True):
            values[i] = v
        self.long = [p for p in unknown if len(p) > REMEMBERED_CHARS]
        return values

    def joined(self, texts: list[str]) -> list[bytes]:
        """The values (ids of four bytes each) of the pieces of each text, one after another; texts can be cut at spaces.

        A piece that stands often in the texts is looked up once; words are told apart and put in line by arrays.
        """
        if not texts:
            return []
        pieces = pc.split_pattern(pa.array(["\0" + t for t in texts], pa.large_string()), " ")
        return self.in_line(pieces.flatten(), pieces.offsets.to_numpy())

    def in_line(self, pieces: pa.Array, cuts: np.ndarray) -> list[bytes]:
        """The values of the pieces from each cut to the next, one after another."""
        words = pc.dictionary_encode(pieces)
        values = self.values(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        starts = np.cumsum(lengths) - lengths
        of = words.indices.to_numpy()
        n = lengths[of]
        ends = np.cumsum(n)
        places = np.repeat(starts[of] - (ends - n), n)
        places += np.arange(len(places))
        data = np.frombuffer(b"".join(values), "<u4")[places].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[cuts]).tolist()
        return [data[a:b] for a, b in pairwise(cuts)]


def in_portions(texts: list, encode: Callable[[list], list], chars: int = 1_000_000) -> list:
    """``encode`` over texts (or lists of ids), about ``chars`` characters at once."""
    out: list = []
    held: list = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            out += encode(held)
            held, size = [], 0
    return out + encode(held)


def cuts_at_spaces(text: str) -> bool:
    """Whether ``text`` can be cut into the words between its spaces; otherwise it must be matched whole.

    A space that follows another character than white space begins a match of the
    pattern, whatever surrounds it. So a text without a space in a run of white space
    can be cut before every space. The first piece, which has no space before it, is
    marked by a null character; texts that have one are left whole.
    """
    return not SPACE_RUN.search(text) and "\0" not in text


def piece_text(piece: str) -> str:
    """The text that a piece of ``Memory.joined`` stands for."""
    return piece[1:] if piece[:1] == "\0" else " " + piece


class Table:
    """Byte strings by id, looked up for many ids at once."""

    def __init__(self, strings: dict[int, bytes]) -> None:
        self.lengths = np.zeros(max(strings, default=-1) + 1, np.int64)
        self.lengths[list(strings)] = [len(x) for x in strings.values()]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(strings[i] for i in sorted(strings)), np.uint8)

    def joined(self, lists: list[np.ndarray]) -> list[memoryview]:
        """The strings of each list of ids one after another."""
        ids = np.concatenate([*lists, np.zeros(0, np.uint32)])
        n = self.lengths[ids]
        ends = np.cumsum(n)
        places = np.repeat(self.starts[ids] - (ends - n), n)
        places += np.arange(len(places))
        data = memoryview(self.bytes[places])
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, lists)])].tolist()
        return [data[a:b] for a, b in pairwise(cuts)]


class ByteBpe:
    """Encoder and decoder of one rank file and pattern. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 200_000) -> None:
        self.ranks = ranks
        tokens = {i: t for t, i in ranks.items()}
        self.tokens, self.decimals = Table(tokens), Table({i: b"%d " % i for i in tokens})
        self.packed = {t: struct.pack("<I", i) for t, i in ranks.items()}
        self.bytes = [bytes([b]) for b in range(256)]
        self.byte_pairs = np.array([ranks.get(a + b, -1) for a in self.bytes for b in self.bytes])
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.of_tokens = Memory(lambda tokens: self.merge([t.encode("utf-8", "surrogatepass") for t in tokens]), remembered)
        self.of_pieces = Memory(lambda pieces: self._matched([piece_text(p) for p in pieces]), remembered)

    def merge(self, pre_tokens: list[bytes]) -> list[bytes]:
        """Token ids of each pre-token. All share one queue; no pair reaches from one to the next."""
        packed, rank_of, queue = self.packed, self.ranks.get, self.queue
        buckets, open_bucket = queue.buckets, queue.open
        out = [packed.get(t, b"") for t in pre_tokens]
        wanted = [at for at, ids in enumerate(out) if not ids and pre_tokens[at]]
        if not wanted:
            return out
        data = np.frombuffer(b"".join([pre_tokens[at] for at in wanted]), np.uint8)
        ends = np.cumsum([len(pre_tokens[at]) for at in wanted])
        starts = [0, *ends[:-1].tolist()]
        first = np.full(len(data), -1, np.int64)
        first[:-1] = self.byte_pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
        first[ends - 1] = -1
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[places], prepend=-1, append=-1)).tolist() if len(places) else []
        for x, y in pairwise(cuts):
            open_bucket(int(first[places[x]]), places[x:y].tolist())
        part = [*map(self.bytes.__getitem__, data.tolist())]
        pair_rank = first.tolist()
        links = np.arange(len(data))
        links[ends - 1] = -2
        after = (links + 1).tolist()
        links = np.arange(len(data)) - 1
        links[starts] = -1
        before = links.tolist()
        while found := queue.take():
            rank, positions = found
            positions.sort()
            left = iter(positions)
            for i in left:
                if pair_rank[i] != rank:
                    continue  # stale
                j = after[i]
                both = part[i] = part[i] + part[j]
                pair_rank[j] = -1
                after[i] = k2 = after[j]
                least = rank + 1
                if k2 >= 0:
                    before[k2] = i
                    pair_rank[i] = r = rank_of(both + part[k2], -1)
                    if r >= 0:
                        if (bucket := buckets.get(r)) is not None:
                            bucket.append(i)
                        else:
                            open_bucket(r, [i])
                        least = r
                else:
                    pair_rank[i] = -1
                if (h := before[i]) >= 0:
                    pair_rank[h] = r = rank_of(part[h] + both, -1)
                    if r >= 0:
                        if (bucket := buckets.get(r)) is not None:
                            bucket.append(h)
                        else:
                            open_bucket(r, [h])
                        if r < least:
                            least = r
                if least <= rank:  # a pair that comes before the rest of this bucket
                    rest = [*left]
                    if least == rank:
                        buckets[rank] += rest
                    elif rest:
                        open_bucket(rank, rest) if rank not in buckets else buckets[rank].extend(rest)
                    break
        for at, i in zip(wanted, starts, strict=True):
            ids = []
            while i >= 0:
                ids.append(packed[part[i]])
                i = after[i]
            out[at] = b"".join(ids)
        return out

    def _matched(self, texts: list[str]) -> list[bytes]:
        found = [self.pattern.findall(t) for t in texts]
        get = self.of_tokens.look_up(found).__getitem__
        return [b"".join(map(get, tokens)) for tokens in found]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as arrays."""
        with no_cycles():
            return in_portions(texts, self._ids, CHARS)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        return [x.tolist() for x in self.ids(texts)]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [cuts_at_spaces(t) for t in texts]
        whole = iter(self._matched([t for t, c in zip(texts, cuts, strict=True) if not c]))
        joined = iter(self.of_pieces.joined([t for t, c in zip(texts, cuts, strict=True) if c]))
        return [np.frombuffer(next(joined if c else whole), "<u4") for c in cuts]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that a list of ids stands for."""
        return bytes(self.tokens.joined([np.array(ids, np.uint32)])[0])


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """The rank file as Spark reads it, from any store: a token in base64 and its rank on each line."""
    lines = spark.read.text(path).collect()  # one row a token of the vocabulary
    return {base64.b64decode(a): int(b) for a, b in (r[0].split() for r in lines if r[0].strip())}


class Vocabulary:
    """Ranks and pattern as they go to tasks: a broadcast of the rank file's size."""

    def __init__(self, spark, path: str, pattern: str, remembered: int = 200_000) -> None:
        self.ranks = spark.sparkContext.broadcast(read_ranks(spark, path))
        self.pattern, self.remembered, self.key = pattern, remembered, uuid.uuid4().hex

    def coder(self) -> ByteBpe:
        return held_by_worker(("bpe", self.key), lambda: ByteBpe(self.ranks.value, self.pattern, self.remembered))


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and token_ids (array<int>) of every document."""

    def rows(coder: ByteBpe, texts: list[str | None]) -> list[pa.Array]:
        return [_lists(coder.ids([t or "" for t in texts]))]

    return _mapped(docs, vocabulary, id_col, text_col, "token_ids array<int>", rows)


def decode(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id and bytes (binary) of every row; null ids are read as none."""

    def rows(coder: ByteBpe, ids: list[list[int] | None]) -> list[pa.Array]:
        return [pa.array(in_portions([np.array(x or [], np.uint32) for x in ids], coder.tokens.joined, 200_000), pa.binary())]

    return _mapped(tokens, vocabulary, id_col, ids_col, "bytes binary", rows)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of the bytes decoded from them; token_ids if asked for.

    Encoding and decoding run in one task, so the ids need not leave it.
    """

    def rows(coder: ByteBpe, texts: list[str | None]) -> list[pa.Array]:
        found = coder.ids([t or "" for t in texts])

        def digests(lists: list[np.ndarray]) -> list[tuple[str, str]]:
            return [(hashlib.sha256(line[:-1]).hexdigest(), hashlib.sha256(data).hexdigest()) for line, data in zip(coder.decimals.joined(lists), coder.tokens.joined(lists), strict=True)]

        made = in_portions(found, digests, 200_000)
        more = [_lists(found)] if with_ids else []
        return [pa.array([len(ids) for ids in found], pa.int64()), *(pa.array([x[k] for x in made], pa.string()) for k in range(2)), *more]

    return _mapped(docs, vocabulary, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids, rows)


def _mapped(df: DataFrame, vocabulary: Vocabulary, id_col: str, value_col: str, out: str, rows: Callable[[ByteBpe, list], list[pa.Array]]) -> DataFrame:
    taken = df.select(F.col(id_col).alias("__id"), F.col(value_col).alias("__value"))
    id_type = taken.schema["__id"].dataType.simpleString()
    names = [id_col, *(part.split()[0] for part in out.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *rows(coder, part.column(1).to_pylist())], names=names)

    return taken.mapInArrow(run, f"`{id_col}` {id_type}, {out}")

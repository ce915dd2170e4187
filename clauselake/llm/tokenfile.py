"""Token ids in binary shard files: a wavelet matrix per shard.

Documents are range-partitioned by id, so that shards follow each other in ascending
order; each task encodes its texts and writes shard files into the shared folder.

Layout of a shard file (little-endian):

* magic ``CLWM0001``, then the lengths of the header and of its compressed form (two
  uint32) and the header as zstd-compressed JSON: numbers of documents, tokens, bit
  planes and bits a block, and where each section lies;
* document ids and numbers of tokens, zstd-compressed;
* for each bit plane from the highest: its bits in blocks of 65,536, each block
  zstd-compressed on its own, and the number of ones before each block.

Plane k holds bit k of every token, the tokens standing as the planes above have
sorted them: zeros first, both parts in their order. So a token's bits are followed
down the planes with rank alone (``access``), a token's range is narrowed the same
way (``count``), and a place in that range is followed up with select
(``occurrence``). Each needs a block or two of each plane.

Defined results: a null text is empty and holds the end id alone. Ids are whole numbers;
rows with a null id come first and come back without one. Repeated rows are each
written, ties in the order of their text's hash. A text longer than a shard makes a
longer shard; no text is cut. An empty table writes no shard. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.bpe import Memory, in_portions
from clauselake.llm.shared import fresh_path, held_by_worker, no_cycles, portions, written

MAGIC = b"CLWM0001"
BLOCK_BITS = 65_536
#: Characters of texts that are cut at once: the more, the fewer different words are looked up for each.
CHARS = 4_000_000


def build(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """A shard file. ``ids`` and ``lengths`` (uint32) a document; ``tokens`` unsigned."""
    pack = zstandard.ZstdCompressor(level=1).compress
    n_planes = max(1, int(tokens.max(initial=0)).bit_length())
    tokens = tokens.astype(np.uint16 if n_planes <= 16 else np.uint32)
    body: list[bytes] = []
    at = 0

    def section(data: bytes) -> tuple[int, int]:
        nonlocal at
        body.append(data)
        at += len(data)
        return at - len(data), len(data)

    header: dict = {"docs": len(ids), "tokens": len(tokens), "planes": n_planes, "block": BLOCK_BITS}
    header["ids"] = section(pack(np.array([i or 0 for i in ids], "<i8").tobytes()))
    header["null_ids"] = [k for k, i in enumerate(ids) if i is None]
    header["lengths"] = section(pack(lengths.astype("<u4").tobytes()))
    header["bits"] = []
    for k in range(n_planes - 1, -1, -1):
        ones = (tokens & tokens.dtype.type(1 << k)) != 0
        blocks, before, seen = [], [], 0
        for start in range(0, len(ones), BLOCK_BITS):
            part = ones[start : start + BLOCK_BITS]
            before.append(seen)
            seen += int(np.count_nonzero(part))
            blocks.append(section(pack(np.packbits(part).tobytes())))
        header["bits"].append({"zeros": len(ones) - seen, "blocks": blocks, "ones_before": before})
        tokens = np.concatenate([tokens.take(np.flatnonzero(~ones)), tokens.take(np.flatnonzero(ones))])
    text = json.dumps(header).encode()
    small = pack(text)
    return MAGIC + np.array([len(text), len(small)], "<u4").tobytes() + small + b"".join(body)


class Shard:
    """One shard file: token access, counts and places without decoding the rest."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        size, packed = np.frombuffer(data[8:16], "<u4")
        self._unpack = zstandard.ZstdDecompressor()
        self._body = memoryview(data)[16 + int(packed) :]
        self.head = json.loads(self._unpack.decompress(bytes(data[16 : 16 + int(packed)]), max_output_size=int(size)))
        self.ids: list[int | None] = np.frombuffer(self._section(self.head["ids"], 8 * self.head["docs"]), "<i8").tolist()
        for k in self.head["null_ids"]:
            self.ids[k] = None
        self.lengths = np.frombuffer(self._section(self.head["lengths"], 4 * self.head["docs"]), "<u4")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        self.n_tokens, self.n_planes = self.head["tokens"], self.head["planes"]
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    def _section(self, place: list[int], size: int) -> bytes:
        return self._unpack.decompress(bytes(self._body[place[0] : place[0] + place[1]]), max_output_size=max(1, size))

    def _block(self, plane: int, block: int) -> np.ndarray:
        found = self._blocks.get((plane, block))
        if found is None:
            n = min(BLOCK_BITS, self.n_tokens - block * BLOCK_BITS)
            packed = self._section(self.head["bits"][plane]["blocks"][block], (n + 7) // 8)
            found = self._blocks[plane, block] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n)
        return found

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        if i >= self.n_tokens:
            return self.n_tokens - self.head["bits"][plane]["zeros"]
        block, rest = divmod(i, BLOCK_BITS)
        return self.head["bits"][plane]["ones_before"][block] + int(np.count_nonzero(self._block(plane, block)[:rest]))

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) ``bit`` of a plane."""
        ones = np.array(self.head["bits"][plane]["ones_before"])
        before = ones if bit else np.arange(len(ones)) * BLOCK_BITS - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        token = 0
        for plane in range(self.n_planes):
            block, rest = divmod(i, BLOCK_BITS)
            bit = int(self._block(plane, block)[rest])
            ones = self._rank1(plane, i)
            i = self.head["bits"][plane]["zeros"] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for plane in range(self.n_planes):
            a, b = self._rank1(plane, start), self._rank1(plane, end)
            if token >> (self.n_planes - 1 - plane) & 1:
                start, end = self.head["bits"][plane]["zeros"] + a, self.head["bits"][plane]["zeros"] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often ``token`` stands in places ``start`` to ``end``."""
        if token >> self.n_planes:
            return 0
        a, b = self._range(token, start, self.n_tokens if end is None else end)
        return b - a

    def occurrence(self, token: int, k: int) -> int | None:
        """Place of the ``k``-th (from 0) ``token``; None if there are fewer."""
        if token >> self.n_planes:
            return None
        a, b = self._range(token, 0, self.n_tokens)
        if not 0 <= k < b - a:
            return None
        i = a + k
        for plane in range(self.n_planes - 1, -1, -1):
            bit = token >> (self.n_planes - 1 - plane) & 1
            i = self._select(plane, bit, i - self.head["bits"][plane]["zeros"] if bit else i)
        return i

    def all_tokens(self) -> np.ndarray:
        """Every token in order, from the lowest plane up: each plane undoes its own sorting."""
        kind = np.uint16 if self.n_planes <= 16 else np.uint32
        tokens = np.zeros(self.n_tokens, kind)
        for plane in range(self.n_planes - 1, -1, -1):
            ones = np.concatenate([self._block(plane, b) for b in range(len(self.head["bits"][plane]["blocks"]))] or [np.zeros(0, np.uint8)]).astype(bool)
            for b in range(len(self.head["bits"][plane]["blocks"])):
                self._blocks.pop((plane, b), None)
            zeros = self.head["bits"][plane]["zeros"]
            up = np.empty_like(tokens)
            up[np.flatnonzero(~ones)] = tokens[:zeros]
            up[np.flatnonzero(ones)] = tokens[zeros:] | kind(1 << (self.n_planes - 1 - plane))
            tokens = up
        return tokens


#: ASCII white space, letters, and characters that the pattern takes for none of white space, letters and digits.
SPACES, LETTERS, MARKS = (np.array([bool(re.match(kind, chr(b))) for b in range(128)] + [False] * 128) for kind in ("[\\x09-\\x0D ]", "[A-Za-z]", "[!-/:-@[-`{-~]"))
#: Control characters that only some count as white space, and white space beyond ASCII beside other white space.
ODD_SPACE = r"[\x1c-\x1f]|[\x09-\x0D ]{0}|{0}[\x09-\x0D ]".format("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def cut_places(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where texts are cut that stand one after another in UTF-8 and hold no ``ODD_SPACE``: places at which a match of the byte-level pattern begins.

    These are white space after another character, the last space of a run of white
    space before another character, and marks after a letter. What the pattern matches
    from there on, it matches in what is left of the text too; and a match that ends
    there ends there as well where the text stops.
    """
    space = SPACES[data]
    letter = LETTERS[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # the letters from U+00C0 on, but for two signs
    word_next = np.append(~space[1:], False)
    word_next[ends[ends > 0] - 1] = False
    cut = np.ones(len(data), bool)
    cut[1:] = np.where(space[1:], ~space[:-1] | ((data[1:] == 0x20) & word_next[1:]), MARKS[data[1:]] & letter[:-1])
    cut[ends[ends < len(data)]] = True
    return np.flatnonzero(cut)


def _packed(ids: list[int]) -> np.ndarray:
    """Little-endian unsigned 32-bit integers; ``array`` reads a list faster than numpy does."""
    return np.frombuffer(array("I", ids), np.uintc).astype("<u4", copy=False)


class LibraryEncoder:
    """The tokenizers library over whole texts.

    Where the tokenizer splits as the byte-level pattern does and has no normaliser,
    texts are cut first where the pattern cuts too (see ``cut_places``): each piece goes
    to the library once and its ids are remembered. Other texts, those that hold an added
    token's string or odd white space, and all texts of other tokenizers go to the
    library whole.
    """

    def __init__(self, model: str, remembered: int = 300_000, together: int = 200) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        parts = json.loads(model)
        split = parts.get("pre_tokenizer") or {}
        changes = any(parts.get(x) is not None for x in ("normalizer", "truncation", "padding"))
        self.cuts = not changes and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        # The library finds added tokens in a text before it splits.
        self.whole = "|".join([ODD_SPACE, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # in a byte-level vocabulary a character stands for a byte
        self.together = together
        self.of_pieces = Memory(self._pieces, remembered)

    def _library(self, texts: list[str]) -> list[bytes]:
        some = lambda part: [_packed(x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return in_portions(texts, some, 100_000)  # what the library makes is many times as large as a text

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. Those with one white space before them and none behind stand in line as one text; the ids are told apart by their bytes."""
        inner = [len(p) > 1 and p[1:] == p.strip() for p in pieces]
        lines = [*compress(pieces, inner)]
        found: list[bytes] = []
        for i in range(0, len(lines), self.together):
            line = lines[i : i + self.together]
            (x,) = self.tokenizer.encode_batch_fast([text := "".join(line)], add_special_tokens=False)
            ids = _packed(x.ids)
            ends = np.cumsum([*map(len, line if text.isascii() else map(str.encode, line))])
            cuts = (4 * np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 4).tolist()
            data = ids.tobytes()
            found += map(data.__getitem__, map(slice, chain((0,), cuts), cuts))
        if len(lines) == len(pieces):
            return found
        in_line = iter(found)
        rest = iter(self._library([p for p, m in zip(pieces, inner, strict=True) if not m]))
        return [next(in_line if m else rest) for m in inner]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        with no_cycles():
            return in_portions(texts, self._encode, CHARS) if self.cuts else in_portions(texts, self._library)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        every = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(every, self.whole).to_numpy(zero_copy_only=False)
        joined = iter(self._joined(every.filter(pa.array(~whole)) if whole.any() else every))
        others = iter(self._library([*compress(texts, whole)]))
        return [next(others if w else joined) for w in whole.tolist()]

    def _joined(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts that can be cut."""
        starts = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if starts[-1] == 0:
            return [b""] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[: starts[-1]]
        places = np.append(cut_places(data, starts[1:]), len(data))
        pieces = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data))
        return self.of_pieces.in_line(pieces, np.searchsorted(places, starts))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 2_000_000) -> str:
    """Encode every text, append ``end_id`` and write shard files; returns their folder.

    A file is renamed into place when it is whole, so a repeated task replaces it by
    the same file.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "shards")
    model = spark.sparkContext.broadcast(spark.read.text(tokenizer_path, wholetext=True).first()[0])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions(F.col("id"), F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoder = held_by_worker(("library", folder), lambda: LibraryEncoder(model.value))
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        context = TaskContext.get()
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = made = 0

        def close() -> pa.RecordBatch:
            nonlocal held, made
            name = f"{context.partitionId():08d}-{made:06d}.wm"
            lengths = np.array([len(t) // 4 for t in texts], np.uint32)
            data = build(ids, lengths, np.frombuffer(b"".join(texts), "<u4"))
            temporary = f"{root}/.{name}.{context.taskAttemptId()}"
            with where.open_output_stream(temporary) as out:
                out.write(data)
            where.move(temporary, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "docs": pa.array([len(ids)], pa.int64()), "tokens": pa.array([held], pa.int64())})
            ids.clear()
            texts.clear()
            held, made = 0, made + 1
            return row

        for batch in portions(batches, 1, CHARS):
            for i, data in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(i)
                texts.append(data + end)
                held += len(data) // 4 + 1
                if held >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    ordered.mapInArrow(run, "file string, docs long, tokens long").write.parquet(f"{folder}/_shards")
    return folder


def read_shards(spark, folder: str) -> DataFrame:
    """One row per document from the shard files: file, place, id, first (token within the file), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column(1)[k].as_buffer().to_pybytes())
                tokens = memoryview(shard.all_tokens().astype("<u4").tobytes())
                s = shard.starts
                crcs = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip(s.tolist(), s[1:].tolist(), strict=False)]
                n = len(shard.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py().rsplit("/", 1)[-1]] * n), pa.array(np.arange(n)), pa.array(shard.ids, pa.int64()), pa.array(s[:-1]), pa.array(shard.lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=["file", "place", "id", "first", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(run, "file string, place long, id long, first long, n_tokens long, ids_crc32 long")


def offsets(rows: DataFrame) -> DataFrame:
    """file and the tokens of all files before it: sums within groups of files, and of the groups before."""
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.substring("file", 1, 5))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = (Window.unboundedPreceding, -1)
    ahead = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("file").rowsBetween(*before)), F.lit(0))
    return files.withColumn("within", within).join(ahead, "part").select("file", (F.col("within") + F.col("ahead")).alias("base"))


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 2_000_000) -> DataFrame:
    """Write the shards, read them back: id, start, n_tokens and ids_crc32 of every document."""
    rows = written(read_shards(docs.sparkSession, write_shards(docs, tokenizer_path, end_id, id_col, text_col, shard_tokens)), "shard-rows")
    return rows.join(offsets(rows), "file").select(F.col("id").alias(id_col), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")

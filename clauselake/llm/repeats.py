"""Repeated passages: every byte that a long enough string covers which also starts anywhere else.

Suffixes are sorted where they can be compared. A string of ``least`` bytes has, of all
its runs of ``seed`` bytes, one with the least hash (the first of equal ones), its anchor;
equal strings have equal anchors at equal places. Documents are cut into pieces, one an
anchor: all the strings it is the anchor of, as one run of bytes. Pieces whose anchor
occurs once cannot repeat and go no further. Pieces of one anchor form a bucket, whose
enhanced suffix array is made from the pieces' bytes after the start of the anchor: they
are sorted, with the lengths of common prefixes, and a stack-scan gives the tree of
common-prefix intervals. An interval's members go on equally for its length; where they
also go back equally (its left extensions, sorted in the same way, do not all differ), by
enough that both make ``least`` bytes, they are a repeat. ``groups`` are those repeats with
all their occurrences, each as long as it is the same in all of them, within the pieces.
A longer passage comes as a chain of overlapping repeats, one an anchor.

At scale: nothing but anchors (a row for about 120 bytes) is dealt out before those that
occur once have gone. Equal pieces are one in the array, with the number of their
occurrences, so that exact copies cost a row each. A bucket of more than ``most`` different
pieces, as a line that many documents share has, is split: its pieces are cut by their
strings' distance from the anchor, and dealt by a hash of what all strings of a part have in
common; after two such steps these are whole strings, of which equal ones are one. So a
task's array holds at most ``most`` short pieces, and no piece is left out.

Defined results: null text is empty; texts are compared as UTF-8, whole; rows with equal
text, of one id or not, repeat each other; ids may be null; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import counted, sized, slices, written

#: Bytes of the runs whose hashes choose anchors.
SEED = 160
#: Different pieces that one task compares at once.
MOST = 1500
#: Strings (by their distance from the anchor) that a piece of a split bucket has at most; the last step has one.
SPLITS = (24, 1)
#: Bytes of text whose anchors are found at once.
CHUNK = 1 << 18

#: Rows whose texts and runs a task unpacks at once.
AT_ONCE = 200

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse (64 bits), and a value for each byte."""
    with np.errstate(over="ignore"):
        up, down = (np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]).cumprod(dtype=np.uint64) for x in (_ODD, _INVERSE))
    values = np.frombuffer(hashlib.shake_256(b"bytes").digest(256 * 8), np.uint64)
    return up, down, values


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from minima to both sides of block borders."""
    if width == 1:
        return x
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(texts: list[bytes], least: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each piece of the texts: anchor hash, text number, first string, anchor (both from the text's start), number of strings."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    begins = np.concatenate([[0], ends[:-1]])
    last = np.repeat(ends - least, [len(t) for t in texts])  # of the strings of the text that a byte is in
    found = []
    step = max(CHUNK, 4 * least)
    for start in range(0, max(len(data) - least + 1, 0), step):
        part = data[start : start + step + least - 1]
        up, down, values = _powers(max(2 * CHUNK, len(part)))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[np.frombuffer(part, np.uint8)] * up[: len(part)], out=sums[1:])
            hashes = _mixed((sums[seed:] - sums[:-seed]) * down[: len(part) - seed + 1])
        rank = ((hashes >> np.uint64(24)) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
        anchors = (_least_in_windows(rank, least - seed + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = np.arange(start, start + len(anchors))
        whole = last[start : start + len(anchors)] >= at  # strings that end within their text
        opens = whole & np.concatenate([[True], (anchors[1:] != anchors[:-1]) | ~whole[:-1]])
        stops = whole & np.concatenate([(anchors[1:] != anchors[:-1]) | ~whole[1:], [True]])
        firsts = np.flatnonzero(opens)
        found.append((hashes[anchors[firsts]].view(np.int64), firsts + start, anchors[firsts] + start, np.flatnonzero(stops) - firsts + 1))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    hashed, firsts, anchors, strings = (np.concatenate(c) for c in zip(*found, strict=True))
    text = np.searchsorted(ends, firsts, side="right")
    return hashed, text, firsts - begins[text], anchors - begins[text], strings


# -- enhanced suffix arrays ----------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lengths: list[int], n: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of ``n`` sorted strings by a stack-scan; ``lengths[i]`` is what i and i + 1 have in common."""
    stack = [(0, 0)]
    for i in range(1, n + 1):
        now = lengths[i - 1] if i < n else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            if first < i - 1:
                yield length, first, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], times: list[int], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes back, bytes on, members) of the repeats of one anchor, as long as they are equal in all members.

    ``lefts`` are what comes before the anchor, backwards; ``rights`` what starts with it;
    ``times`` how often such a piece occurs.
    """
    for i, n in enumerate(times):
        if n > 1 and len(lefts[i]) + len(rights[i]) >= least:
            yield len(lefts[i]), len(rights[i]), [i]
    order = sorted(range(len(rights)), key=rights.__getitem__)
    place = {i: k for k, i in enumerate(order)}
    back = {i: k for k, i in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    ahead = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for length, first, last in intervals(ahead, len(order)):
        members = sorted(order[first : last + 1], key=back.__getitem__)
        behind = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        if length + max(behind) < least:
            continue  # left extensions differ too early
        for shared, a, b in intervals(behind, len(members)):
            group = members[a : b + 1]
            ends = sorted(place[i] for i in group)
            if length + shared >= least and common(rights[order[ends[0]]], rights[order[ends[-1]]]) == length:  # else a deeper interval has it
                yield shared, length, group


# -- jobs ----------------------------------------------------------------------------------

SPAN = pa.struct([("repeat", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])
_PIECE = "anchor long, digest binary, owner binary, start int, at int, strings int, times long"


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def _occurrences(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """One row a piece: anchor, digest (of its bytes), owner (the text's digest), start, at (the anchor's place in it), strings, times."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def told() -> pa.RecordBatch:
            anchors, text, starts, at, strings = pieces(held, least, seed)
            digests = [xxhash.xxh3_128_digest(held[t][s : s + n + least - 1]) for t, s, n in zip(text.tolist(), starts.tolist(), strings.tolist(), strict=True)]
            owners = pa.array([hashlib.md5(t).digest() for t in held], pa.binary()).take(pa.array(text))
            columns = [pa.array(anchors), pa.array(digests, pa.binary()), owners, *(pa.array(a, pa.int32()) for a in (starts, at - starts, strings)), pa.array(np.ones(len(text), np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["anchor", "digest", "owner", "start", "at", "strings", "times"])

        for batch in slices(batches, AT_ONCE):
            for text in batch.column(0).to_pylist():
                if text is not None and len(text) >= least:
                    held.append(text)
                    size += len(text)
                    if size >= 2 * CHUNK:
                        yield told()
                        held, size = [], 0
        if held:
            yield told()

    return docs.select(F.col("text").cast("binary")).mapInArrow(cut, _PIECE)


def _of_repeated_anchors(occurrences: DataFrame, n: int) -> DataFrame:
    again = occurrences.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    return occurrences.join(written(sized(again, n // 2), "repeated-anchors"), "anchor")


def _with_bytes(chosen: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """``chosen`` pieces (anchor, digest, times, owner, start, at, strings) with their bytes, from ``texts`` (owner, row, data): of equal texts the first row's, so that a piece comes once unless rows are repeated."""
    wanted = chosen.groupBy("owner").agg(F.collect_list(F.struct("anchor", "digest", "times", "start", "at", "strings")).alias("wanted"))
    rows = texts.groupBy("owner").agg(F.min("row").alias("first"))
    chosen_rows = wanted.join(rows, "owner").withColumnRenamed("owner", "of")
    both = texts.join(chosen_rows, (F.col("owner") == F.col("of")) & F.col("row").eqNullSafe(F.col("first"))).select("data", "wanted")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "times", "at", "strings", "data"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in slices(batches, AT_ONCE):
            rows: list[tuple] = []
            for data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(w["anchor"], w["digest"], w["times"], w["at"], w["strings"], data[w["start"] : w["start"] + w["strings"] + least - 1]) for w in wanted]
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return both.mapInArrow(sliced, "anchor long, digest binary, times long, at int, strings int, data binary")


def groups(bucketed: DataFrame, least: int, each: bool = True) -> DataFrame:
    """The repeats of each bucket of pieces: anchor, digest (of a piece), span (repeat, its bytes' digest, start, end in the piece).

    A row for each repeat and piece it occurs in; or, without ``each``, one row for each piece
    that has any: its repeats all hold its anchor, so what they cover is one run.
    """
    rows = bucketed.select("anchor", "digest", "times", "at", "data").repartition("anchor").sortWithinPartitions("anchor", "digest")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []

        def told() -> pa.RecordBatch:
            anchors, digests, spans = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(digests, pa.binary()), pa.array(spans, SPAN)], names=["anchor", "digest", "span"])
            out.clear()
            return batch

        def close() -> None:
            lefts, rights = [h[4][: h[3]][::-1] for h in held], [h[4][h[3] :] for h in held]
            most: dict[int, tuple[int, int]] = {}
            for back, on, members in maximal_repeats(lefts, rights, [h[2] for h in held], least):
                if each:
                    _, _, _, at, data = held[members[0]]
                    repeat = xxhash.xxh3_128_digest(data[at - back : at + on])
                    out.extend((held[i][0], held[i][1], {"repeat": repeat, "start": held[i][3] - back, "end": held[i][3] + on}) for i in members)
                else:
                    most.update((i, (max(back, most[i][0]), max(on, most[i][1])) if i in most else (back, on)) for i in members)
            out.extend((held[i][0], held[i][1], {"repeat": None, "start": held[i][3] - back, "end": held[i][3] + on}) for i, (back, on) in most.items())

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue  # of a repeated row
                if held and row[0] != held[0][0]:
                    close()
                    held = []
                    if len(out) > 20_000:
                        yield told()
                held.append(row)
        if held:
            close()
        if out:
            yield told()

    return rows.mapInArrow(found, "anchor long, digest binary, span struct<repeat:binary,start:int,end:int>")


def _split(bucketed: DataFrame, least: int, strings: int) -> DataFrame:
    """Pieces of large buckets, cut to at most so many strings; the new anchor is what all strings of a part have in common."""
    owner = F.concat(F.unhex(F.lpad(F.hex("anchor"), 16, "0")), F.col("digest")).alias("owner")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        for batch in slices(batches, AT_ONCE):
            rows: list[tuple] = []
            for owner, times, at, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range((at - n + 1) // strings, at // strings + 1):  # distances of the anchor from a string's start
                    low, high = max(k * strings, at - n + 1), min(k * strings + strings - 1, at)
                    far, near = k * strings + strings - 1, k * strings
                    core = data[at - near : at - far + least]
                    start = at - high
                    part = data[start : at - low + least]
                    anchor = xxhash.xxh3_64_intdigest(core, seed=k + 1)
                    rows.append((anchor - (1 << 64) if anchor >> 63 else anchor, xxhash.xxh3_128_digest(part), owner, start, high - near, high - low + 1, times))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "digest", "owner", "start", "at", "strings", "times"])

    return bucketed.select(owner, "times", "at", "strings", "data").mapInArrow(cut, _PIECE)


def _covered(occurrences: DataFrame, n: int, texts: DataFrame, least: int, most: int, splits: tuple[int, ...], each: bool) -> DataFrame:
    """repeat, owner, start, end: where repeats are in the owners' texts; see ``groups`` for ``each``. ``n``: rows of ``occurrences``."""
    kept, n = counted(_of_repeated_anchors(occurrences, n), "pieces")
    place = F.struct("owner", "start", "at", "strings")
    different = kept.groupBy("anchor", "digest").agg(F.sum("times").alias("times"), F.min(place).alias("place"))
    different = written(sized(different.select("anchor", "digest", "times", "place.*"), n), "different-pieces")
    sizes = different.groupBy("anchor").agg(F.count("*").alias("n"))
    large, n_large = counted(sized(sizes.where(F.col("n") > most).select("anchor"), n // most), "large-buckets")
    bucketed = _with_bytes(different, texts, least)
    if not n_large:
        spans = groups(bucketed, least, each)
    else:
        bucketed = written(bucketed, "piece-bytes")
        small = groups(bucketed.join(large, "anchor", "left_anti"), least, each)
        owner = F.concat(F.unhex(F.lpad(F.hex("anchor"), 16, "0")), F.col("digest")).alias("owner")
        split = bucketed.join(large, "anchor")
        parts, n_parts = counted(_split(split, least, splits[0]), "piece-parts")
        more = _covered(parts, n_parts, split.select(owner, F.lit(0).alias("row"), "data"), least, most, splits[1:], each)
        more = more.join(split.select(owner, "anchor", "digest").distinct(), "owner").select("anchor", "digest", F.struct("repeat", "start", "end").alias("span"))
        spans = small.unionByName(more)
    spans = written(sized(spans.groupBy("anchor", "digest").agg(F.collect_set("span").alias("spans")), n), "piece-spans")
    inside = kept.select("anchor", "digest", "owner", "start").distinct().join(spans, ["anchor", "digest"])
    found = inside.select("owner", "start", F.explode("spans").alias("span"))
    return found.select("span.repeat", "owner", (F.col("start") + F.col("span.start")).alias("start"), (F.col("start") + F.col("span.end")).alias("end"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_text_key(F.col("text")).alias("owner"), F.col("doc_id").alias("row"), F.col("text").cast("binary").alias("data"))


def repeat_groups(docs: DataFrame, least: int = 400, seed: int = SEED, most: int = MOST, splits: tuple[int, ...] = SPLITS) -> DataFrame:
    """Maximal repeat groups: repeat (digest of its bytes), doc_id, start, end (bytes), a row an occurrence."""
    found = _covered(*counted(_occurrences(docs, least, seed), "anchored"), _texts(docs), least, most, splits, each=True)
    return found.distinct().join(docs.select(_text_key(F.col("text")).alias("owner"), "doc_id"), "owner").select("repeat", "doc_id", "start", "end")


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted runs that touch or overlap become one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def removed_passages(docs: DataFrame, least: int = 400, seed: int = SEED, most: int = MOST, splits: tuple[int, ...] = SPLITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what is left of its text."""
    own = docs.select("doc_id", "text")
    covered = _covered(*counted(_occurrences(own, least, seed), "anchored"), _texts(own), least, most, splits, each=False)
    runs = covered.select("owner", "start", "end").distinct().groupBy("owner").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    both = own.withColumn("owner", _text_key(F.col("text"))).join(written(runs, "removed-runs"), "owner", "left").select("doc_id", F.col("text").cast("binary"), "runs")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, AT_ONCE):
            rows = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, kept = text or b"", 0, hashlib.sha256()
                spans = _union([(r["start"], r["end"]) for r in runs or ()])
                for start, end in spans:
                    kept.update(data[at:start])
                    at = end
                kept.update(data[at:])
                rows.append((len(data), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(cleaned, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

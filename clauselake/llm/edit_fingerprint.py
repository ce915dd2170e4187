"""Document fingerprints by randomised edit embedding.

A text is embedded by a random walk over its characters that all texts share: at step
j the current character is written out, and a random bit of (j, character) says
whether the walk goes on to the next character or stays. Texts at a small edit
distance give outputs at a small Hamming distance: after an edit the walks drift
apart and soon fall into step again. The bits repeat after 4,096 steps, and characters
are hashed to 255 classes.

A fingerprint is a sample of the output. Steps are sampled on a scale: 64 random steps
below 2**k. The text's own scale k is the least that covers its walk; the fingerprint
holds k and the samples of scales k and k + 1, so that texts on neighbouring scales
can be compared. Likeness is the share of equal samples among those within the longer
of both walks, on the larger scale; texts more than a scale apart have none.

``near_edit_dups`` groups texts by edit distance. Over a long text the walks of two
versions drift apart, so keys come from blocks: a block begins behind each of the 32
runs of 6 characters that hash least in the text, its walk starts anew there, and the
run with 3 sampled steps of the block is a key. What two versions share of their keys
depends on the share of edited characters and not on the length. Texts of at most 256
characters also have keys from bands of 4 samples of the whole walk. A candidate is
confirmed by its exact edit distance. A pair that shares no key is not linked: of texts
of 400 to 20,000 characters joined from ``documents``, with 1 to 10 percent of the
characters edited, at most 1 in 100. All pairs of a key that rounds do not link are
compared, so a run with its block that many different texts share costs their pairs.

Defined results: a null text is empty; two empty texts have likeness 1, an empty and
another text 0. Ids are whole numbers; rows with the same id follow each other in the
order of their text's hash, rows without an id come last. Very long texts are walked to
their end. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.grouping import confirmed, linked, texts_of
from clauselake.llm.shared import slices, written

PERIOD = 4096
SAMPLES = 64
LEAST_SCALE, MOST_SCALE = 5, 40
#: Characters of own texts that a task embeds at once.
AT_ONCE = 6_000_000
#: With fewer texts of about one length, each is walked alone.
FEW = 40


def _strides() -> np.ndarray:
    """For each class and step: how many steps the walk spends on a character met there."""
    goes = np.random.default_rng(7).integers(0, 2, (256, PERIOD)).astype(bool)
    strides = np.zeros((256, PERIOD), np.uint8)
    for c in range(256):
        ones = np.flatnonzero(goes[c])
        ones = np.append(ones, ones[0] + PERIOD)
        steps = np.arange(PERIOD)
        strides[c] = ones[np.searchsorted(ones, steps)] - steps + 1
    return strides.ravel()


STRIDES = _strides()
STRIDE_BYTES = STRIDES.tobytes()


def sampled_steps(scale: int) -> np.ndarray:
    return np.sort(np.random.default_rng(1000 + scale).integers(0, 1 << scale, SAMPLES))


STEPS = {k: sampled_steps(k) for k in range(LEAST_SCALE, MOST_SCALE + 2)}


def classes(text: str) -> np.ndarray:
    """Class of each character, 1 to 255."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (((points * np.uint32(2654435761)) >> np.uint32(12)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)


def walk(codes: list[np.ndarray], starts: list[int]) -> list[tuple[np.ndarray, int]]:
    """For each text: the step at which the walk comes to each character, and the step after the last."""
    out: list = [None] * len(codes)
    by_length: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        by_length.setdefault(len(c).bit_length(), []).append(i)
    for lanes in by_length.values():
        if len(codes[lanes[0]]) == 0:
            for i in lanes:
                out[i] = (np.zeros(0, np.int64), starts[i])
        elif len(lanes) < FEW:
            for i in lanes:
                out[i] = _walk_one(codes[i], starts[i])
        else:
            lanes.sort(key=lambda i: -len(codes[i]))
            sizes = np.array([len(codes[i]) for i in lanes])
            grid = np.zeros((sizes[0], len(lanes)), np.uint8)
            for lane, i in enumerate(lanes):
                grid[: sizes[lane], lane] = codes[i]
            step = np.array([starts[i] for i in lanes], np.int32)
            came = np.zeros(grid.shape, np.int32)
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
            for t in range(sizes[0]):
                n = active[t]
                at = step[:n]
                came[t, :n] = at
                step[:n] = at + STRIDES[(grid[t, :n].astype(np.int32) << 12) + (at & (PERIOD - 1))]
            came = np.ascontiguousarray(came.T)
            for lane, i in enumerate(lanes):
                out[i] = (came[lane, : sizes[lane]], int(step[lane]))
    return out


def _walk_one(codes: np.ndarray, step: int) -> tuple[np.ndarray, int]:
    came: list[int] = []
    note = came.append
    for base in (codes.astype(np.int64) * PERIOD).tolist():
        note(step)
        step += STRIDE_BYTES[base + (step & 4095)]
    return np.array(came, np.int32), step


def _sample(codes: np.ndarray, came: np.ndarray, end: int) -> bytes:
    scale = max(LEAST_SCALE, min(MOST_SCALE, (end - 1).bit_length() if end else 0))
    steps = np.concatenate([STEPS[scale], STEPS[scale + 1]])
    out = np.zeros(2 * SAMPLES, np.uint8)
    inside = steps < end
    if len(codes):
        out[inside] = codes[np.searchsorted(came, steps[inside], side="right") - 1]
    return bytes([scale]) + out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: share of equal samples on the larger scale."""
    if abs(a[0] - b[0]) > 1:
        return 0.0
    scale = max(a[0], b[0])
    x, y = (np.frombuffer(f, np.uint8)[1 + SAMPLES * (scale - f[0]) :][:SAMPLES] for f in (a, b))
    used = (x > 0) | (y > 0)
    n = int(np.count_nonzero(used))
    return int(np.count_nonzero((x == y) & used)) / n if n else float(a == b)


#: Characters of the run before a block, blocks of a text, characters of a block, and the steps of it that a key samples.
RUN, BLOCKS, BLOCK_CHARS = 6, 32, 16
BLOCK_STEPS = (3, 8, 14)
#: Texts up to this length also have keys from their whole walk.
SHORT = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def block_keys(text: str) -> list[int]:
    """A key for each block: its run and the sampled steps of the walk that begins behind it."""
    codes = classes(text)
    n = len(codes) - RUN + 1
    if n < 1:
        return []
    runs = np.zeros(n, np.uint64)
    for k in range(RUN):
        runs = (runs << np.uint64(8)) | codes[k : k + n].astype(np.uint64)
    mixed = runs * _ODD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD
    least, first = np.unique(mixed, return_index=True)
    at = first[:BLOCKS] + RUN
    padded = np.concatenate([codes, np.zeros(BLOCK_CHARS + 1, np.uint8)])
    step = np.zeros(len(at), np.int64)
    keys = least[:BLOCKS].copy()
    for k in range(BLOCK_CHARS):
        code = padded[at + k].astype(np.int64)
        left = step + STRIDES[(code << 12) + step]
        for s in BLOCK_STEPS:
            here = (step <= s) & (s < left)
            keys[here] = (keys[here] + code[here].astype(np.uint64) * np.uint64(2 * s + 1)) * _ODD
        step = left
    return (keys ^ (keys >> np.uint64(32))).view(np.int64).tolist()


def fingerprint_texts(texts: list[str]) -> list[bytes]:
    codes = [classes(t) for t in texts]
    return [_sample(c, *w) for c, w in zip(codes, walk(codes, [0] * len(codes)), strict=True)]


def _rows(texts: list[str], following: list[str], last: str | None = None) -> dict[str, list]:
    """Columns for texts and the texts after them. ``following`` is ``texts`` moved up by one, where ``last`` is given."""
    codes = [classes(t) for t in texts]
    walks = walk(codes, [0] * len(codes))
    prints = [_sample(c, *w) for c, w in zip(codes, walks, strict=True)]
    heads = [len(t) - len(t) // 2 for t in texts]
    tails = [f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    tail_codes = [classes(t) for t in tails]
    # The walk over the edited text is the same as far as the texts are.
    starts = [int(w[0][h]) if h < len(c) else w[1] for c, w, h in zip(codes, walks, heads, strict=True)]
    edited_prints, edited_sha = [], []
    for c, (came, _), h, tc, (tail_came, end), t, tail in zip(codes, walks, heads, tail_codes, walk(tail_codes, starts), texts, tails, strict=True):
        edited_prints.append(_sample(np.concatenate([c[:h], tc]), np.concatenate([came[:h], tail_came]), end))
        edited_sha.append(hashlib.sha256((t[:h] + tail).encode("utf-8", "surrogatepass")).hexdigest())
    next_prints = [*prints[1:], *fingerprint_texts([last])] if last is not None else fingerprint_texts(following)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": edited_sha,
        "fingerprint": prints,
        "edited_fingerprint": edited_prints,
        "near_edited": [likeness(a, b) for a, b in zip(prints, edited_prints, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)],
    }


_TYPES = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
_SCHEMA = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _printed(rows: DataFrame, keep: list[str], blocks: bool = False) -> DataFrame:
    """The columns in ``keep``, the fingerprint (hex) of ``text`` and, if asked for, the keys of its blocks."""
    rows = rows.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    more = ["fingerprint string", "blocks array<bigint>"][: 1 + blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(len(keep)).to_pylist()
            made = [pa.array([f.hex() for f in fingerprint_texts(texts)], pa.string())]
            if blocks:
                made.append(pa.array([block_keys(t) for t in texts], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *(m.split()[0] for m in more)])

    return rows.mapInArrow(run, ", ".join([*kinds, *more]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (hex) of every document."""
    return _printed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"]).withColumnRenamed("id", id_col)


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near it is to that and to the next document.

    The edited text has the last half of its characters (rounded down) replaced by the
    first as many of the next document in descending id order; after the last comes
    the first.

    Documents are range-partitioned in that order, so the next one is the next row of
    the same task. The last row of a task meets the first of the next one in a second,
    small step: one row a task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = [F.desc_nulls_last("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        size = 0

        def made(ids: list, columns: dict[str, list], role: str, text: str | None) -> pa.RecordBatch:
            arrays = [pa.array(ids, pa.int64()), *(pa.array(columns.get(c, [None] * len(ids)), t) for c, t in _TYPES.items())]
            more = [pa.array([part] * len(ids), pa.int32()), pa.array([role] * len(ids), pa.string()), pa.array([text] * len(ids), pa.string())]
            return pa.RecordBatch.from_arrays([*arrays, *more], names=["id", *_TYPES, "part", "role", "text"])

        first = True
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first:
                    yield made([i], {}, "first", t)
                    first = False
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= AT_ONCE and len(ids) > 1:
                    yield made(ids[:-1], _rows(texts[:-1], texts[1:], texts[-1]), "row", None)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        if len(ids) > 1:
            yield made(ids[:-1], _rows(texts[:-1], texts[1:], texts[-1]), "row", None)
        if ids:
            yield made(ids[-1:], {}, "last", texts[-1])

    found = written(ordered.mapInArrow(run, f"id long, {_SCHEMA}, part int, role string, text string"), "edited")
    firsts = found.where("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    # One row a task; only task numbers meet in this window.
    parts = firsts.select(F.col("next_part").alias("part"))
    follows = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(1)))).alias("next_part"))
    lasts = found.where("role = 'last'").select("part", "id", "text").join(follows, "part").join(firsts, "next_part").select("id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _rows(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[c], t) for c, t in _TYPES.items())], names=["id", *_TYPES])

    names = ["id", *_TYPES]
    both = found.where("role = 'row'").select(*names).unionByName(lasts.mapInArrow(close, f"id long, {_SCHEMA}"))
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Exact, by bit vectors over the characters of ``a``: a column of the table a character of ``b``.

    Ends as soon as the distance must exceed ``most``, with a number above it: each
    character that is left lowers it by one at best.
    """
    if not a or not b:
        return len(a) + len(b)
    left_chars = len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for c in b:
        match = places.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        distance += bool(right & top) - bool(left & top)
        left_chars -= 1
        if most is not None and distance - left_chars > most:
            return distance - left_chars
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up = left | (full & ~(diagonal | right))
        down = right & diagonal
    return distance


BAND = 4


def near_edit_dups(docs: DataFrame, most_share: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and group_id (least id reachable) of every document.

    Texts are linked if they are equal, or share a band of samples and their edit
    distance is at most ``most_share`` of the longer text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = written(_printed(texts.withColumns({"digest": F.sha2("text", 256), "n": F.length("text")}), ["id", "digest", "n"], blocks=True), "fingerprints")
    classes_ = written(rows.groupBy("digest", "n", "fingerprint").agg(F.min("id").alias("node"), F.first("blocks").alias("blocks")), "classes").where("n > 0")
    scale = F.conv(F.substring("fingerprint", 1, 2), 16, 10).cast("int")
    bands = F.explode(F.sequence(F.lit(0), F.lit(2 * SAMPLES // BAND - 1)))
    cut = classes_.where(F.col("n") <= SHORT).select("node", "n", scale.alias("scale"), "fingerprint", bands.alias("band"))
    bits = F.substring("fingerprint", 3 + 2 * BAND * F.col("band"), F.lit(2 * BAND))
    on = F.col("scale") + (F.col("band") >= SAMPLES // BAND).cast("int")
    keys = cut.where(bits != "00" * BAND).select("node", F.xxhash64(on, F.pmod("band", F.lit(SAMPLES // BAND)), bits).alias("key"))
    keys = keys.unionByName(classes_.select("node", F.explode(F.array_distinct("blocks")).alias("key")))
    sketches = classes_.groupBy("node").agg(F.min("n").alias("least"), F.max("n").alias("most"))

    def may_link(a: str, b: str):
        return F.greatest(F.col(f"least_{a}"), F.col(f"least_{b}")) * (1 - most_share) <= F.least(F.col(f"most_{a}"), F.col(f"most_{b}"))

    def alike(a: str, b: str) -> bool:
        longer = max(len(a), len(b))
        return abs(len(a) - len(b)) <= most_share * longer and edit_distance(a, b, int(most_share * longer)) <= most_share * longer

    labels = linked(keys, sketches, may_link, lambda pairs, found: confirmed(pairs, found, lambda t: t or "", alike), lambda nodes: texts_of(nodes, docs, id_col, text_col))
    rooted = classes_.join(labels.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return rows.join(rooted, "digest", "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("group_id"))

"""Words of languages that put no spaces between them, by a dictionary table.

A run of letters is a lattice: every dictionary word that stands at a position is an arc,
and so is a single letter that no word covers. The least path through it is taken: fewest
letters left over, then fewest words, then the longest word first. Letters left over side
by side are one word. No word ends before a mark that belongs to the letter before it.

The dictionary is a double-array trie that goes to every task. Only a dictionary of at
most ``most`` letters goes there; a larger one is joined with the substrings of the runs
instead, and tasks get each run with its arcs.

A task takes the lattices of many runs at once, as arrays: the trie is walked from all
letters together, then the paths are solved letter by letter from the ends of the runs.
Long runs are solved in stretches that reach into the next one. What a stretch found of the
beginning of the next must be what the next found, up to a constant; otherwise the run is
solved as a whole, by itself.

Defined results: null text has no words; empty and null dictionary words are passed over,
repeated ones are one; with an empty dictionary a run is one word; ties have one result by
the order above; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import col
from clauselake.sources.scratch import written

#: Letters, the marks that belong to them, and digits: what words are made of.
RUN = r"[\p{L}\p{M}\p{N}]+"
#: Scripts without spaces (Thai, Lao, Burmese, Khmer, kana, Chinese), as a class of letters.
UNSPACED = "ก-๎ກ-໎က-႟ក-៓ぁ-ヿ㐀-䶿一-鿿"
#: Letters of a dictionary that is sent to all tasks: the trie has at most as many nodes, of eight bytes each.
MOST_LETTERS = 8_000_000
#: Longest word that is looked for.
LONGEST = 64


class Trie:
    """Words as a double array: the child of node s by letter code c is base[s] + c, if check there is s."""

    def __init__(self, words: Iterable[str]) -> None:
        words = sorted({w for w in words if w})
        self.longest = max(map(len, words), default=1)
        letters = sorted({c for w in words for c in w})
        #: Codes begin at 1; 0 marks the end of a word.
        self.codes = {c: k for k, c in enumerate(letters, 1)}
        self.base, self.check = array("i", [1]), array("i", [-1])
        free = 1
        todo = [(0, 0, len(words), 0)] if words else []  # node, its words, how deep
        while todo:
            node, low, high, depth = todo.pop()
            children = []
            at = low
            while at < high:
                code = self.codes[words[at][depth]] if depth < len(words[at]) else 0
                begin = at
                while at < high and (self.codes[words[at][depth]] if depth < len(words[at]) else 0) == code:
                    at += 1
                children.append((code, begin, at))
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            base = max(1, free - children[0][0])
            while any(base + c < len(self.check) and self.check[base + c] >= 0 for c, _, _ in children):
                base += 1
            room = base + children[-1][0] + 1 - len(self.check)
            if room > 0:
                self.base.extend([0] * room)
                self.check.extend([-1] * room)
            self.base[node] = base
            for code, begin, end in children:
                self.check[base + code] = node
                if code:
                    todo.append((base + code, begin, end, depth + 1))

    def ends(self, text: str, start: int) -> Iterator[int]:
        """Where the words end that start there."""
        node, base, check, codes = 0, self.base, self.check, self.codes
        n = len(check)
        for at in range(start, len(text) + 1):
            leaf = base[node]
            if at > start and leaf < n and check[leaf] == node:
                yield at
            code = codes.get(text[at]) if at < len(text) else None
            if code is None or leaf + code >= n or check[leaf + code] != node:
                return
            node = leaf + code

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """check with room behind it for any letter code; two times base, and one more where a word ends at the node."""
        base = np.frombuffer(self.base, np.int32)
        check = np.append(np.frombuffer(self.check, np.int32), np.full(len(self.codes) + 1, -1, np.int32))
        return check, base * 2 + (check[base] == np.arange(len(base), dtype=np.int32))


def clusters(text: str) -> list[bool]:
    """Whether a word may begin at each position (and at the end): not before a mark."""
    return [not unicodedata.category(c).startswith("M") or k == 0 for k, c in enumerate(text)] + [True]


def least_path(text: str, ends: Callable[[int], Iterable[int]]) -> list[str]:
    """The words of a run, by the arcs of its lattice."""
    n, opens = len(text), clusters(text)
    # From each position: letters left over, words, and the next position, after a word and after a letter left over.
    after_word: list[tuple[int, int, int, bool]] = [(0, 0, n, False)] * (n + 1)
    after_rest: list[tuple[int, int, int, bool]] = [(0, 0, n, False)] * (n + 1)
    for at in range(n - 1, -1, -1):
        if not opens[at]:
            continue
        step = next(k for k in range(at + 1, n + 1) if opens[k])
        found = [(after_word[end][0], after_word[end][1] + 1, -end, False) for end in ends(at) if opens[end]]
        rest = after_rest[step]
        after_word[at] = min([*found, (rest[0] + step - at, rest[1] + 1, -step, True)])
        after_rest[at] = min([*found, (rest[0] + step - at, rest[1], -step, True)])
    out, at, begin = [], 0, None
    while at < n:
        _, _, end, left_over = after_word[at] if begin is None else after_rest[at]
        if left_over:
            begin = at if begin is None else begin
        else:
            if begin is not None:
                out.append(text[begin:at])
            out.append(text[at:-end])
            begin = None
        at = -end
    if begin is not None:
        out.append(text[begin:])
    return out


def _pieces(run: str, unspaced: re.Pattern[str]) -> list[tuple[str, bool]]:
    """A run's parts, and whether each is of a script without spaces."""
    return [(m[0], m["un"] is not None) for m in unspaced.finditer(run)]


def _pattern(unspaced: str) -> re.Pattern[str]:
    return re.compile(f"(?P<un>[{unspaced}]+)|[^{unspaced}]+")


def segmenter(dictionary: DataFrame, word: str = "word", unspaced: str = UNSPACED, most: int = MOST_LETTERS) -> Callable[[Column | str], Column]:
    """A function of a text column: its words in order (array<string>), lower case. For dictionaries of at most ``most`` letters, an error beyond; see ``segmented``."""
    words = _words(dictionary, word)
    if _letters(words) > most:
        raise ValueError(f"the dictionary has more than {most} letters; use segmented()")
    trie, parts = _trie(words), _pattern(unspaced)

    @F.arrow_udf("array<string>")
    def segment(runs: pa.Array) -> pa.Array:
        cut = Cutter(trie, parts)
        return pa.concat_arrays([pa.array([], pa.list_(pa.string())), *[cut.words(runs.slice(begin, end - begin)) for begin, end in _slices(runs)]])

    return lambda text: segment(_runs(text))


def _runs(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(RUN), F.lit(0))


#: Bytes of letters whose words a task holds at once, and letters whose lattice it holds at once.
LETTERS_AT_ONCE = 1_000_000
LATTICE_AT_ONCE = 100_000
#: Letters of a stretch of a long run, and how far it reaches into the next, at least ``LONGEST``.
STRETCH, REACH = 512, 256
#: Ways through a lattice are compared as one number: letters left over, words, and the last eight bits for the arc taken.
LEFT_OVER, WORD, ARC = 1 << 36, 1 << 8, (1 << 8) - 1
NO_ARC = 1 << 62


def _arc(size: np.ndarray | int, left_over: bool) -> np.ndarray | int:
    """The longest first, words before letters left over."""
    return (LONGEST - np.minimum(size, LONGEST)) * 2 + left_over


def _of(array: np.ndarray, index: np.ndarray) -> np.ndarray:
    return array.take(index, mode="clip")


class Lattice(NamedTuple):
    """Solved pieces, given from the longest. Layer t has the letter that stands t before the end of each piece of
    so many letters; layer 0 is their ends."""

    #: Where each layer begins.
    first: np.ndarray
    #: Which piece, and which letter of the text.
    lane: np.ndarray
    at: np.ndarray
    #: How far a letter goes with its marks.
    rest: np.ndarray
    #: The arc taken after a word and after a letter left over, and costs from there to the end.
    taken: np.ndarray
    costs: tuple[np.ndarray, np.ndarray]


class Cutter:
    """The words of runs of letters, by arrays."""

    def __init__(self, trie: Trie, parts: re.Pattern[str]) -> None:
        self.trie, self.parts = trie, parts
        self.check, self.base = trie.arrays()
        #: By code point: the letter's code, -1 for one of no word; 1 for one met, 2 if its script has no spaces, 4 if it is a mark.
        self.codes, self.kinds = np.full(0x110000, -1, np.int32), np.zeros(0x110000, np.uint8)
        for letter, code in trie.codes.items():
            self.codes[ord(letter)] = code

    def words(self, runs: pa.Array) -> pa.Array:
        """Lists of runs to lists of words. Words lie in the runs' bytes one behind the other: only where they begin is new."""
        values = runs.flatten().cast(pa.string())
        counts = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
        offsets = _offsets(values)
        data = values.buffers()[2][offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else pa.py_buffer(b"")
        octets = np.frombuffer(data, np.uint8)
        byte_of = np.append(np.flatnonzero((octets & 0xC0) != 0x80), len(octets)).astype(np.int32)
        letters = np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.int32)
        starts = np.searchsorted(byte_of, offsets - offsets[0])
        at = np.flatnonzero(self._cuts(letters, starts))
        of_row = np.searchsorted(at, starts[np.append(0, np.cumsum(counts))]).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(byte_of[at], byte_of[-1:])), data)
        return pa.ListArray.from_arrays(pa.array(of_row), found)

    def _cuts(self, letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether a word begins at each letter of runs that begin at ``starts``."""
        kinds = _of(self.kinds, letters)
        if not kinds.all():
            for c in np.unique(letters[kinds == 0]).tolist():
                self.kinds[c] = 1 | 2 * (self.parts.match(chr(c))["un"] is not None) | 4 * unicodedata.category(chr(c)).startswith("M")
            kinds = _of(self.kinds, letters)
        unspaced = kinds & 2
        cut = np.zeros(len(letters) + 1, bool)
        cut[1:-1] = unspaced[1:] != unspaced[:-1]
        cut[starts] = True
        begin = np.flatnonzero(cut[:-1])
        size = np.diff(np.append(begin, len(letters)))
        opens, code = ((kinds & 4) == 0) | cut[:-1], _of(self.codes, letters)
        keep = np.flatnonzero((unspaced[begin] > 0) & (size > 1))
        begin, size = begin[keep], size[keep]
        long = size > STRETCH + REACH
        begins, sizes = begin[~long], size[~long]
        for lattice, which in self._solved(code, opens, begins, sizes):
            _trace(lattice, sizes[which], cut)
        if long.any():
            self._cut_long(letters, code, opens, begin[long], size[long], cut)
        return cut[:-1]

    def _solved(self, code: np.ndarray, opens: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[Lattice, np.ndarray]]:
        """Portions of the pieces from the longest, and which pieces they are."""
        order = np.argsort(-size, kind="stable")
        done, ends = 0, np.append(0, np.cumsum(size[order]))
        while done < len(order):
            end = max(done + 1, int(np.searchsorted(ends, ends[done] + LATTICE_AT_ONCE, "right")) - 1)
            which = order[done:end]
            yield self._lattice(code, opens, begin[which], size[which]), which
            done = end

    def _lattice(self, code: np.ndarray, opens: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Lattice:
        lanes, layers = len(size), int(size[0]) + 1
        alive = (lanes - np.append(0, np.cumsum(np.bincount(size, minlength=layers))[:-1])).astype(np.int32)
        first = np.append(0, np.cumsum(alive)).astype(np.int32)
        n = int(first[-1])
        place, layer = np.arange(n, dtype=np.int32), np.repeat(np.arange(layers, dtype=np.int32), alive)
        lane = place - _of(first, layer)
        at = _of((begin + size).astype(np.int32), lane) - layer
        # The next letter of one in layer t is in layer t - 1.
        after = place - np.repeat(np.append(np.int32(0), alive[:-1]), alive)
        code = np.append(np.full(lanes, -1, np.int32), _of(code, at[lanes:]))
        opened = np.append(np.ones(lanes, bool), _of(opens, at[lanes:]))
        marks = not opened.all()

        # Arcs: all words that begin at a letter and end where a word may end, a letter's arcs side by side.
        found = []
        origin = to = place[lanes:][opened[lanes:]]
        base = np.full(len(origin), self.base[0] >> 1, np.int32)
        node = np.zeros(len(origin), np.int32)
        for letters in range(1, LONGEST + 1):
            child = base + _of(code, to)
            keep = np.flatnonzero(_of(self.check, child) == node)
            if not len(keep):
                break
            origin, to, node = _of(origin, keep), _of(after, _of(to, keep)), _of(child, keep)
            base = _of(self.base, node)
            ends = np.flatnonzero(base & _of(opened, to) if marks else base & 1)
            base >>= 1
            found.append((letters, _of(origin, ends), _of(to, ends)))
        del place, layer, origin, base, node
        n_arcs = np.bincount(np.concatenate([o for _, o, _ in found]), minlength=n) if found else np.zeros(n, np.int64)
        # One that leads nowhere where there is none.
        arc_of = np.append(0, np.cumsum(np.maximum(n_arcs, 1))).astype(np.int32)
        free = arc_of[:-1].copy()
        arc_to, arc_cost = np.zeros(arc_of[-1], np.int32), np.full(arc_of[-1], NO_ARC, np.int64)
        for letters, origin, to in found:
            slot = _of(free, origin)
            arc_to[slot], arc_cost[slot], free[origin] = to, WORD + _arc(letters, False), slot + 1
        del found, free, n_arcs

        # A letter left over goes with its marks.
        rest_to, rest = after.copy(), np.ones(n, np.int64)
        todo = np.flatnonzero(opened & ~_of(opened, rest_to)) if marks else ()
        while len(todo):
            rest_to[todo] = _of(after, rest_to[todo])
            rest[todo] += 1
            todo = todo[~opened[rest_to[todo]]]

        cost, rest_after, taken = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.uint8)
        bounds, arc_bounds, one = first.tolist(), arc_of[first].tolist(), LEFT_OVER + _arc(1, True)
        for t in range(1, layers):
            a, b, c, d = bounds[t], bounds[t + 1], arc_bounds[t], arc_bounds[t + 1]
            if marks:
                left = _of(rest_after, rest_to[a:b]) + (rest[a:b] * LEFT_OVER + _arc(rest[a:b], True))
            else:
                left = rest_after[bounds[t - 1] : bounds[t - 1] + b - a] + one
            least = np.minimum.reduceat(_of(cost, arc_to[c:d]) + arc_cost[c:d], arc_of[a:b] - c)
            word = np.minimum(left + WORD, least)
            left = np.minimum(left, least)
            taken[a:b, 0], taken[a:b, 1] = word & ARC, left & ARC
            cost[a:b], rest_after[a:b] = word & ~ARC, left & ~ARC
        return Lattice(first, lane, at, rest, taken, (cost, rest_after))

    def _cut_long(self, letters: np.ndarray, code: np.ndarray, opens: np.ndarray, begin: np.ndarray, size: np.ndarray, cut: np.ndarray) -> None:
        """Mark in ``cut`` where words of long pieces begin."""
        parts = -(-(size - REACH) // STRETCH)
        piece = np.repeat(np.arange(len(size)), parts)
        at = begin[piece] + STRETCH * (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts))
        n = np.minimum(STRETCH + REACH, (begin + size)[piece] - at)
        last, near = np.append(piece[1:] != piece[:-1], True), np.arange(min(LONGEST, self.trie.longest))
        taken, wide = np.zeros((len(letters), 2), np.uint8), np.zeros(len(piece), bool)
        own, seen = (np.empty((len(piece), 2 * len(near)), np.int64) for _ in range(2))
        for lattice, which in self._solved(code, opens, at, n):
            lanes = np.arange(len(which))
            mine = (lattice.at - at[which][lattice.lane] < STRETCH) | last[which][lattice.lane]
            mine[: len(which)] = False
            taken[lattice.at[mine]] = lattice.taken[mine]
            wide[which] = lattice.rest.max() > len(near)
            for found, offset in ((own, 0), (seen, STRETCH)):
                place = lattice.first[np.maximum(n[which][:, None] - offset - near, 0)] + lanes[:, None]
                found[which] = np.hstack([cost[place] for cost in lattice.costs])
        # Costs at the beginning of each stretch but the first, as the one before it found them and as it did itself.
        opened = np.tile(opens[at[1:, None] + near], 2)
        apart = seen[:-1] - own[1:]
        same = opened[:, : len(near)].any(1) & ((apart == np.take_along_axis(apart, opened.argmax(1)[:, None], 1)) | ~opened).all(1)
        whole = {*piece[wide].tolist(), *piece[:-1][~last[:-1] & ~same].tolist()}
        for k, (a, size_of) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
            if k in whole:
                text = letters[a : a + size_of].tobytes().decode("utf-32-le")
                words = least_path(text, lambda start, text=text: self.trie.ends(text, start))
                cut[a + np.cumsum([0, *map(len, words)])[:-1]] = True
                continue
            arcs, opening = taken[a : a + size_of].tobytes(), opens[a : a + size_of].tobytes()
            begins, to, left_over = [], 0, 0
            while 0 <= to < size_of:
                arc = arcs[2 * to + left_over]
                if not arc & left_over:
                    begins.append(a + to)
                left_over = arc & 1
                to = opening.find(1, to + 1) if left_over else to + LONGEST - (arc >> 1)
            cut[begins] = True


def _trace(lattice: Lattice, size: np.ndarray, cut: np.ndarray) -> None:
    """Mark in ``cut`` where words begin, from the fronts of all pieces along the arcs taken."""
    lane, t, left_over = np.arange(len(size)), size, np.zeros(len(size), np.int64)
    taken = lattice.taken.reshape(-1)
    while len(lane):
        place = _of(lattice.first, t) + lane
        arc = _of(taken, 2 * place + left_over)
        cut[_of(lattice.at, place)[(arc & left_over) == 0]] = True
        left_over = (arc & 1).astype(np.int64)
        t = t - np.where(left_over, _of(lattice.rest, place), LONGEST - (arc >> 1))
        more = np.flatnonzero(t)
        lane, t, left_over = lane[more], t[more], left_over[more]


def _offsets(values: pa.Array) -> np.ndarray:
    """Where strings begin in their bytes, and where the last one ends."""
    return np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)


def _slices(runs: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows from and to, of about so many bytes of letters as are held at once."""
    lengths = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
    before = _offsets(runs.flatten().cast(pa.string())).astype(np.int64)[np.append(0, np.cumsum(lengths))]
    begin = 0
    while begin < len(runs):
        end = min(max(begin + 1, int(np.searchsorted(before, before[begin] + LETTERS_AT_ONCE))), len(runs))
        yield begin, end
        begin = end


def _cut_in_slices(trie: Trie, parts: re.Pattern[str]):
    """Batches of key and runs to key and tokens. A batch of texts is cut a few at a time: words of all of them are never there at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(trie, parts)
        for batch in batches:
            keys, runs = batch.columns
            for begin, end in _slices(runs):
                yield pa.RecordBatch.from_arrays([keys.slice(begin, end - begin), cut.words(runs.slice(begin, end - begin))], names=batch.schema.names)

    return run


def _trie(words: DataFrame) -> Trie:
    return Trie(r[0] for r in words.collect())


def _words(dictionary: DataFrame, word: str) -> DataFrame:
    return dictionary.select(F.lower(F.col(word)).alias("word")).where(f"word <> '' and length(word) <= {LONGEST}").distinct()


def _letters(words: DataFrame) -> int:
    return words.agg(F.sum(F.length("word"))).first()[0] or 0


def segmented(texts: DataFrame, dictionary: DataFrame, key: str, text: str, word: str = "word", unspaced: str = UNSPACED, most: int = MOST_LETTERS) -> DataFrame:
    """key, tokens of every row of ``texts``, with a dictionary of any size. Keys may be null or repeated."""
    words = _words(dictionary, word)
    if _letters(words) <= most:
        rows = texts.select(F.col(key), _runs(text).alias("tokens"))
        return rows.mapInArrow(_cut_in_slices(_trie(words), _pattern(unspaced)), rows.schema)
    # Runs meet the dictionary by their substrings; equal runs once.
    numbered = texts.select(F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("n")).alias("row"), _runs(text).alias("runs"))
    placed = written(numbered.select("row", F.posexplode_outer("runs").alias("at", "run")), "runs")
    of_runs = placed.where("run is not null").select("run").distinct().select("run", F.explode(F.regexp_extract_all("run", F.lit(f"[{unspaced}]+"), F.lit(0))).alias("piece")).select("piece").distinct()
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    starts = of_runs.select("piece", F.md5("piece").alias("id"), F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("from"))
    windows = starts.select("id", "from", F.substring("piece", F.col("from"), F.lit(longest)).alias("window"))
    substrings = windows.select("id", "from", "window", F.explode(F.sequence(F.lit(1), F.length("window"))).alias("size")).select("id", "from", "size", F.substring("window", F.lit(1), F.col("size")).alias("word"))
    arcs = substrings.join(words, "word").groupBy("id").agg(F.collect_list(F.struct((F.col("from") - 1).alias("at"), (F.col("from") + F.col("size") - 1).alias("end"))).alias("arcs"))
    lattice = of_runs.withColumn("id", F.md5("piece")).join(arcs, "id", "left")

    @F.pandas_udf("array<string>")
    def path(pieces: pd.Series, arcs: pd.Series) -> pd.Series:
        def one(piece: str, found) -> list[str]:
            ends: dict[int, list[int]] = {}
            for arc in () if found is None else found:
                ends.setdefault(arc["at"], []).append(arc["end"])
            return least_path(piece, lambda k: ends.get(k, ()))

        return pd.Series([one(p, a) for p, a in zip(pieces, arcs, strict=True)])

    solved = lattice.select("piece", path("piece", "arcs").alias("words"))
    parts = placed.select("row", "at", F.posexplode_outer(F.regexp_extract_all("run", F.lit(f"[{unspaced}]+|[^{unspaced}]+"), F.lit(0))).alias("part", "piece"))
    tokens = parts.join(solved, "piece", "left").withColumn("words", F.coalesce("words", F.when(F.col("piece").isNotNull(), F.array("piece")), F.array().cast("array<string>")))
    joined = tokens.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part", "words"))), lambda x: x["words"])).alias("tokens"))
    return joined.select(F.col("row.key").alias(key), "tokens")

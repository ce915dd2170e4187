"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built.
A text is cut, from left to right, into the longest phrases that occur anywhere in
that sample. The fewer phrases a text needs for its length, the closer it is to the
language; a text of n characters cut into c phrases costs c * log2(m + a) / n bits a
character, m being the length of that language's own sample and a the number of all
letters (a letter that the sample lacks is a phrase of its own). So samples of
different lengths compare. The language of least cost wins.

A phrase ends where the automaton has no transition, so one dense table per language
says for each (state, character) the next state and whether a new phrase began.
Tasks follow the tables for many texts and all languages at once, a character a step.
Long texts are read whole, in blocks of ``block`` characters (a phrase ends with its
block), so memory is bounded by a batch and not by the longest text.

Bound of the sample: ``slots`` documents a language, of ``chars_each`` characters
each, in windows from all over them, and ``sample_chars`` characters a language in all.

Defined results: null, empty or letterless text is ``und`` with score 0; with no
labelled row every text is ``und``. Ties go to the first language by code point.
Repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clauselake.llm.shared import held_by_worker, slices

#: Language of texts without a letter.
UNKNOWN = "und"


#: Characters of a window of a sampled text.
WINDOW = 100


def windows(text: Column, h: Column, chars_each: int) -> Column:
    """Array of pieces of ``text``, ``chars_each`` characters in all: one from each of as many equal strips, where the hash ``h`` says; of a short text all."""
    n, k = F.length(text), max(1, chars_each // WINDOW)
    size = chars_each // k
    strip = F.floor(n / k).cast("int")
    starts = [F.when(n <= chars_each, size * i + 1).otherwise((strip * i + 1 + F.pmod(F.xxhash64(h, F.lit(i)), F.greatest(strip - size + 1, F.lit(1)))).cast("int")) for i in range(k)]
    return F.array(*(F.substring(text, start, F.lit(size)) for start in starts))


def collect_samples(docs: DataFrame, text_col: str, lang_col: str, key: Column, slots: int, chars_each: int, sample_chars: int) -> dict[str, str]:
    """Labelled text per language. Rows are dealt to ``slots`` by a hash of ``key``; the least hash of a slot is taken.

    Both steps combine before they shuffle, so one language may hold any share of the rows.
    Every sampled text gives a window before any gives another.
    """
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    hashed = docs.where(lang.isNotNull() & (F.length(F.trim(text)) > 0)).select(lang.alias("lang"), F.xxhash64(key).alias("h"), text.alias("text"))
    rows = hashed.select("lang", "h", windows(F.col("text"), F.col("h"), chars_each).alias("parts"))
    least = hashed.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h"))
    # At most slots rows a language: the bound of the sample.
    texts = rows.join(least.select("lang", "h"), ["lang", "h"]).groupBy("lang", "h").agg(F.min("parts").alias("parts")).collect()
    pieces: dict[str, list[tuple[int, int, str]]] = {}
    for r in texts:
        k = len(r["parts"])
        # Texts start at different windows, so that no place in them is preferred.
        pieces.setdefault(r["lang"], []).extend(((i - r["h"]) % k, r["h"], part) for i, part in enumerate(r["parts"]) if part)
    return {lang: " ".join(part for _, _, part in sorted(found))[:sample_chars] for lang, found in pieces.items()}


class Alphabet:
    """Code points to small numbers: 0 for a run of anything but letters, 1 for a letter that no sample has."""

    def __init__(self, letters: str) -> None:
        self.at = {c: k + 2 for k, c in enumerate(letters)}
        self.size = len(letters) + 2
        kind = np.min_scalar_type(self.size)
        self.unseen = np.iinfo(kind).max
        self.lut = np.full(0x110000, self.unseen, kind)

    def codes(self, points: np.ndarray) -> np.ndarray:
        out = self.lut[points]
        if (new := points[out == self.unseen]).size:
            for p in np.unique(new):
                c = chr(p)
                self.lut[p] = self.at.get(c.lower()[:1]) or int(unicodedata.category(c)[0] == "L")
            out = self.lut[points]
        return out


def letters_by_use(text: str) -> list[str]:
    """All letters of a text, the most used first."""
    used = Counter(c.lower()[:1] for c in text if unicodedata.category(c)[0] == "L")
    return sorted(used, key=lambda c: (-used[c], c))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    goes: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in codes:
        here = len(goes)
        goes.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = here
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if longest[q] == longest[p] + 1:
                link[here] = q
            else:
                twin = len(goes)
                goes.append(dict(goes[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    return goes


def parse_table(goes: list[dict[int, int]], n_codes: int) -> np.ndarray:
    """Row of each state, by character below ``n_codes``: twice the next state's row, plus 1 where a new phrase begins."""
    table = np.zeros((len(goes), n_codes), np.int32)
    fresh = np.array([goes[0].get(c, 0) for c in range(n_codes)], np.int32) * n_codes
    table[:] = 2 * fresh + 1
    for s, row in enumerate(goes):
        for c, t in row.items():
            if c < n_codes:
                table[s, c] = 2 * t * n_codes
    table[0] = 2 * fresh + 1  # at the start of a text the first phrase begins
    return table.ravel()


class Parser:
    """Counts of phrases of many texts in all languages.

    Each language has its own codes for all letters of its sample, so scripts do not compete. Its ``letters``
    most used ones are columns of its table; transitions by the others are looked up in a sorted list.
    """

    def __init__(self, samples: dict[str, str], letters: int = 94, block: int = 4096) -> None:
        self.langs = sorted(samples)
        self.block = block
        own = {lang: letters_by_use(samples[lang]) for lang in self.langs}
        self.alphabet = Alphabet("".join(sorted(set().union(*own.values()))))
        #: By language and code of the common alphabet: the language's own code; 1 where its sample lacks the letter.
        self.own = np.ones((len(self.langs), self.alphabet.size), np.int32)
        self.own[:, 0] = 0
        self.widths = np.array([min(len(own[lang]), letters) + 2 for lang in self.langs], np.int32)
        self.bits = np.zeros(len(self.langs))
        tables, self.starts, at = [], [], 0
        keys: list[int] = []
        values: list[int] = []
        for k, lang in enumerate(self.langs):
            for code, c in enumerate(own[lang]):
                self.own[k, self.alphabet.at[c]] = code + 2
            sample = self._squeezed(self._points(samples[lang]))
            # A phrase is a place in the sample, or one of all the letters put behind it.
            self.bits[k] = np.log2(len(sample) + self.alphabet.size)
            goes = suffix_automaton(self.own[k][sample].tolist())
            width = int(self.widths[k])
            t = parse_table(goes, width)
            for s, row in enumerate(goes):
                for c, to in row.items():
                    if c >= width:
                        keys.append((at + s * width) * self.alphabet.size + c)
                        values.append(2 * (at + to * width) + (s == 0))
            self.starts.append(at)
            tables.append(t)
            at += len(t)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.rare_keys, self.rare_values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        # One table for all: a row's place in it, doubled, plus the flag.
        width = np.int32 if 2 * at < 2**31 else np.int64
        self.table = np.concatenate([t.astype(width) + width(2 * s) for t, s in zip(tables, self.starts, strict=True)]) if tables else np.zeros(0, width)

    def _next(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Entries of the table for (languages x lanes) states and the lanes' codes in the common alphabet."""
        own = self.own[:, codes]
        if not len(self.rare_keys):
            return self.table[state + own]
        rare = own >= self.widths[:, None]
        value = self.table[state + np.where(rare, 1, own)].astype(np.int64)
        if rare.any():
            k, lane = np.nonzero(rare)
            c = own[k, lane]
            key = state[k, lane] * self.alphabet.size + c
            at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
            fresh = np.searchsorted(self.rare_keys, np.array(self.starts, np.int64)[k] * self.alphabet.size + c)
            value[k, lane] = self.rare_values[np.where(self.rare_keys[at] == key, at, fresh)]
        return value

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _squeezed(self, points: np.ndarray) -> np.ndarray:
        codes = self.alphabet.codes(points)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        return codes[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) counts of phrases, and the letters of each text."""
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        letters = np.zeros(len(texts), np.int64)
        blocks: list[np.ndarray] = []
        owners: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            codes = self._squeezed(self._points(text))
            letters[i] = np.count_nonzero(codes)
            if letters[i]:
                for at in range(0, len(codes), self.block):
                    blocks.append(codes[at : at + self.block])
                    owners.append(i)
        if not blocks or not self.langs:
            return counts, letters
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        sizes, own = sizes[order], np.array(owners)[order]
        longest = int(sizes[0])
        grid = np.zeros((longest, len(order)), self.alphabet.lut.dtype)  # a row holds one character of every block
        for lane, k in enumerate(order):
            grid[: sizes[lane], lane] = blocks[k]
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # lanes longer than the step
        got = np.zeros((len(self.langs), len(order)), np.int64)
        state = np.repeat(np.array(self.starts, np.int64)[:, None], len(order), axis=1)
        for step in range(longest):
            n = active[step]
            value = self._next(state[:, :n], grid[step, :n])
            got[:, :n] += value & 1
            state[:, :n] = value >> 1
        for k in range(len(self.langs)):
            np.add.at(counts[:, k], own, got[k])
        return counts, letters


def _identified(docs: DataFrame, keep: Sequence[str], train: Column | None, id_col: str, text_col: str, lang_col: str, slots: int, chars_each: int, sample_chars: int, letters: int, block: int) -> DataFrame:
    """id, kept (a struct of the columns in ``keep``), lang, score and whether the text has a letter."""
    labelled = docs.where(train) if train is not None else docs
    samples = tuple(sorted(collect_samples(labelled, text_col, lang_col, F.col(f"`{id_col}`"), slots, chars_each, sample_chars).items()))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), kept.alias("kept"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([rows.schema["id"], rows.schema["kept"]]).add("lang", "string").add("score", "double").add("lettered", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held_by_worker(("languages", samples, letters, block), lambda: Parser(dict(samples), letters, block))
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            counts, n = parser.phrases(texts)
            if parser.langs:
                costs = counts * parser.bits
                best = costs.argmin(axis=1)
                least = costs[np.arange(len(texts)), best]
                rest = costs.copy()
                rest[np.arange(len(texts)), best] = np.inf
                second = rest.min(axis=1)
                none = n == 0
                score = np.where(none, 0.0, 1.0 - least / np.where(none, 1.0, second))
                pred = [UNKNOWN if z else parser.langs[b] for b, z in zip(best, none, strict=True)]
            else:
                score, pred = np.zeros(len(texts)), [UNKNOWN] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n > 0, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)


#: Bounds of the sample, letters with a column in a language's table, and characters of a block.
BOUNDS = {"slots": 256, "chars_each": 400, "sample_chars": 24_000, "letters": 62, "block": 4096}


def identify(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: Sequence[str] = (), **bounds: int) -> DataFrame:
    """id, the columns in ``keep``, lang_pred and score for every document.

    ``train`` says which rows may be learnt from (all with a language, by default);
    ``bounds`` change those in ``BOUNDS``. The score is the lead of the winner over the
    next language, from 0 (none) to 1.
    """
    found = _identified(docs, keep, train, id_col, text_col, lang_col, **BOUNDS | bounds)
    return found.select(F.col("id").alias(id_col), *[F.col(f"kept.`{c}`") for c in keep], F.col("lang").alias("lang_pred"), "score")


def accepted(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, with their columns; the language column has the predicted language.

    With no labelled row there is no prediction: the rows stay as they are.
    """
    found = _identified(docs, docs.columns, train, id_col, text_col, lang_col, **BOUNDS | bounds).where("lettered")
    own = lambda c: F.col(f"kept.`{c}`")
    lang = F.when(F.col("lang") != UNKNOWN, F.col("lang")).otherwise(own(lang_col))
    return found.select(*[(lang if c == lang_col else own(c)).alias(c) for c in docs.columns])

"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two strings counts their common subsequences of three letters, each
weighted by 0.7 to the power of the length it spans in both; it is normalised to 1 for
equal strings. So a word with letters put in, left out or set apart stays close to it.

Strings are tokens between white space: letters alone count, accents, case and letter
look-alikes (0 for o, $ for s, ...) are folded, letters set apart by spaces are joined,
a mark stands for the beginning, and tokens of over 15
letters are read in overlapping windows. All of a text is read.

Training. The labels are those of documents; a sentence has its document's label. Of
each toxic document the sentence with the token that best separates the classes stands for
the label, and its most telling tokens bear witness; the tokens of sentences labelled
clean, the most alike above all, stand against them. The machine (squared hinge loss, balanced
classes) is fitted on the kernel's projection onto the landmarks, and picks the
witnesses anew in each round. At last a logistic curve over the amount of values on the
toxic side and the number of tokens (or the largest value, if none is there) gives a document's score. As values are linear in the kernel, the landmarks are folded into
one table of weights by three letters, which goes to the tasks (128 KB).

Bound of the sample: ``slots`` documents a class. Scores use the text alone.

Defined results: texts without a token of three letters score as the curve's low end;
without both classes among the labels every score is 0. Repeated rows are each
returned; other columns are ignored. A document with several labels is toxic if one
says so; null labels are not used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.bpe import Memory, in_portions
from clauselake.llm.shared import no_cycles, slices

DECAY = 0.7
LONGEST = 16
#: Letters are numbers below CODES, as characters from "a": a-z, then classes of all other letters, then the mark of a beginning.
CODES = 48
OTHERS = 21
#: Stands before the first letter, so that a word's beginning counts more than its middle.
START = chr(97 + CODES - 1)
#: Value of a token without a subsequence of three letters.
NOTHING = -2.0
#: From this value on a token counts for the amount of toxic tokens.
NEAR = 0.0
#: Cost of the slack of each class.
COST = 3000.0
#: Words that bear witness: so much more frequent in toxic documents, by so many deviations.
ODDS, SURE = 3.0, 2.0

#: Characters that stand for letters.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
SENTENCE_END = re.compile(r"[.!?\n]+(?=\s|$)")
#: Letters set apart by white space.
APART = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")


class _Letters(dict):
    """For str.translate: a character to letters a-z, to one of the classes of other letters, or to nothing."""

    def __missing__(self, point: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(point)):
            c = LOOK_ALIKES.get(c, c).lower()
            if "a" <= c <= "z":
                out += c
            elif c.isalpha():
                out += chr(123 + ord(c[0]) % OTHERS)
        self[point] = out
        return out


_LETTERS = _Letters()


def letters(token: str) -> str:
    """Letters of a token; punctuation around it is no look-alike."""
    return token.strip("!|.,;:?\"'()[]{}*-_").translate(_LETTERS)


def strings(token: str) -> list[str]:
    """The strings of at most 16 letters that a token is read as."""
    word = START + letters(token)
    if len(word) <= LONGEST:
        return [word] if len(word) >= 4 else []
    half = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - half, half)]


def tokens(text: str) -> set[str]:
    found = set(text.split())
    if APART.search(text):
        found.update("".join(m.group().split()) for m in APART.finditer(text))
    return found


def _codes(words: list[str]) -> np.ndarray:
    """(words x letters) numbers; all words are of one length."""
    return (np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1) - 97).astype(np.int64)


def kernel(s: np.ndarray, t: np.ndarray, order: int = 3) -> np.ndarray:
    """Gap-weighted subsequence kernel of each pair of rows."""
    n, (ls, lt) = len(s), (s.shape[1], t.shape[1])
    same = [[s[:, i] == t[:, j] for j in range(lt)] for i in range(ls)]
    before = np.ones((ls + 1, lt + 1, n))
    for _ in range(order - 1):
        now = np.zeros((ls + 1, lt + 1, n))
        for i in range(ls):
            run = np.zeros(n)
            for j in range(lt):
                run = DECAY * run + DECAY**2 * same[i][j] * before[i, j]
                now[i + 1, j + 1] = DECAY * now[i, j + 1] + run
        before = now
    total = np.zeros(n)
    for i in range(ls):
        for j in range(lt):
            total += DECAY**2 * same[i][j] * before[i, j]
    return total


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and numbers of the words of each length."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(len(w), []).append(i)
    for at in places.values():
        yield np.array(at), _codes([words[i] for i in at])


def norms(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words))
    for at, codes in by_length(words):
        out[at] = np.sqrt(kernel(codes, codes))
    return out


def subsequence_table(landmarks: list[str]) -> np.ndarray:
    """(three letters x landmarks): weight of each subsequence in each landmark, over the landmark's norm."""
    table = np.zeros((CODES**3, len(landmarks)))
    for k, (mark, norm) in enumerate(zip(landmarks, norms(landmarks), strict=True)):
        c = _codes([mark])[0]
        for i, j, m in combinations(range(len(c)), 3):
            table[(c[i] * CODES + c[j]) * CODES + c[m], k] += DECAY ** (m - i + 1) / norm
    return table


def projected(words: list[str], table: np.ndarray) -> np.ndarray:
    """(words x columns): each word's normalised subsequences times the table; with a subsequence table, the kernel."""
    out = np.zeros((len(words), table.shape[1]))
    for at, codes in by_length(words):
        total = np.zeros((len(at), table.shape[1]))
        for i, j in combinations(range(codes.shape[1] - 1), 2):
            pair = (codes[:, i] * CODES + codes[:, j]) * CODES
            for k in range(j + 1, codes.shape[1]):
                total += DECAY ** (k - i + 1) * table[pair + codes[:, k]]
        out[at] = total / np.sqrt(kernel(codes, codes))[:, None]
    return out


class Model:
    """Weights by three letters, bias, and the curve from a text's token values to its score."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray | None = None) -> None:
        self.weights, self.bias, self.curve = weights, bias, curve

    def values(self, words: list[str]) -> np.ndarray:
        return projected(words, self.weights[:, None])[:, 0] + self.bias

    def token_values(self, found: list[str]) -> list[float]:
        read = [strings(t) for t in found]
        flat = sorted({w for words in read for w in words})
        value = dict(zip(flat, self.values(flat).tolist(), strict=True))
        return [max((value[w] for w in words), default=NOTHING) for words in read]

    def score(self, features: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, float(np.dot(self.curve, [*features, 1.0]))))))


class Scorer:
    """Reads texts; values of tokens are remembered."""

    def __init__(self, model: Model, remembered: int = 400_000) -> None:
        self.memory = Memory(model.token_values, remembered)

    def features(self, texts: list[str]) -> list[list[float]]:
        """Largest value if negative, amount of values on the toxic side, whether there are any, and then among how many tokens."""
        return in_portions(texts, self._features)

    def _features(self, texts: list[str]) -> list[list[float]]:
        out = []
        found = [tokens(t) for t in texts]
        get = self.memory.look_up(found).__getitem__
        for own in found:
            value = [*map(get, own)]
            amount = sum([v - NEAR for v in value if v > NEAR])
            out.append([min(max(value, default=NOTHING), 0.0), math.log1p(amount), float(amount > 0), math.log1p(len(value)) if amount else 0.0])
        return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _curve(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic curve over the features, by damped Newton steps with a light ridge; every document counts once."""
    x = np.column_stack([features, np.ones(len(features))])
    up, down = toxic.sum(), (1 - toxic).sum()
    aim = np.where(toxic == 1, (up + 1) / (up + 2), 1 / (down + 2))
    theta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        grad = x.T @ (p - aim) + 1e-2 * theta
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        theta = theta - step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return theta


def train(texts: list[str], toxic: list[int], n_landmarks: int = 64, n_clean: int = 3000, n_hard: int = 1500, rounds: int = 3, witnesses_each: int = 2) -> Model | None:
    """Fit on labelled documents; None without both classes."""
    label = np.array(toxic)
    if not 0 < label.sum() < len(label):
        return None
    sentences = [[{w for token in tokens(s) for w in strings(token)} for s in SENTENCE_END.split(t)] for t in texts]
    read = [set().union(*of_text) for of_text in sentences]
    in_toxic, in_clean = Counter(), Counter()
    for words, y in zip(read, toxic, strict=True):
        (in_toxic if y else in_clean).update(words)
    n_toxic, n_not = int(label.sum()), int(len(label) - label.sum())
    accused = [[words for words in of_text if words] for of_text, y in zip(sentences, toxic, strict=True) if y and any(of_text)]
    if not accused or not in_clean:
        return None

    def testify(worse: Callable[[str], float], heard: Callable[[str], bool]) -> Counter[str]:
        """Of each toxic document the worst sentence is the one labelled toxic; its worst tokens bear witness."""
        order = lambda w: (-worse(w), w)
        worst = (min(of_text, key=lambda words: order(min(words, key=order))) for of_text in accused)
        return Counter(w for words in worst for w in sorted(words, key=order)[:witnesses_each] if heard(w))

    # How much more often toxic documents have a word, and how surely (standard deviations).
    odds, sure = {}, {}
    for w, n in in_toxic.items():
        p, q, both = (n + 0.5) / (n_toxic + 1), (in_clean[w] + 0.5) / (n_not + 1), (n + in_clean[w] + 1) / (n_toxic + n_not + 2)
        odds[w], sure[w] = p / q, (p - q) / math.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_not))
    clean = sorted(in_clean)
    clean = [clean[i] for i in np.random.default_rng(11).permutation(len(clean))]
    hard = sorted(in_clean, key=lambda w: (-in_clean[w], w))[:n_hard]
    witnesses = testify(sure.__getitem__, lambda w: sure[w] >= SURE and odds[w] >= ODDS)
    if not witnesses:
        return None
    own = sorted(in_toxic)
    for _ in range(rounds):
        marks = [w for w, _ in sorted(witnesses.items(), key=lambda x: (-x[1], x[0]))[:n_landmarks]]
        landmarks = list(dict.fromkeys([*marks, *clean[: n_landmarks // 2]]))
        table = subsequence_table(landmarks)
        scale, axes = np.linalg.eigh(projected(landmarks, table))
        project = axes[:, scale > 1e-6] / np.sqrt(scale[scale > 1e-6])
        positive = sorted(witnesses)
        negative = list(dict.fromkeys([*hard, *clean[:n_clean]]))
        x = projected([*positive, *negative], table) @ project
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        seen = np.array([float(in_toxic[w]) / (n_toxic + 2) for w in positive])
        unseen = np.array([float(in_clean[w]) / (n_not + 2) for w in negative])
        # Half of the cost of the clean words goes by how many documents have them.
        unseen = unseen / unseen.sum() / 2 + 0.5 / len(unseen)
        w = _machine(x, y, np.concatenate([seen / seen.sum(), unseen]) * COST)
        model = Model(table @ (project @ w[:-1]), float(w[-1]))
        value = dict(zip(own, model.values(own).tolist(), strict=True))
        witnesses = testify(lambda w, value=value: value[w] + sure[w] / 10, lambda w, value=value: value[w] > 0 and odds[w] >= ODDS) or witnesses
        clean_value = model.values(clean)
        hard += [clean[i] for i in np.argsort(-clean_value, kind="stable")[:n_hard]]
    model.curve = _curve(np.array(Scorer(model).features(texts)), label)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, slots: int) -> list[tuple[str, int]]:
    """At most ``slots`` texts of each class, chosen by a hash of their ids. Ids are chosen among the labels alone."""
    rows = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    rows = rows.withColumn("h", F.xxhash64("id"))
    least = rows.groupBy("y", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h"))
    chosen = {r["id"]: int(r["y"]) for r in rows.join(least.select("y", "h"), ["y", "h"]).select("id", "y").collect()}
    if not chosen:
        return []
    rows = docs.where(F.col(id_col).isin(list(chosen))).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # An id may stand for any number of texts; one of them is read.
    texts = rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    return sorted((r["text"] or "", chosen[r["id"]]) for r in texts)


def score(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", slots: int = 700) -> DataFrame:
    """id, score (0 to 1) and predicted (1 from 0.5 on) of every document. ``usable`` says which labels may be learnt from."""
    sample = labelled_sample(docs, labels, usable, id_col, text_col, label_col, slots)
    model = train([t for t, _ in sample], [y for _, y in sample])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value) if shipped.value else None
        for batch in slices(batches):
            with no_cycles():
                texts = batch.column(1).to_pylist()
                scores = [shipped.value.score(f) for f in scorer.features(texts)] if scorer else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["id", "score", "predicted"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)

"""Repeated passages against a plain dictionary of all strings."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clauselake.llm import repeats


def plain(rows, least):
    """(bytes, removed, runs, digest) of each row, by counting every string of ``least`` bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + least] for _, b in texts for k in range(len(b) - least + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if counts[b[k : k + least]] > 1:
                gone[k : k + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, least, parts=3, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in repeats.removed_passages(df, least=least, **more).collect()), key=str)


def made(seed, n, letters, longest):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [word(k) for k in (7, 11, 12, 13, 25, 60)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice([word(rng.randrange(12)), rng.choice(shared), rng.choice(shared)[rng.randrange(5) :]]) for _ in range(rng.randrange(longest)))
        rows.append((i, text))
    return rows + [(n, rows[1][1]), (n, rows[1][1]), (n + 1, None), (n + 2, ""), (None, rows[2][1] + "é" * 30), (n + 3, "z" * 40)]


@pytest.mark.parametrize("letters,seed", [("ab", 1), ("abcdeé日", 2), ("abcdefghijklmnop", 3)])
def test_equals_counting_all_strings(spark, letters, seed):
    rows = made(seed, 60, letters, 14)
    assert result(spark, rows, 12, seed=5) == plain(rows, 12)


@pytest.mark.parametrize("most", [1, 3])
def test_split_buckets(spark, most):
    """Buckets of more pieces than a task compares: cut by the distance from the anchor, at last to single strings."""
    rng = random.Random(7)
    line = "a common line "
    rows = [(i, "".join(rng.choice("abcd") for _ in range(rng.randrange(20))) + line + "".join(rng.choice("abcd") for _ in range(rng.randrange(20)))) for i in range(80)]
    assert result(spark, rows, 18, seed=6, most=most, splits=(5, 1)) == plain(rows, 18)


def test_hot_passages_at_full_length(spark):
    """The dealt length: copies, passages with and without other text around, a line below it in every text, a very long text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line, near = prose(75)[:430], prose(60)[:250], prose(300)
    rows = [(i, f"{prose(40)} {line} {prose(60)}") for i in range(60)]
    rows += [(100 + i, f"{prose(20)} {passage} {prose(9)}") for i in range(40)]
    rows += [(200 + i, near[: 150 * i] + "X" + near[150 * i :]) for i in range(8)]
    rows += [(300, prose(30_000) + passage + passage), (301, passage), (302, passage), (303, passage[:399]), (304, "q" * 2000)]
    for most in (1500, 10):
        assert result(spark, rows, 400, parts=4, most=most) == plain(rows, 400)


def test_groups_have_all_occurrences(spark):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    a, b = word(30), word(50)
    rows = [(i, word(20) + (a if i % 2 else b[:40] if i % 4 else b) + word(20)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: t.encode() for i, t in rows}
    found = {}
    for r in repeats.repeat_groups(df, least=20, seed=8).collect():
        found.setdefault(bytes(r.repeat), set()).add((r.doc_id, r.start, r.end))
    strings = set()
    for places in found.values():
        (string,) = {texts[i][s:e] for i, s, e in places}
        everywhere = {(i, k, k + len(string)) for i, t in texts.items() for k in range(len(t)) if t.startswith(string, k)}
        assert places == everywhere and len(places) > 1 and len(string) >= 20
        strings.add(string)
    assert len(strings) == len(found)


def test_odd_rows(spark, odd, no_docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in repeats.removed_passages(odd).collect()), key=str)
    assert got == plain(rows, 400)
    assert repeats.removed_passages(no_docs).count() == 0
    clash = odd.withColumns({"anchor": F.lit(1), "owner": F.lit("x"), "start": F.lit(2), "row": F.lit(3), "data": F.lit(4)})
    assert repeats.removed_passages(clash).count() == len(rows)

"""Keys of blocks: pairs at up to 10 percent of edits meet, whatever their length."""

import random

import numpy as np
import pytest

from clauselake.llm import edit_fingerprint as ef


def edited(rng, text, share):
    out = list(text)
    for _ in range(int(share * len(text))):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = rng.choice("abcdefghij klmnop")
        elif kind < 0.7:
            out.insert(at, rng.choice("abcdefghij klmnop"))
        else:
            del out[at]
    return "".join(out)


def words_text(rng, words, size):
    text = ""
    while len(text) < size:
        text += rng.choice(words) + " "
    return text[:size]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


@pytest.mark.parametrize("size", [400, 2000, 8000, 20000])
def test_pairs_meet_whatever_their_length(words, size):
    rng = random.Random(size)
    for share in (0.01, 0.03, 0.05, 0.1):
        met = 0
        for _ in range(40):
            text = words_text(rng, words, size)
            met += bool(set(ef.block_keys(text)) & set(ef.block_keys(edited(rng, text, share))))
        assert met >= 36, (size, share, met)


def test_block_keys_equal_a_walk_of_each_block():
    """Of texts with few runs every run has a key: keys are equal where runs and sampled steps of a walk by itself are."""
    rng = random.Random(9)
    made = ["", "abcde", "abcdef", "aaaaaaaaaaaaaaaa", "zabcdef", *("".join(rng.choice("ab") for _ in range(rng.randint(6, ef.RUN + ef.BLOCKS - 1))) for _ in range(60))]
    plain = []
    for text in made:
        codes = ef.classes(text)
        found = set()
        for k in range(len(codes) - ef.RUN + 1):
            run = bytes(codes[k : k + ef.RUN])
            if bytes(codes).index(run) == k:
                block = np.zeros(ef.BLOCK_CHARS, np.uint8)
                rest = codes[k + ef.RUN :][: ef.BLOCK_CHARS]
                block[: len(rest)] = rest
                came, _ = ef._walk_one(block, 0)
                found.add((run, *(int(block[np.flatnonzero(came <= s)[-1]]) for s in ef.BLOCK_STEPS)))
        plain.append(found)
    keys = [set(ef.block_keys(text)) for text in made]
    assert len(set().union(*keys)) == len(set().union(*plain))
    for a, x in zip(keys, plain, strict=True):
        assert len(a) == len(x)
        assert [len(a & b) for b in keys] == [len(x & y) for y in plain]


def test_long_texts_are_linked_and_others_not(spark, words):
    rng = random.Random(12)
    rows, want = [], {}
    for n in range(12):
        text = words_text(rng, words, rng.choice([30, 200, 1500, 6000]))
        for share in (0.0, 0.02, 0.06):
            want[len(rows)] = n
            rows.append((len(rows), edited(rng, text, share)))
    rows += [(1000, None), (1001, ""), (1002, "ab")]
    got = {r["doc_id"]: r["group_id"] for r in ef.near_edit_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] // 3 for i in want} == want and {got[i] for i in want} == {3 * n for n in range(12)}
    assert [got[1001], got[1002]] == [1001, 1002] or got[1000] == got[1001]


def test_distance_ends_early_above_the_limit():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        b = edited(rng, a, rng.choice([0.0, 0.1, 0.5])) if a and rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        whole = ef.edit_distance(a, b)
        for most in (0, 1, 3, 10, 50):
            found = ef.edit_distance(a, b, most)
            assert found == whole if whole <= most else found > most

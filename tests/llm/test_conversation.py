"""Damage, faults and edits against a plain reading: a search for the least cost and letters, turn by turn."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clauselake.llm import conversation

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Uniform-cost search over (turns read, last role written); of equal costs the least letters."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, letters, out
        new = NEXT[last]
        full = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 3, letters + "I", i, new, (*out, f"{full}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, new, (*out, f"{full}:{text}")))
                if role[:1] == new or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, role[:1], (*out, f"{role}:{text}")))


def plain(turns):
    shown = lambda x: " " if x is None else str(x)
    found = {}
    for conv, turn, role, text in turns:
        rows = found.setdefault(conv, [])
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        faults, seen = [], set()
        for _, role, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "ok")
            seen.add((role, text))
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, letters, repaired = cheapest([(r[1], r[2], f) for r, f in zip(rows, faults)])
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def result(df, segment):
    got = {}
    for row in conversation.repair_damaged(df, segment).collect():
        assert row.conv_id not in got
        got[row.conv_id] = tuple(row[c] for c in COLUMNS)
    return got


def made(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", "So. ", "Ich weiß nicht", "…", "a\x0b"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*texts, None, f"Turn {turn}.", f"Turn {turn}."])))
    return rows


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_equals_search(spark, segment):
    rows = made(segment, 150, 14) + [(None, 0, "user", "No id."), (None, 1, "assistant", "None."), (900, None, "user", "First."), (900, 0, "assistant", "Then."), (901, None, None, None)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(3), segment) == plain(rows)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert result(df, 4096) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_long_conversation_in_segments(spark):
    rows = [(7, k, "user" if k % 3 else "assistant", f"Words {k}" + "." * (k % 5 > 0) + "x" * (20_000 * (k == 11))) for k in range(700)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5), 16) == plain(rows)


def test_ties_do_not_depend_on_cuts(spark):
    """Turns that share a number and repeated rows: one order, whatever the parts and segments."""
    rows = [(c, t % 2, r, x) for c in range(20) for t, (r, x) in enumerate([("user", "A."), ("assistant", "B."), ("user", "A."), ("user", "A."), ("system", "C")])]
    df = spark.createDataFrame(rows, SCHEMA)
    first = result(df.repartition(1), 4096)
    assert all(result(df.repartition(n), s) == first for n, s in ((2, 1), (4, 2)))


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hello.")], SCHEMA).withColumns({"part": F.lit("x"), "cost": F.lit(1), "copy": F.lit(None).cast("int"), "place": F.lit(0)})
    assert result(df, 4096) == plain([(1, 0, "user", "Hello.")])
    assert result(df.where("false"), 4096) == {}


def test_states_are_few():
    """Costs differ by a bounded amount, so the table stays small however long the conversation."""
    rng, automaton = random.Random(5), conversation.Costs()
    automaton.scan([rng.choice(conversation.SIGNS) for _ in range(50_000)], automaton.state(conversation.END)[0])
    assert len(automaton.vectors) < 100

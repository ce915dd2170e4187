"""Conversation structure repair: faults of turns and the cheapest edits that make roles alternate.

A turn's first fault counts: blank (no word), duplicate (role and text came before in the
conversation), truncated (the last character that is no white space ends no sentence).
Edits keep a turn, give it another role, delete it or insert an empty one; the repaired
roles are an optional system turn, then user and assistant turns in turn. Of the cheapest
edits those whose initials come first in ASCII are taken.

The edits are a weighted automaton over turns. It is determinised lazily: a state is the
vector of least costs to the end from each role, less their minimum, and a table that
grows with the turns met holds each state's successors (``Costs``). Scanning a
conversation from its end through that table gives the costs; a trace from its beginning,
against the scan, follows the arcs whose cost is used up exactly, least letter first.

Conversations of any length are cut into segments. Tasks make one matrix of costs a
segment, a scan over a conversation's matrices gives each segment's vector at its end,
tasks trace each segment from every role it may be entered with, and a second scan
composes where the traces lead. No task holds more than a segment's turns, or the
matrices and letters of one conversation, whose audit has a letter a turn anyway. Only
the digest of the repaired turns, which is one hash of all, streams through one task.

Defined results: a null conversation id is a conversation of its own; null role and text
are one space, so such a turn is blank; a null turn comes first; turns with one number are
ordered by role and a hash of the text, equal ones side by side; roles other than system, user and
assistant can be kept where their initial fits; an empty table gives an empty result;
texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import written

#: What the repaired turns end with: nothing yet, a system, user or assistant turn.
STATES = ("", "s", "u", "a")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 10**12
#: The state after a turn with an initial, where that is allowed; what other role a turn can be given, or be inserted with.
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
GIVEN = {0: 2, 1: 2, 2: 3, 3: 2}
ROLES = {2: "user", 3: "assistant"}
#: Turns of a segment.
SEGMENT = 4096
#: A turn as the automaton reads it: initial and fault. Turns that must go have no initial.
MUST_GO = "-"

Vector = tuple[int, ...]


def symbol(initial: Column, fault: Column) -> Column:
    """One letter for deletion, or initial (``x`` for others) and ``t`` if truncated."""
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(fault.isin("blank", "duplicate"), F.lit(MUST_GO)).otherwise(F.concat(known, F.when(fault == "truncated", "t").otherwise("")))


def arcs(state: int, sign: str) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the ways for a turn from a state, least letter first."""
    found = [("D", DELETE, state)]
    if sign != MUST_GO:
        more = TRUNCATED if sign.endswith("t") else 0
        if (state, sign[0]) in KEPT:
            found.append(("K", KEEP + more, KEPT[state, sign[0]]))
        found.append(("R", REROLE + more, GIVEN[state]))
    return found


def _with_insertions(costs: list[int]) -> list[int]:
    """Least costs to the end if turns may be inserted first; the longest way of insertions has three steps."""
    for _ in STATES:
        costs = [min(c, INSERT + costs[GIVEN[q]]) for q, c in enumerate(costs)]
    return costs


class Costs:
    """The lazily determinised automaton, read from a conversation's end: its states are cost vectors less their minimum."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        self.table: list[dict[str, tuple[int, int]]] = []

    def state(self, costs: list[int]) -> tuple[int, int]:
        """State and minimum of a vector."""
        least = min(costs)
        vector = tuple(min(c - least, NEVER) for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append({})
        return self.numbers[vector], least

    def before(self, state: int, sign: str) -> tuple[int, int]:
        """The state before a turn, and what it adds."""
        known = self.table[state].get(sign)
        if known is None:
            after = self.vectors[state]
            known = self.table[state][sign] = self.state(_with_insertions([min(cost + after[to] for _, cost, to in arcs(q, sign)) for q in range(len(STATES))]))
        return known

    def scan(self, signs: list[str], state: int) -> tuple[list[int], list[int]]:
        """States before each turn and at the end, and what each turn adds."""
        states, added = [state], []
        for sign in reversed(signs):
            state, more = self.before(state, sign)
            states.append(state)
            added.append(more)
        return states[::-1], added[::-1]

    def trace(self, signs: list[str], states: list[int], added: list[int], at: int) -> tuple[list[str], int]:
        """Letters of each turn (insertions before it first), and the state at the end, from ``at`` along tight arcs."""
        out = []
        for sign, state, after, more in zip(signs, states[:-1], states[1:], added, strict=True):
            here, there = self.vectors[state], self.vectors[after]
            letters = ""
            while True:
                ways = [(letter, to) for letter, cost, to in arcs(at, sign) if cost + there[to] == here[at] + more]
                if INSERT + here[GIVEN[at]] == here[at]:
                    ways.append(("I", GIVEN[at]))
                letter, at = min(ways)
                letters += letter
                if letter != "I":
                    break
            out.append(letters)
        return out, at


#: Costs at a conversation's end.
END = [0, 2 * INSERT, INSERT, 0]
SIGNS = (MUST_GO, *(i + t for i in "suax" for t in ("", "t")))
#: Costs of a turn from each state to each state, insertions before it included.
_INSERTED = [[0 if a == b else min((INSERT * k for k, c in enumerate(path) if c == b), default=NEVER) for b in range(4)] for a, path in ((a, (a, GIVEN[a], GIVEN[GIVEN[a]])) for a in range(4))]


def times(x: list[list[int]], y: list[list[int]]) -> list[list[int]]:
    return [[min(min(a + y[k][j] for k, a in enumerate(row)), NEVER) for j in range(len(row))] for row in x]


def matrix(sign: str) -> list[list[int]]:
    step = [[min((cost for _, cost, to in arcs(a, sign) if to == b), default=NEVER) for b in range(4)] for a in range(4)]
    return times(_INSERTED, step)


MATRICES = {sign: matrix(sign) for sign in SIGNS}


# -- damage --------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of ``conv_id:turn``: 0 drops a turn, 1 empties it, 2 takes its stops, 3 repeats it, 4 makes it the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


# -- faults --------------------------------------------------------------------------------


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and fault (``ok`` if none); nulls are a space. Equal rows are numbered by copy."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    equal = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.md5("text"))
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    firsts = equal.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    met = equal.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    each = met.withColumn("repeats", place != F.col("first")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    last = F.rtrim(F.col("text"), F.lit("\x20\t\n\x0b\x0c\r"))
    fault = F.when(last == "", "blank").when(F.col("repeats") | (F.col("copy") > 1), "duplicate").when(~F.right(last, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("ok")
    return each.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))


# -- edits ---------------------------------------------------------------------------------


def _grouped(batches: Iterator[pa.RecordBatch], same: Callable[[tuple, tuple], bool], most: int | None = None) -> Iterator[list[tuple]]:
    """Runs of rows that are the ``same`` as their first one, at most so many."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (not same(held[0], row) or len(held) == most):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def edits(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row a turn: conv_id, turn, role, text, fault, part, seg, pos (their order), edits (its letters, insertions before it first), ending (insertions after a conversation's last turn), cost (on its last turn: the conversation's).

    ``turns`` has conv_id, turn, role and text, as ``damaged`` returns them.
    """
    rows = with_faults(turns)
    rows = rows.withColumn("sign", symbol(F.substring("role", 1, 1), F.col("fault")))
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "copy"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "turn", "role", "text", "fault", "sign")
    conv = ordered.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kinds = TaskContext.get().partitionId(), []
        names = ["conv_id", "turn", "role", "text", "fault", "sign", "part", "seg", "pos", "matrix"]

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield batch

        for seg, held in enumerate(_grouped(seen(), lambda a, b: a[0] == b[0], segment)):
            product = MATRICES[held[0][5]]
            for row in held[1:]:
                product = times(product, MATRICES[row[5]])
            n = len(held)
            columns = [*zip(*held, strict=True), [part] * n, [seg] * n, range(n), [*[None] * (n - 1), [c for line in product for c in line]]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    segments = written(ordered.mapInArrow(cut, f"conv_id {conv}, turn long, role string, text string, fault string, sign string, part int, seg long, pos int, matrix array<long>"), "turn-segments")
    sums = segments.where("matrix is not null").select("conv_id", "part", "seg", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(batches, lambda a, b: a[0] == b[0]):
            costs, out = END, []
            for _, part, seg, flat in reversed(held):
                out.append((part, seg, costs))
                costs = _with_insertions([min(flat[4 * a + b] + costs[b] for b in range(4)) for a in range(4)])
            part, seg, after = zip(*out[::-1], strict=True)
            last = [False] * (len(out) - 1) + [True]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seg, pa.int64()), pa.array(after, pa.list_(pa.int64())), pa.array(last), pa.array([costs[0]] * len(out), pa.int64())], names=["part", "seg", "after", "last", "cost"])

    after = written(sums.mapInArrow(ends, "part int, seg long, after array<long>, last boolean, cost long"), "segment-costs")
    placed = segments.select("part", "seg", "pos", "conv_id", "sign").join(after, ["part", "seg"]).select("part", "seg", "pos", "conv_id", "sign", "after", "last", "cost")
    placed = placed.repartition("part", "seg").sortWithinPartitions("part", "seg", "pos")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, kinds = Costs(), []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [pa.int32(), pa.int64(), pa.int32(), batch.schema.field(3).type, pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
                yield batch

        for held in _grouped(seen(), lambda a, b: a[:2] == b[:2]):
            signs = [row[4] for row in held]
            states, added = automaton.scan(signs, automaton.state(held[0][5])[0])
            ways = [automaton.trace(signs, states, added, at) for at in range(len(STATES))]
            n = len(held)
            columns = [*list(zip(*held, strict=True))[:4], [row[6] and k == n - 1 for k, row in enumerate(held)], [row[7] for row in held], list(zip(*(w[0] for w in ways), strict=True)), [*[None] * (n - 1), [w[1] for w in ways]]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["part", "seg", "pos", "conv_id", "last", "cost", "ways", "exits"])

    ways = written(placed.mapInArrow(traced, f"part int, seg long, pos int, conv_id {conv}, last boolean, cost long, ways array<string>, exits array<int>"), "segment-traces")
    leads = ways.where("exits is not null").select("conv_id", "part", "seg", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(batches, lambda a, b: a[0] == b[0]):
            at, out = 0, []
            for _, part, seg, exits in held:
                out.append((part, seg, at, exits[at]))
                at = exits[at]
            part, seg, entry, leave = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seg, pa.int64()), pa.array(entry, pa.int32()), pa.array(leave, pa.int32())], names=["part", "seg", "entry", "leave"])

    entered = written(leads.mapInArrow(entries, "part int, seg long, entry int, leave int"), "segment-entries")
    ending = F.when(F.col("last"), F.when(F.col("leave") == 1, "II").when(F.col("leave") == 2, "I").otherwise("")).otherwise("")
    found = segments.drop("sign", "matrix").join(ways.drop("conv_id", "exits"), ["part", "seg", "pos"]).join(entered, ["part", "seg"])
    return found.select("conv_id", "turn", "role", "text", "fault", "part", "seg", "pos", F.element_at("ways", F.col("entry") + 1).alias("edits"), ending.alias("ending"), "cost")


# -- digests -------------------------------------------------------------------------------


def audit(edited: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the conversations of ``edits``.

    A conversation's turns stream through one task in order; it holds the letters only.
    """
    rows = edited.select("conv_id", "part", "seg", "pos", "turn", "role", "text", "fault", "edits", "ending", "cost").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg", "pos")
    conv = rows.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict[str, Any]] = []
        now: dict[str, Any] = {}
        kind = pa.null()

        def close() -> None:
            if now:
                known = now["turns"]
                done.append({"conv_id": now["conv_id"], "gaps": now["last"] - now["first"] + 1 - known if known else 0, **{c: now[c] for c in counts[1:]}, "audit": "".join(now["letters"]), "repaired_sha256": now["hash"].hexdigest()})

        def batch_of() -> pa.RecordBatch:
            types = {"conv_id": kind, **dict.fromkeys(counts, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}
            out = pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in types.items()], names=list(types))
            done.clear()
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv_id, _, _, _, turn, role, text, fault, letters, ending, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not now or now["conv_id"] != conv_id:
                    close()
                    now = {"conv_id": conv_id, "turns": 0, "first": turn, "last": turn, **dict.fromkeys(counts, 0), "cost": cost, "before": None, "state": 0, "letters": [], "hash": hashlib.sha256(), "opened": False}
                if turn is not None:
                    if now["turns"] == 0:
                        now["first"] = turn
                    now["turns"] += now["turns"] == 0 or turn != now["last"]
                    now["last"] = turn
                if fault != "ok":
                    now[fault] += 1
                if now["before"] is not None:
                    now["illegal"] += now["before"] + role[:1] not in ("su", "ua", "au")
                now["before"] = role[:1]
                for letter in letters + ending:
                    now["letters"].append(letter)
                    if letter == "D":
                        continue
                    first = letter == "K" and now["state"] == 0 and role[0] == "s"
                    now["state"] = 1 if first else GIVEN[now["state"]]
                    shown = f"{role if letter == 'K' else ROLES[now['state']]}:{'' if letter == 'I' else text}"
                    now["hash"].update((f"\n{shown}" if now["opened"] else shown).encode())
                    now["opened"] = True
            if len(done) > 2000:
                yield batch_of()
        close()
        if done:
            yield batch_of()

    return rows.mapInArrow(told, f"conv_id {conv}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def repair_damaged(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``audit`` of the turns after ``damaged``; conversations of which nothing is left have zeros."""
    own = turns.select("conv_id", "turn", "role", "text")
    found = audit(edits(damaged(own), segment)).withColumnRenamed("conv_id", "found_id")
    whole = own.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.fillna(0, numbers).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})

"""Chat formatting with minimum-cost role repair.

Legal conversations: an optional system turn, then user and assistant turns in turn,
ending with an assistant's. A conversation is repaired by keeping, relabelling or
merging its turns (into the turn before) and by inserting empty ones, at the least
total cost; the repaired turns are then rendered.

The repair is a dynamic programme over the automaton of legal turns. A turn is a small
matrix of least costs from state to state; matrices of consecutive turns multiply
(minimum and sum). So a conversation of any length is cut into segments: tasks make one
matrix a segment, a scan over the matrices of a conversation gives the costs that are left
after each segment, tasks trace where the cheapest ways lead from each state before a
segment, a second scan gives the state that each is entered in, and tasks trace the choices
within segments. No task holds more than a segment's turns, or the matrices of one
conversation.

Defined results: turns are ordered by turn (null first), role and text hash; a null
conversation id is a conversation of its own; a null or unknown role has to be
relabelled, at a lower cost; null text is empty; repeated rows are turns each; of equally cheap repairs the one whose
roles are listed first, turn by turn, wherever segments are cut; a text is read whole; an empty
table gives an empty result; other columns are ignored. Marks within texts are broken
up, so that a text cannot pose as a turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.shared import written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
STATES = ("", *ROLES)
LEGAL = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
ALIASES = {"human": "user", "customer": "user", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant"}
#: Costs: another role for a turn, a role where none is known, joining the turn before, an empty turn.
RELABEL, LABEL, MERGE, INSERT = 3, 1, 1, 2
NEVER = 10**9
#: Turns of a segment.
SEGMENT = 512

Step = tuple[int, tuple[str, ...], str, str]  # cost, roles inserted before, action, role


def known_role(role: str | None) -> str:
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return role if role in ROLES else ""


def _insertions() -> dict[tuple[str, str], tuple[str, ...]]:
    """Fewest empty turns that lead from a state to another."""
    found: dict[tuple[str, str], tuple[str, ...]] = {(s, s): () for s in STATES}
    for _ in STATES:
        for (a, b), path in list(found.items()):
            for c in ROLES:
                if (b, c) in LEGAL and len(found.get((a, c), (0,) * 9)) > len(path) + 1:
                    found[a, c] = (*path, c)
    return found


INSERTIONS = _insertions()


def steps(role: str) -> dict[tuple[str, str], Step]:
    """The cheapest way for a turn of ``role`` to take each state to each other."""
    best: dict[tuple[str, str], Step] = {}
    for (start, at), inserted in INSERTIONS.items():
        ahead = INSERT * len(inserted)
        ways = [(ahead + (0 if role == new else RELABEL if role else LABEL), inserted, "keep" if role == new else "relabel", new) for new in ROLES if (at, new) in LEGAL]
        if at:
            ways.append((ahead + MERGE + (0 if role == at else RELABEL if role else LABEL), inserted, "merge", at))
        for way in ways:
            if (start, way[3]) not in best or way < best[start, way[3]]:
                best[start, way[3]] = way
    return best


STEPS = {role: steps(role) for role in ("", *ROLES)}
#: Empty turns that end a conversation in each state.
ENDINGS = {s: INSERTIONS[s, "assistant"] if s else () for s in STATES}
MATRICES = {role: [[STEPS[role].get((a, b), (NEVER,))[0] for b in STATES] for a in STATES] for role in STEPS}


def times(x: list[list[int]], y: list[list[int]]) -> list[list[int]]:
    return [[min(min(a + y[k][j] for k, a in enumerate(row)), NEVER) for j in range(len(STATES))] for row in x]


#: Costs to the end of a conversation from each state after its last turn.
END = [INSERT * len(ENDINGS[s]) if s else 0 for s in STATES]


def costs_to_go(matrix: list[list[int]], after: list[int]) -> list[int]:
    """Least costs to the end from each state before a segment, from those after it."""
    return [min(min(m + c for m, c in zip(row, after, strict=True)), NEVER) for row in matrix]


def trace(roles: list[str], after: list[int], at: int) -> tuple[list[tuple[Step, str]], int]:
    """The cheapest steps of consecutive turns (each with the state before it) from state ``at``, and the state at their end.

    Of several cheapest ways the one whose next state is listed first, turn by turn. What
    comes next decides only by its cost, so the way does not depend on where segments are cut.
    """
    to_go = [after]
    for role in reversed(roles):
        to_go.append(costs_to_go(MATRICES[role], to_go[-1]))
    to_go.reverse()
    out = []
    for role, here, there in zip(roles, to_go, to_go[1:], strict=False):
        step = next(b for b in range(len(STATES)) if MATRICES[role][at][b] + there[b] == here[at])
        out.append((STEPS[role][STATES[at], STATES[step]], STATES[at]))
        at = step
    return out, at


def _shown(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def _turn(role: str, text: str | None, opens: bool) -> str:
    return ("" if opens else "<|end|>\n") + f"<|{role}|>\n{_shown(text)}"


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per turn and inserted turn: conv, place, turn, action, role, cost, rendered.

    ``place`` orders the rows of a conversation; its ``rendered`` pieces in that order
    are the conversation's text. ``turn`` is null for inserted turns.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    conv_type = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "turn", "role", "text", "part", "seg", "pos", "known", "matrix"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        seg = 0

        def close() -> pa.RecordBatch:
            product = MATRICES[known_role(held[0][2])]
            for row in held[1:]:
                product = times(product, MATRICES[known_role(row[2])])
            flat = [c for line in product for c in line]
            n = len(held)
            columns = [*zip(*held, strict=True), [part] * n, [seg] * n, range(n), [known_role(h[2]) for h in held], [*[None] * (n - 1), flat]]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

        kinds: list = []
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or len(held) >= segment):
                    yield close()
                    held, seg = [], seg + 1
                held.append(row)
        if held:
            yield close()

    cut_rows = written(ordered.mapInArrow(cut, f"conv {conv_type}, turn long, role string, text string, part int, seg long, pos int, known string, matrix array<int>"), "segments")
    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition("conv").sortWithinPartitions("conv", "part", "seg")

    def each_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(STATES)
        for held in each_conversation(batches):
            costs, after = END, []
            for *_, flat in reversed(held):
                after.append(costs)
                costs = costs_to_go([flat[i * n : i * n + n] for i in range(n)], costs)
            columns = [pa.array([h[1] for h in held], pa.int32()), pa.array([h[2] for h in held], pa.int64()), pa.array(after[::-1], pa.list_(pa.int32())), pa.array([False] * (len(held) - 1) + [True])]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "seg", "after", "ends"])

    matrices = cut_rows.where("matrix is not null").select("conv", "part", "seg", "matrix")
    costs = written(in_order(matrices).mapInArrow(scan, "part int, seg long, after array<int>, ends boolean"), "segment-costs")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the cheapest ways lead from each state before a segment that they can be in."""
        for batch in batches:
            exits = []
            for roles, after in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                exits.append([trace(roles, after, at)[1] for at in range(len(STATES))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(exits, pa.list_(pa.int32()))], names=["conv", "part", "seg", "exits"])

    told = cut_rows.groupBy("conv", "part", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "known"))).alias("turns")).select("conv", "part", "seg", F.col("turns.known").alias("roles"))
    leads = written(told.join(costs, ["part", "seg"]).select("conv", "part", "seg", "roles", "after").mapInArrow(lead, f"conv {conv_type}, part int, seg long, exits array<int>"), "segment-leads")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in each_conversation(batches):
            entries = [0]
            for *_, exits in held:
                entries.append(exits[entries[-1]])
            yield pa.RecordBatch.from_arrays([pa.array([h[1] for h in held], pa.int32()), pa.array([h[2] for h in held], pa.int64()), pa.array(entries[:-1], pa.int32()), pa.array(entries[1:], pa.int32())], names=["part", "seg", "first", "last"])

    entries = written(in_order(leads).mapInArrow(enter, "part int, seg long, first int, last int"), "segment-entries")
    placed = cut_rows.drop("matrix", "known").join(costs, ["part", "seg"]).join(entries, ["part", "seg"]).repartition("part", "seg").sortWithinPartitions("part", "seg", "pos")

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> list[tuple]:
            head = held[0]
            out = []

            def note(turn: int | None, action: str, role: str, cost: int, text: str) -> None:
                out.append((head["conv"], head["part"], head["seg"], len(out), turn, action, role, cost, text))

            opens = head["first"] == 0
            for row, ((cost, inserted, action, role), _) in zip(held, trace([known_role(h["role"]) for h in held], head["after"], head["first"])[0], strict=True):
                for new in inserted:
                    note(None, "insert", new, INSERT, _turn(new, "", opens))
                    opens = False
                own = cost - INSERT * len(inserted)
                note(row["turn"], action, role, own, f"\n\n{_shown(row['text'])}" if action == "merge" else _turn(role, row["text"], opens))
                opens = False
            if head["ends"]:
                for new in ENDINGS[STATES[head["last"]]]:
                    note(None, "insert", new, INSERT, _turn(new, "", False))
                out[-1] = (*out[-1][:8], out[-1][8] + "<|end|>\n")
            return out

        def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "part", "seg", "pos", "turn", "action", "role", "cost", "rendered"])

        done: list[tuple] = []
        kind = None
        for batch in batches:
            kind = batch.schema.field(batch.schema.get_field_index("conv")).type
            for row in batch.to_pylist():
                if held and (row["part"], row["seg"]) != (held[0]["part"], held[0]["seg"]):
                    done += close()
                    held = []
                    if len(done) > 2000:
                        yield batch_of(done, kind)
                        done = []
                held.append(row)
        if held:
            done += close()
        if done:
            yield batch_of(done, kind)

    out = placed.mapInArrow(write_out, f"conv {conv_type}, part int, seg long, pos int, turn long, action string, role string, cost int, rendered string")
    place = F.struct("part", "seg", "pos").alias("place")
    return out.select(F.col("conv").alias(conv_col), place, F.col("turn").alias(turn_col), "action", F.col("role").alias(role_col), "cost", "rendered")

"""Mix sources to target weights by a minimum-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources
form a pattern. The flow has one node per pattern and one per source:

* start -> pattern, one arc per repetition: as much as the pattern's size, at cost
  0, 1, 2, ... for the first, second, third, ... reading (convex: every pattern is
  read once before any is read twice);
* pattern -> each of its sources, without limit;
* source -> end, as much as the source's target.

A path's cost is that of its first arc alone, so the cheapest flow is found by
adding the arcs of one repetition after another and filling up (augmenting paths)
after each. Only pattern sums reach the driver: there are as many as different sets
of sources, which ``max_patterns`` bounds; more raise an error.

The flow through a pattern is turned into documents in a seeded order: document
readings are laid end to end in that order, and a reading is taken if its middle
lies below the flow. So every source is within half a document of what the flow
gave it, and no document is read more often than ``max_epochs``.

Defined results: a null or empty text has size 0 and is taken 0 times over; a null
source is a source of its own, after all others; repeated rows count each; rows that
the seed puts in one place follow each other by id and size; a text is as long as its
words, however long. Other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.llm.shared import WORD, written

#: Parts of each pattern's seeded order (leading hex digits of an md5).
ORDER_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(names: Sequence[str | None], cycle: Sequence[float] = (5, 2, 1)) -> dict[str | None, float]:
    """Weights that repeat over the sources by code point, null last."""
    ordered = sorted((n for n in names if n is not None)) + [None] * (None in names)
    return {name: cycle[i % len(cycle)] for i, name in enumerate(ordered)}


def capped_targets(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Share ``share`` times all sizes by weight; what exceeds ``cap`` times a source's size goes to the others."""
    left, weight = share * sum(sizes.values()), sum(weights[s] for s in sizes)
    targets: dict = {}
    # Sources reach their cap in the order of cap by weight.
    for s in sorted(sizes, key=lambda s: (cap * sizes[s] / weights[s], s is None, s or "")):
        level = left / weight if weight else 0.0
        if level * weights[s] <= cap * sizes[s]:
            break
        targets[s] = float(cap * sizes[s])
        left, weight = left - targets[s], weight - weights[s]
    level = left / weight if weight else 0.0
    return {s: targets.get(s, level * weights[s]) for s in sizes}


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, max_epochs: int) -> dict[tuple, int]:
    """Tokens from each pattern to each of its sources: {(pattern, source): tokens}."""
    flow = {(p, s): 0 for p in patterns for s in p}
    room = {s: int(q) for s, q in quotas.items()}
    inside: dict = {}
    for p in patterns:
        for s in p:
            inside.setdefault(s, []).append(p)
    for _ in range(max_epochs):
        spare = dict(patterns)
        for p in patterns:  # most need no detour
            for s in p:
                moved = min(spare[p], room.get(s, 0))
                flow[p, s] += moved
                spare[p] -= moved
                room[s] = room.get(s, 0) - moved
        stuck: set = set()  # from here no source with room is reached in this round
        for p in patterns:
            while spare[p] and p not in stuck and (path := _detour(p, flow, room, inside, stuck)):
                moved = min(spare[p], room[path[-1][1]], *(flow[q, s] for (_, s), (q, _) in zip(path, path[1:], strict=False)))
                for (q, s), after in zip(path, [*path[1:], None], strict=True):
                    flow[q, s] += moved
                    if after:
                        flow[after[0], s] -= moved
                spare[p] -= moved
                room[path[-1][1]] -= moved
    return flow


def _detour(start: tuple, flow: dict, room: dict, inside: dict, stuck: set) -> list | None:
    """A path of (pattern, source) steps from ``start`` to a source with room, moving others' tokens aside.

    Without one, all patterns that were reached are stuck: later paths cannot pass them.
    """
    came: dict = {start: None}
    todo = deque([start])
    while todo:
        p = todo.popleft()
        for s in p:
            if room.get(s, 0) > 0:
                path = [(p, s)]
                while came[path[0][0]]:
                    path.insert(0, came[path[0][0]])
                return path
            for q in inside[s]:
                if q not in came and q not in stuck and flow[q, s] > 0:
                    came[q] = (p, s)
                    todo.append(q)
    stuck.update(came)
    return None


def mix(
    docs: DataFrame,
    members: Column,
    size: Column,
    weights: Callable[[Sequence[str | None]], dict] = cyclic_weights,
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    max_patterns: int = 100_000,
    tag: Column | None = None,
) -> DataFrame:
    """One row per document: id, members, size, source_size, target, epochs, taken, by_source, and the column ``tag`` if it is given.

    ``members`` is an array of the sources that a document belongs to (null stands
    for a source without a name), ``size`` a long. ``source_size`` and ``target``
    are those of the document's first source; ``by_source`` lists the source that
    each taken reading counts for.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.array_sort(F.array_distinct(members)).alias("members"), size.alias("size"), (F.lit(0) if tag is None else tag).alias("tag"))
    rows = rows.withColumn("members", F.when(F.size("members") > 0, F.col("members")).otherwise(F.array(F.lit(None).cast("string"))))
    rows = written(rows.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))))), "sized")
    sums = rows.groupBy("members").agg(F.sum("size").alias("size"))
    found = sums.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} different sets of sources")
    patterns = {tuple(r["members"]): int(r["size"] or 0) for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = capped_targets(sizes, weights(list(sizes)), share, max_epochs) if sizes else {}
    flow = min_cost_flow(patterns, targets, max_epochs)

    plan, ends = [], []
    for p, n in patterns.items():
        end = 0
        for s in p:
            end += flow[p, s]
            ends.append((s, end))
        plan.append((list(p), n, sizes[p[0]], float(targets[p[0]]), [{"source": s, "end": e} for s, e in ends[-len(p) :]]))
    schema = "members array<string>, pattern_size long, source_size long, target double, lanes array<struct<source:string,end:long>>"
    plan_df = spark.createDataFrame(plan, schema)

    part = F.substring("order", 1, ORDER_DIGITS)
    parts = rows.groupBy("members", part.alias("part")).agg(F.sum("size").alias("part_size"))
    before = F.sum("part_size").over(Window.partitionBy("members").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("members", "part", F.coalesce(before, F.lit(0)).alias("part_start"))
    within = Window.partitionBy("members", "part").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("part", part).withColumn("upto", F.sum("size").over(within))
    placed = placed.join(parts, ["members", "part"]).join(plan_df, "members")

    # Twice the middle of each reading keeps the arithmetic in whole numbers.
    start = F.col("part_start") + F.col("upto") - F.col("size")
    readings = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: 2 * (e * F.col("pattern_size") + start) + F.col("size"))
    taken = F.filter(readings, lambda middle: middle < 2 * F.element_at("lanes", -1)["end"])
    lane = F.transform(taken, lambda middle: F.element_at(F.filter("lanes", lambda x: middle < 2 * x["end"]), 1)["source"])
    return placed.withColumn("by_source", F.when(F.col("size") > 0, lane).otherwise(F.array().cast("array<string>"))).select(
        F.col("id").alias(id_col), "members", "size", "source_size", "target", F.size("by_source").alias("epochs"), (F.size("by_source") * F.col("size")).cast("long").alias("taken"), "by_source", *([] if tag is None else ["tag"])
    )


def mixed(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, with their columns.

    Rows that share an id are each taken as often as the mix says; of rows that are equal
    in every column, one is given out as often as all of them are taken.
    """
    whole = [F.col(f"`{c}`") for c in docs.columns]
    tag = F.struct(F.xxhash64(*whole).alias("a"), F.hash(*whole).alias("b"))
    chosen = mix(docs, F.array(F.col(f"`{source_col}`")), n_words(F.col(f"`{text_col}`")), id_col=id_col, tag=tag, **options)
    chosen = chosen.where("epochs > 0").groupBy("tag").agg(F.sum("epochs").cast("int").alias("times"))
    rows = docs.select(tag.alias("tag"), F.struct(*whole).alias("row")).dropDuplicates(["tag"])
    return rows.join(chosen, "tag").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")

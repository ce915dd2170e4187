"""Groups of documents that share keys, without listing the pairs of a key.

Both MinHash and edit-distance dedup reduce to this: every node has keys; nodes that
share a key may be linked; a link is confirmed on the whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.components import counted_components
from clauselake.llm.shared import counted, sized, slices, written

#: Parts of a leader's members; each part has a copy of what is known of the leader.
SHARES = 512


def _share(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SHARES)).cast("int")


def texts_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of those ``docs`` that are among ``nodes``, written once for all rounds of ``confirmed``."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return written(texts.hint("merge").join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), "candidates")


def confirmed(pairs: DataFrame, texts: DataFrame, prepare: Callable[[str | None], Any], alike: Callable[[Any, Any], bool]) -> DataFrame:
    """Those of ``pairs`` (node, leader) whose texts are alike, as links u, v.

    Members of a leader are dealt out in shares, each with one copy of the leader's
    text; a share is compared row by row behind its leader.
    """
    members = pairs.select(F.col("node").alias("id"), "leader", _share("node").alias("share"), F.lit(1).alias("member"))
    heads = members.select(F.col("leader").alias("id"), "leader", "share", F.lit(0).alias("member")).distinct()
    met = members.unionByName(heads).join(texts, "id").repartition("leader", "share").sortWithinPartitions("leader", "share", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []  # an id can stand for several texts
        for batch in slices(batches):
            u, v = [], []
            for node, leader, share, member, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (leader, share) != group:
                    group, leaders = (leader, share), []
                own = prepare(text)
                if not member:
                    leaders.append(own)
                elif any(alike(own, other) for other in leaders):
                    u.append(node)
                    v.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return met.select("id", "leader", "share", "member", "text").mapInArrow(run, "u long, v long")


def _likely(pairs: DataFrame, sketches: DataFrame, may_link: Callable[[str, str], Column]) -> DataFrame:
    """Those of ``pairs`` that their sketches allow. A leader's sketch goes to each share of its members."""

    def named(column: str, name: str) -> DataFrame:
        return sketches.select(F.col("node").alias(column), *[F.col(c).alias(f"{c}_{name}") for c in sketches.columns if c != "node"])

    members = pairs.withColumn("share", _share("node")).join(named("node", "a"), "node")
    heads = pairs.select("leader", _share("node").alias("share")).distinct().join(named("leader", "b"), "leader")
    return members.join(heads, ["leader", "share"]).where(may_link("a", "b")).select("node", "leader")


def linked(
    keys: DataFrame,
    sketches: DataFrame,
    may_link: Callable[[str, str], Column],
    confirm: Callable[[DataFrame, DataFrame], DataFrame],
    candidates: Callable[[DataFrame], DataFrame],
    finer: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    cross_budget: int = 16,
) -> DataFrame:
    """Components of the links among nodes that share a key: u and v, the least node of u's component.

    ``keys`` has columns node and key. ``sketches`` has a row per node; ``may_link``
    says, by the sketches of two sides, whether a pair has to be confirmed.
    ``candidates`` reads once what ``confirm`` needs of the nodes that share keys.

    1. Every node is compared with one other: of the least nodes of its keys, the one
       that it shares most keys with.
    2. Only keys that still hold different components are looked at. In each round
       every node of such a key is compared with the key's leaders, one in the first
       round and twice as many in each later one, other ones each time; what they link
       is no longer across. Rounds end when one adds less than a tenth to the links.
    3. All pairs across components that are left are compared, so none is dropped. A
       key with more than ``cross_budget`` such pairs a row is not paired itself: its
       nodes get the ``finer`` keys, at least one of which any two that can be linked share.
    """
    # Only keys that several nodes share are looked at again.
    several = written(keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("key", "leader"), "several")
    shared, n = counted(keys.join(several, "key"), "shared-keys")
    texts = candidates(shared.select("node"))
    common = shared.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c"))
    nearest = common.groupBy("node").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader"))
    tested, n_pairs = counted(sized(_likely(nearest, sketches, may_link), n), "pairs")
    labels, known = counted_components(confirm(tested, texts), n_pairs)

    leaders, more = 1, True
    while True:
        # Rows of keys that still hold several components.
        placed = shared.select("key", "node").join(labels.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = written(sized(placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"), n), "split-keys")
        open_rows, n_open = counted(sized(placed.join(split, "key"), n), "open-keys")
        if not more:
            break
        order = F.xxhash64("node", F.lit(leaders))
        chosen = open_rows.groupBy("key", F.pmod(order, F.lit(leaders)).alias("part")).agg(F.min_by(F.struct(F.col("node").alias("leader"), F.col("root").alias("other")), order).alias("x"))
        met = open_rows.join(written(sized(chosen.select("key", "x.*"), n_open), "leaders"), "key").where("root <> other").select("node", "leader").distinct()
        pairs, n_pairs = counted(sized(_likely(met.join(tested, ["node", "leader"], "left_anti"), sketches, may_link), leaders * n_open), "pairs")
        labels, count = counted_components(labels.unionByName(confirm(pairs, texts)), known + n_pairs)
        tested = tested.unionByName(pairs)
        leaders, known, more = 2 * leaders, count, 10 * (count - known) > count

    if finer:
        by_root = open_rows.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("g"), F.sum(F.col("c") * F.col("c")).alias("q"))
        heavy = written(sized(by_root.where((F.col("g") * F.col("g") - F.col("q")) / 2 > cross_budget * F.col("g")).select("key"), n_open), "heavy-keys")
        of_heavy = open_rows.join(heavy, "key", "left_semi").select("node", "root").distinct()
        open_rows = open_rows.join(heavy, "key", "left_anti").unionByName(finer(of_heavy.select("node"), texts).join(of_heavy, "node").select("key", "node", "root"))
    described = written(open_rows.join(sketches, "node"), "open-sketches")
    a = described.select("key", *[F.col(c).alias(f"{c}_a") for c in described.columns if c != "key"])
    b = described.select("key", *[F.col(c).alias(f"{c}_b") for c in described.columns if c != "key"])
    met = a.join(b, "key").where((F.col("root_a") != F.col("root_b")) & (F.col("node_a") > F.col("node_b")) & may_link("a", "b"))
    rest = met.select(F.col("node_a").alias("node"), F.col("node_b").alias("leader")).distinct()
    either = tested.unionByName(tested.select(F.col("leader").alias("node"), F.col("node").alias("leader")))
    rest, n_pairs = counted(rest.join(either, ["node", "leader"], "left_anti"), "pairs")
    return counted_components(labels.unionByName(confirm(rest, texts)), known + n_pairs)[0]

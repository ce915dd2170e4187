"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clauselake.llm.shared import counted, sized, written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns u and v. Returns one row per linked node that is not the least of its component: u, v = the least."""
    return counted_components(links)[0]


def counted_components(links: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """``components`` and the number of its rows. ``most``: a bound of the links, if one is known.

    Each round is written to the shared folder; the rounds grow with the logarithm of
    the longest chain. Only a count and a checksum, taken as a round is written, reach
    the driver.
    """
    links = links.select("u", "v").where("u <> v").distinct()
    now, n = counted(links if most is None else sized(links, most), "links")
    seen = None
    while True:
        state = Observation()
        measures = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")
        # A star of n links gives at most two links for each.
        now = written(sized(_small_star(_large_star(now)).distinct().observe(state, *measures), 2 * n), "stars")
        if state.get == seen:
            return now, state.get["n"]
        seen, n = state.get, state.get["n"]

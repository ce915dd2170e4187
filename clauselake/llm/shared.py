"""Folder shared by the driver and all executors, and tables written there.

Operators cut lineage by writing a table into the folder that the cluster names
in ``spark.checkpoint.dir``. A written table survives the loss of any executor,
and later stages read it column by column.
"""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word in the word counts and shingles (ASCII only).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where it names none (tests) a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/clauselake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it (lineage ends there)."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a part, where a table is known to have few.
ROWS_A_PART = 200_000


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df``, which has at most ``most`` rows, dealt anew into no more parts than these fill; what makes ``df`` keeps its own tasks."""
    parts = max(1, math.ceil(most / ROWS_A_PART))
    return df.repartition(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, counted as they are written."""
    state = Observation()
    table = written(df.observe(state, F.count("*").alias("n")), label)
    return table, state.get["n"]


def ascii_lower(text):
    """Lower-case A-Z only; null stays null."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def no_cycles() -> Iterator[None]:
    """Code in a task that makes many small objects and no cycles; the collector would visit them all again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_HELD: dict[Hashable, Any] = {}


def held_by_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one operator's state, dropped when another asks."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task makes of the texts of one is small beside the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches of about ``most`` bytes of a column of text; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
            yield batch.slice(at, end - at)
            at = end

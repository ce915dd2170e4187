"""Tables that a plan reads more than once, written to the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. In local mode a new one, where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/clauselake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it. Its lineage ends there, and nothing before it runs again."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``written``, and what ``sums`` of all rows come to, taken as they are written."""
    state = Observation()
    table = written(df.observe(state, *[c.alias(name) for name, c in sums.items()]), label)
    return table, state.get


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to twice as many tasks as the cluster has cores, where fewer tasks than that have rows (large files of few row groups)."""
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.select(F.spark_partition_id()).distinct().count() >= tasks else df.repartition(tasks, key)

"""Documents that arrive over time: each micro-batch replaces its documents in the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clauselake.operators.chunking import ingest
from clauselake.sources.store import Table


def follow_pages(spark: SparkSession, folder: str, chunks: Table, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet files of pages (doc, page_number, text) from ``folder``, whole documents at a time, to ``chunks``.

    A micro-batch that is repeated replaces the same documents, so chunks stay as they are.
    """
    pages = spark.readStream.schema("doc string, page_number int, text string, needs_ocr boolean").parquet(folder)

    def store(batch: DataFrame, _: int) -> None:
        read = batch.sparkSession.createDataFrame([], "doc string, page_number int, text string")
        chunks.replace(ingest(batch, read), "doc", batch.select("doc").distinct())

    writer = pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()



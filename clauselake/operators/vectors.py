"""Vectors of chunks: embedding backends, upsert by point, deletion by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import point_id
from clauselake.operators.retrieval import embed_text
from clauselake.sources.store import last_by, replace_by

DIMENSION = 1024


def hashed_ngrams(dimension: int = DIMENSION, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: signed counts of character n-grams, by hash."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            for i in range(max(1, len(text) - n + 1)):
                h = xxhash.xxh3_64_intdigest(text[i : i + n])
                row[h % dimension] += 1 if h >> 63 else -1
        return out

    return embed


def embed(rows: DataFrame, key: str, text: str, make_model: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_ngrams) -> DataFrame:
    """key and embedding (unit length, array<float>); the model is made once a task."""
    asked = rows.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            vectors = np.asarray(model(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = (vectors / np.where(lengths == 0, 1, lengths)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["key", "embedding"])

    return asked.mapInArrow(run, f"key {asked.schema['key'].dataType.simpleString()}, embedding array<float>").withColumnRenamed("key", key)


def chunk_vectors(chunks: DataFrame, make_model: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_ngrams) -> DataFrame:
    """Points of chunks. Of chunks with one id the last becomes the point."""
    rows = last_by(chunks, "id", "chunk_seq").withColumn("embedded", embed_text(F.col("doc"), F.col("chapter"), F.col("clause"), F.col("text")))
    vectors = embed(rows, "id", "embedded", make_model)
    return rows.join(vectors, "id").select(point_id("id").alias("point_id"), F.col("id").alias("chunk_id"), "doc", "clause", "chapter", "text", "embedding")


def upsert(existing: DataFrame, points: DataFrame) -> DataFrame:
    return replace_by(existing, points, "point_id")


def reindex(existing: DataFrame, chunks: DataFrame, docs: DataFrame, make_model: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_ngrams) -> DataFrame:
    """Vectors after the points of ``docs`` are made anew; documents without chunks lose theirs. Only these are embedded."""
    docs = docs.select("doc").distinct()
    points = chunk_vectors(chunks.join(docs, "doc", "left_semi"), make_model)
    return existing.join(docs, "doc", "left_anti").unionByName(points)


def dimension(vectors: DataFrame) -> int | None:
    """The one length that all embeddings have; null if there are none, an error if they differ."""
    least, most = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError(f"embeddings of {least} to {most} numbers in one collection")
    return least


def fitting(points: DataFrame, existing: DataFrame, remedy: str = "index all documents anew") -> DataFrame:
    """``points``, if their embeddings are as long as those that they join or meet; else an error that names both lengths."""
    new, old = dimension(points), dimension(existing)
    if new is not None and old is not None and new != old:
        raise ValueError(f"embeddings have {new} numbers, those of the collection {old}; {remedy}")
    return points

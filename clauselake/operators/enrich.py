"""OCR of pages: only flagged ones, read from a cache first, with retries and growing contexts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import col
from clauselake.operators.answers import Retry, cached_calls
from clauselake.operators.backends import Reader

#: Context sizes that a local reader is given one after another.
CONTEXTS = (8192, 16384, 32768)


def reader(named: Reader) -> tuple[Callable[[str], str], Column]:
    """What ``ocr`` calls for a registered reader, and the reader's part of a page's key."""
    return escalating(named.read, named.sizes), model_key(F.lit(named.backend), F.lit(named.model))


def model_key(backend: Column | str, model: Column | str) -> Column:
    return F.replace(F.concat_ws("_", col(backend), col(model)), F.lit("/"), F.lit("_"))


def page_key(sha256: Column | str, model: Column | str, page: Column | str) -> Column:
    """Key of a page in the cache: file hash, model, page number."""
    return F.concat_ws("/", col(sha256), col(model), col(page).cast("string"))


def escalating(read: Callable[[str, int], tuple[str, bool]], sizes: Sequence[int] = CONTEXTS) -> Callable[[str], str]:
    """A reader that is given a larger context while its answer is cut off; at the end the best it could do counts."""

    def call(page: str) -> str:
        text = ""
        for size in sizes:
            text, cut_off = read(page, size)
            if not cut_off:
                break
        return text

    return call


def ocr(pages: DataFrame, cache: DataFrame, backend: Callable[[str], str], retry: Retry | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc, page_number, text, error for flagged pages, and rows to add to the cache.

    ``pages``: doc, page_number, needs_ocr, key (see ``page_key``). A page whose reading
    fails has a null text and the error. ``force`` reads pages again that are cached.
    """
    flagged = pages.where("needs_ocr").select("doc", "page_number", "key")
    known = cache.limit(0) if force else cache
    read, fresh = cached_calls(flagged.withColumn("request", F.col("key")), known, "key", "request", backend, retry or Retry(any_failure=True))
    return flagged.join(read, "key").select("doc", "page_number", F.col("response").alias("text"), "error"), fresh

"""Contexts, prompts, citations and answers, as columns over a batch of questions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.text import arabic_digits, col, strip
from clauselake.operators.retrieval import few
from clauselake.sources.scratch import measured, written
from clauselake.sources.store import Table

# Wording that models and tests depend on, and the retry policy.
REFUSAL = "ไม่พบข้อมูลที่เกี่ยวข้องในเอกสารที่มี"
CONTEXT_HEAD, QUESTION_HEAD = "เอกสารอ้างอิง:\n\n", "\n\nคำถาม: "
SOURCES_HEAD = "\nแหล่งอ้างอิง:"
NO_SOURCES = "(คำตอบล่าสุดไม่ได้อ้างอิงเอกสาร)"
TOP_K = 5
ATTEMPTS, FIRST_DELAY = 5, 2
RETRYABLE = (429, 500, 502, 503, 504)
DAILY_QUOTA = "PerDay"
#: Most portions in which calls go out.
PORTIONS = 200


def source_label(doc: Column, clause: Column, chapter: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(", ", F.nullif(doc, blank), F.nullif(clause, blank), F.nullif(chapter, blank))


def contexts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, contexts: the hit chunks in rank order (a few a query), as structs. Hits travel to the chunks where they are few: texts of other chunks do not travel."""
    chunk = F.struct("rank", "chunk_id", "doc", "clause", "chapter", "text")
    found, seen = measured(hits, "hits", n=F.count("*"))
    return chunks.join(few(found, seen["n"]), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("contexts"))


def numbered_context(found: Column | str) -> Column:
    """Numbered blocks of label and text."""
    block = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), source_label(c["doc"], c["clause"], c["chapter"]), F.lit(")\n"), strip(c["text"]))
    return F.array_join(F.transform(col(found), block), "\n\n")


def prompt(question: Column | str, found: Column | str) -> Column:
    return F.concat(F.lit(CONTEXT_HEAD), numbered_context(found), F.lit(QUESTION_HEAD), col(question))


def citations(answer: Column | str, n_contexts: Column | str) -> Column:
    """Numbers in square brackets that stand for a context, each once, in the order found."""
    numbers = F.transform(F.regexp_extract_all(col(answer), F.lit(r"(?U)\[(\d+)\]"), F.lit(1)), lambda n: arabic_digits(n).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= col(n_contexts))))


def refused(answer: Column | str, sources: Column | str) -> Column:
    """The refusal is said and nothing is cited."""
    return F.contains(col(answer), F.lit(REFUSAL)) & (F.size(col(sources)) == 0)


def without_thoughts(text: Column | str) -> Column:
    return strip(F.regexp_replace(col(text), r"(?s)<think>.*?</think>", ""))


def cited_sources(numbers: Column | str, found: Column | str) -> Column:
    """The contexts cited, by number."""
    return F.transform(F.array_sort(col(numbers)), lambda n: F.get(col(found), n - 1))


def formatted(answer: Column | str, numbers: Column | str, found: Column | str) -> Column:
    """The answer and, below it, the sources under the numbers it uses."""

    def line(n: Column) -> Column:
        c = F.get(col(found), n - 1)
        return F.concat(F.lit("  ["), n.cast("string"), F.lit("] "), source_label(c["doc"], c["clause"], c["chapter"]))

    listed = F.array_join(F.transform(F.array_sort(col(numbers)), line), "\n")
    return F.when(F.size(col(numbers)) > 0, F.concat_ws("\n", col(answer), F.lit(SOURCES_HEAD), listed)).otherwise(col(answer))


def formatted_sources(numbers: Column | str, found: Column | str) -> Column:
    def block(n: Column) -> Column:
        c = F.get(col(found), n - 1)
        return F.concat(F.lit("["), n.cast("string"), F.lit("] "), source_label(c["doc"], c["clause"], c["chapter"]), F.lit("\n"), strip(c["text"]))

    return F.when(F.size(col(numbers)) > 0, F.array_join(F.transform(F.array_sort(col(numbers)), block), "\n\n")).otherwise(F.lit(NO_SOURCES))


class CallFailed(Exception):
    """A backend's failure: an HTTP status and what it said."""

    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(f"{status} {message}")
        self.status, self.message = status, message

    @property
    def may_pass(self) -> bool:
        return self.status in RETRYABLE and not (self.status == 429 and DAILY_QUOTA in self.message)


@dataclass(frozen=True)
class Retry:
    """Calls again after failures that may pass, with doubled delays; then the fallback, if there is one."""

    attempts: int = ATTEMPTS
    first_delay: float = FIRST_DELAY
    sleep: Callable[[float], None] = time.sleep
    any_failure: bool = False

    def call(self, function: Callable[[], str], fallback: Callable[[], str] | None = None) -> str:
        for k in range(self.attempts):
            try:
                return function()
            except Exception as failure:
                passes = self.any_failure or isinstance(failure, CallFailed) and failure.may_pass
                quota = isinstance(failure, CallFailed) and failure.status in RETRYABLE
                if passes and k + 1 < self.attempts:
                    self.sleep(self.first_delay * 2**k)
                    continue
                if fallback and (passes or quota):
                    return Retry(self.attempts, self.first_delay, self.sleep, self.any_failure).call(fallback)
                raise
        raise AssertionError("no attempt")


def call_backend(rows: DataFrame, key: str, request: str, backend: Callable[[str], str], retry: Retry | None = None) -> DataFrame:
    """key, response, error: ``backend`` called for each request in the tasks; a failure is a row, not an exception."""
    policy = retry or Retry()
    asked = rows.select(F.col(key).alias("key"), F.col(request).alias("request"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    answers.append(policy.call(lambda text=text: backend(text)))
                    errors.append(None)
                except Exception as failure:
                    answers.append(None)
                    errors.append(str(failure))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["key", "response", "error"])

    return asked.mapInArrow(run, f"key {asked.schema['key'].dataType.simpleString()}, response string, error string").withColumnRenamed("key", key)


def cached_calls(rows: DataFrame, cache: DataFrame, key: str, request: str, backend: Callable[[str], str], retry: Retry | None = None) -> tuple[DataFrame, DataFrame]:
    """Responses from ``cache`` (key, response) or the backend, and the rows to add to the cache. Failures are not kept."""
    wanted = rows.select(key, request).dropDuplicates([key])
    missing = wanted.join(cache.select(key), key, "left_anti")
    made = call_backend(missing, key, request, backend, retry)
    known = wanted.select(key).join(cache.select(key, "response"), key).withColumn("error", F.lit(None).cast("string"))
    return known.unionByName(made), made.where("error is null").select(key, "response")


def kept_calls(
    rows: DataFrame, cache: Table, key: str, request: str, backend: Callable[[str], str], retry: Retry | None = None, at_once: int = 10_000, again: bool = False, progress: Callable[[int, int], None] = lambda done, total: None
) -> DataFrame:
    """key, response, error: each request is called once, and its response is in ``cache`` before anything reads it.

    Requests go out in portions of about ``at_once`` (more where that would make over
    ``PORTIONS``). What a portion was given is in the cache before the next one goes
    out, so that a run that is broken off calls again for one portion at most.
    Failures are not kept. ``again`` calls for what is kept as well, and replaces it.
    """
    wanted = written(rows.select(key, request).dropDuplicates([key]), "requests")
    missing = wanted if again else written(wanted.join(cache.read().select(F.col("key").alias(key)), key, "left_anti"), "missing")
    total, done, failed = missing.count(), 0, None
    portions = min(PORTIONS, -(-total // at_once))
    progress(0, total)
    for i in range(portions):
        part = missing.where(F.pmod(F.xxhash64(key), F.lit(portions)) == i)
        made = written(call_backend(part, key, request, backend, retry), "responses")
        given = made.where("error is null").select(F.col(key).alias("key"), "response")
        cache.replace(given, "key") if again else cache.append(given)
        errors = made.where("error is not null")
        failed = errors if failed is None else failed.unionByName(errors)
        done += made.count()
        progress(done, total)
    answered = wanted if failed is None else wanted.join(failed, key, "left_anti")
    # Two runs at once may both have called.
    known = answered.select(key).join(cache.read().groupBy(F.col("key").alias(key)).agg(F.min("response").alias("response")), key).withColumn("error", F.lit(None).cast("string"))
    return known if failed is None else known.unionByName(failed)


def request_key(tag: Column | str, system: Column | str, text: Column | str) -> Column:
    """Key of a call in the cache: hash of model tag, system prompt and prompt."""
    return F.sha2(F.concat_ws("\0", col(tag), col(system), col(text)), 256)


def with_contexts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, question, contexts and their number n."""
    asked = questions.select("query_id", "question").join(found, "query_id", "left")
    return asked.withColumn("n", F.greatest(F.lit(0), F.coalesce(F.size("contexts"), F.lit(0))))


def generate(questions: DataFrame, found: DataFrame, backend: Callable[[str], str], retry: Retry | None = None) -> DataFrame:
    """query_id, answer, citations, sources, contexts, refused, error. Questions without contexts are refused without a call."""
    asked = with_contexts(questions, found)
    called = call_backend(asked.where("n > 0").select("query_id", prompt("question", "contexts").alias("prompt")), "query_id", "prompt", backend, retry)
    return answered(asked, called)


def generate_kept(questions: DataFrame, found: DataFrame, cache: Table, backend: Callable[[str], str], tag: str, system: str = "", retry: Retry | None = None) -> DataFrame:
    """As ``generate``, with responses from ``cache`` where they are there; see ``kept_calls``."""
    asked = written(with_contexts(questions, found), "asked")
    requests = asked.where("n > 0").select("query_id", prompt("question", "contexts").alias("prompt"))
    requests = requests.withColumn("key", request_key(F.lit(tag), F.lit(system), "prompt"))
    return answered(asked, requests.select("query_id", "key").join(kept_calls(requests, cache, "key", "prompt", backend, retry), "key").drop("key"))


def answered(asked: DataFrame, called: DataFrame) -> DataFrame:
    """The rows of ``generate`` from questions with contexts and the responses of the model (query_id, response, error)."""
    rows = asked.join(called, "query_id", "left").withColumn("answer", F.when(F.col("n") == 0, F.lit(REFUSAL)).otherwise(without_thoughts("response")))
    rows = rows.withColumn("citations", F.coalesce(citations("answer", "n"), F.array().cast("array<int>")))
    return rows.withColumn("sources", cited_sources("citations", "contexts")).withColumn("refused", refused("answer", "citations")).select("query_id", "answer", "citations", "sources", "contexts", "refused", "error")

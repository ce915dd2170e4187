"""Command line over the tables of one store folder: check, ingest, index, learn, remove, search, ask, chat, eval.

Pages come from Parquet tables (doc, page_number, text) or from files in a folder, by an
extractor that is registered for their ending; models and servers are registered as well
(``operators.backends``).
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions.text import quality, reason_text
from clauselake.operators import answers, chunking, enrich, evaluation, retrieval, segment, vectors
from clauselake.operators.backends import ANSWER_SYSTEM, EXTRACTORS, JUDGE_SYSTEM, MODELS, Model, Reader, as_model, required
from clauselake.sources import pdf, store
from clauselake.sources.scratch import written


def _no_backend(_: str) -> str:
    raise RuntimeError("no backend is registered for this")


@dataclass
class Backends:
    """What runs outside the engine. Models are ``Model``s, registered names or functions of the prompt; ``read_page`` may be a ``Reader``."""

    read_page: Callable[[str], str] | Reader = _no_backend
    extract: Callable[[bytes], list[str]] | None = None
    answer: Callable[[str], str] | Model | str = _no_backend
    judge: Callable[[str], str] | Model | str = _no_backend
    make_embedder: Callable = vectors.hashed_ngrams
    #: Where the settings are found that models and readers need.
    settings: dict[str, str | None] = field(default_factory=lambda: dict(os.environ))
    #: Share of keyword search in the hybrid.
    bm25_weight: float = retrieval.BM25_WEIGHT
    #: Stage, how many are done, and of how many.
    progress: Callable[[str, int, int], None] = field(default=lambda stage, done, total: None)


#: Pages that are read before what was read is kept.
OCR_AT_ONCE = 200
#: A model's own call is repeated inside ``_called``.
ONCE = answers.Retry(attempts=1)


def _called(model: Model, system: str) -> Callable[[str], str]:
    """A model as a function of the prompt: its own call, repeated, and after failures that stay its fallback's."""
    return lambda prompt: model.asked(prompt, system, answers.Retry())


def checked(backends: Backends, *used: Callable | Model | Reader | str) -> None:
    """An error that names all settings which those of ``used`` lack, before any work is done."""
    needs = [n for x in used for n in getattr(MODELS.get(x) if isinstance(x, str) else x, "needs", ())]
    required(backends.settings, *dict.fromkeys(needs))


class Store:
    """The tables of one folder and what the commands do with them."""

    def __init__(self, spark: SparkSession, folder: str, backends: Backends | None = None) -> None:
        self.spark, self.backends, self.folder = spark, backends or Backends(), folder.rstrip("/")
        table = lambda name, schema, key="doc": store.Table(spark, f"{folder}/{name}", schema, key)
        self.chunks, self.registry, self.markdown = table("chunks", store.CHUNKS), table("registry", store.REGISTRY), table("markdown", "doc string, markdown string")
        self.vectors, self.ocr_cache, self.llm_cache = table("vectors", store.VECTORS), table("ocr_cache", store.OCR_CACHE, "key"), table("llm_cache", store.OCR_CACHE, "key")
        self.dictionary = table("dictionary", store.DICTIONARY, "word")

    def pages(self, path: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Pages of a Parquet table or, with a file pattern, of the files in a folder; and the files that could not be read (doc, error)."""
        if pattern is None:
            found = self.spark.read.parquet(path).select("doc", F.col("page_number").cast("int").alias("page_number"), "text")
            return found, self.spark.createDataFrame([], "doc string, error string")
        self.backends.progress("extract", 0, 1)
        ending = pattern.rsplit(".", 1)[-1]
        if self.backends.extract is None and ending.lower() == "pdf" and ending not in EXTRACTORS.known:
            found = written(pdf.read_pdf(self.spark, path, pattern), "pages")
        else:
            found = written(store.extract_pages(store.read_files(self.spark, path, pattern), self.backends.extract or EXTRACTORS.get(ending)), "pages")
        self.backends.progress("extract", 1, 1)
        return found.where("error is null").drop("error"), found.where("error is not null").select("doc", "error")

    def gated(self, pages: DataFrame) -> DataFrame:
        return pages.withColumn("q", quality("text")).select("*", "q.needs_ocr", "q.reason", reason_text(F.col("q.reason"), F.col("q.detail")).alias("why")).drop("q")

    def check(self, pages: DataFrame) -> DataFrame:
        """Pages and pages that need OCR, by document and in all."""
        return self.gated(pages).rollup("doc").agg(F.count("*").alias("pages"), F.count_if("needs_ocr").alias("ocr_pages"), F.sort_array(F.collect_set(F.when(F.col("needs_ocr"), F.col("page_number")))).alias("which"))

    def ingest(self, pages: DataFrame, only: list[str] | None = None, force_ocr: bool = False) -> DataFrame:
        """Read, clean and cut documents; store their chunks, markdown and records. Documents are independent: a failed page is listed, not raised."""
        report = self.backends.progress
        pages = pages.where(F.col("doc").isin(only)) if only else pages
        gated = self.gated(pages)
        gated = written(gated.withColumn("needs_ocr", F.lit(True)) if force_ocr else gated, "gated")
        report("gate", 1, 1)
        hashes = gated.groupBy("doc").agg(F.sha2(F.concat_ws("\0", F.sort_array(F.collect_list(F.concat_ws("\1", "page_number", "text")))), 256).alias("sha256"))
        read_page, name = enrich.reader(self.backends.read_page) if isinstance(self.backends.read_page, Reader) else (self.backends.read_page, F.lit("reader"))
        keyed = gated.join(hashes, "doc").withColumn("key", enrich.page_key("sha256", name, "page_number"))
        flagged = keyed.where("needs_ocr").select("doc", "page_number", "key")
        # A portion of pages is in the cache before the next one is read, so a run that breaks off reads few again.
        read = answers.kept_calls(flagged.withColumn("request", F.col("key")), self.ocr_cache, "key", "request", read_page, enrich.Retry(any_failure=True), at_once=OCR_AT_ONCE, again=force_ocr, progress=lambda done, total: report("ocr", done, total))
        read = written(flagged.join(read, "key").select("doc", "page_number", F.col("response").alias("text"), "error"), "read")
        made = written(chunking.ingest(gated.select("doc", "page_number", "text", "needs_ocr"), read), "chunks")
        report("chunk", 1, 1)
        docs = gated.select("doc").distinct()
        self.chunks.replace(made, "doc", docs)
        self.markdown.replace(chunking.markdown(made), "doc", docs)
        pages_of = lambda rows, name: rows.groupBy("doc").agg(F.sort_array(F.collect_list("page_number")).alias(name))
        record = gated.groupBy("doc").agg(F.count("*").cast("int").alias("pages")).join(hashes, "doc")
        for rows, name in ((read, "ocr_pages"), (read.where("error is not null"), "failed_pages")):
            record = record.join(pages_of(rows, name), "doc", "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
        counts = made.groupBy("doc").agg(F.count("*").cast("int").alias("chunks"))
        record = record.join(counts, "doc", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("ingested_at", F.current_timestamp().cast("timestamp_ntz"))
        self.registry.replace(record, "doc")
        report("store", 1, 1)
        return self.registry.read().join(docs, "doc", "left_semi")

    def index(self, only: list[str] | None = None) -> int:
        chunks, seen = self.chunks.read(), self.vectors.version()
        if only:
            docs = self.spark.createDataFrame([(d,) for d in only], "doc string")
            points = written(vectors.chunk_vectors(chunks.join(docs, "doc", "left_semi"), self.backends.make_embedder), "points")
            self.vectors.replace(vectors.fitting(points, self.vectors.read().join(docs, "doc", "left_anti")), "doc", docs)
        else:
            self.vectors.write(vectors.chunk_vectors(chunks, self.backends.make_embedder), seen)
        return self.vectors.read().count()

    def remove(self, docs: list[str], files: str | None = None) -> list[str]:
        """Documents go from all tables; with ``files``, their files go from that folder, too. Returns the files that were there."""
        gone = self.spark.createDataFrame([(d,) for d in docs], "doc string")
        for table in (self.chunks, self.registry, self.vectors, self.markdown):
            table.remove("doc", gone)
        return store.delete_files(self.spark, files, docs) if files else []

    def learn(self, words: DataFrame) -> int:
        """Add words (word) to the dictionary by which texts without spaces are cut; returns how many it has."""
        self.dictionary.replace(words.select("word").where("word is not null").distinct(), "word")
        return self.dictionary.read().count()

    def _keyword(self, questions: DataFrame, chunks: DataFrame, depth: int) -> DataFrame:
        known = self.dictionary.read()
        whole = retrieval.embed_text(F.col("doc"), F.col("chapter"), F.col("clause"), F.col("text"))
        if known.isEmpty():
            tokens, asked = chunks.select("chunk_id", retrieval.words(whole).alias("tokens")), questions.select("query_id", retrieval.words("question").alias("tokens"))
        else:
            tokens = segment.segmented(chunks.select("chunk_id", whole.alias("whole")), known, "chunk_id", "whole")
            asked = segment.segmented(questions, known, "query_id", "question")
        return retrieval.Bm25(tokens).search(asked, depth)

    def retrieve(self, questions: DataFrame, method: str = "hybrid", k: int = answers.TOP_K) -> DataFrame:
        """query_id, chunk_id, score, rank for questions (query_id, question). The hybrid asks by keywords, too, where they have a weight."""
        chunks = store.last_by(self.chunks.read(), "id", "chunk_seq").select(F.col("id").alias("chunk_id"), "doc", "clause", "chapter", "text", "chunk_seq")
        depth = retrieval.CANDIDATES if method == "hybrid" else k
        if method == "keyword":
            return self._keyword(questions, chunks, depth)
        asked = written(vectors.embed(questions, "query_id", "question", self.backends.make_embedder), "asked-vectors")
        held = self.vectors.read()
        found = retrieval.knn(held.select("chunk_id", "embedding"), vectors.fitting(asked, held.limit(1), "ask with the model that made them, or index anew"), depth)
        if method == "vector":
            return found
        keyword = self._keyword(questions, chunks, depth) if self.backends.bm25_weight > 0 else None
        refs = questions.select("query_id", F.explode(retrieval.clause_refs("question")).alias("ref"))
        return retrieval.hybrid(found, keyword, refs, chunks, k, self.backends.bm25_weight)

    def _contexts(self, questions: DataFrame, k: int) -> DataFrame:
        chunks = store.last_by(self.chunks.read(), "id", "chunk_seq").select(F.col("id").alias("chunk_id"), "doc", "clause", "chapter", "text")
        return answers.contexts(self.retrieve(questions, k=k), chunks)

    def ask(self, questions: DataFrame, k: int = answers.TOP_K, kept: bool = False) -> DataFrame:
        """Answers; ``kept``: from the cache where they are there, and into it before they are used."""
        model, system = as_model(self.backends.answer), ANSWER_SYSTEM.format(refusal=answers.REFUSAL)
        found = self._contexts(questions, k)
        if kept:
            return answers.generate_kept(questions, found, self.llm_cache, _called(model, system), model.tag, system, ONCE)
        return answers.generate(questions, found, _called(model, system), ONCE)

    def eval_retrieval(self, questions: DataFrame) -> DataFrame:
        """Report of the three methods by question type."""
        rows = questions.where("type <> 'unanswerable'").select(F.col("id").alias("query_id"), "question", "type", "expected")
        wanted = rows.select("query_id", F.explode("expected").alias("e")).select("query_id", "e.doc", "e.clause")
        chunks = self.chunks.read().select(F.col("id").alias("chunk_id"), "doc", "clause").dropDuplicates(["chunk_id"])
        ranks = None
        for method in ("vector", "keyword", "hybrid"):
            hits = evaluation.first_hit(self.retrieve(rows, method, evaluation.DEPTH).join(chunks, "chunk_id"), wanted)
            part = hits.join(rows.select("query_id", "type"), "query_id").withColumn("method", F.lit(method))
            ranks = part if ranks is None else ranks.unionByName(part)
        return evaluation.retrieval_report(ranks, "method", "type")

    def eval_answers(self, questions: DataFrame) -> DataFrame:
        """A row a question; calls of the judge are kept, so that a run can be taken up again."""
        rows = questions.select(F.col("id").alias("query_id"), "question", "type", "expected", "reference_answer")
        given = written(self.ask(rows, kept=True), "answers")
        judged = rows.where("type <> 'unanswerable'").join(given.where("not refused"), "query_id")
        prompt = F.concat(F.lit("# Question\n"), "question", F.lit("\n\n# Model answer\n"), "reference_answer", F.lit("\n\n# Sources\n"), answers.numbered_context("contexts"), F.lit("\n\n# Given answer\n"), "answer")
        model = as_model(self.backends.judge)
        asked = judged.select("query_id", prompt.alias("request")).withColumn("key", answers.request_key(F.lit(f"judge {model.tag}"), F.lit(JUDGE_SYSTEM), "request"))
        found = answers.kept_calls(asked, self.llm_cache, "key", "request", _called(model, JUDGE_SYSTEM), ONCE)
        return written(evaluation.evaluate_answers(given, rows, asked.select("query_id", "key").join(found, "key").select("query_id", "response", "error")), "judged")

    def facts(self) -> dict:
        """What a report depends on besides the questions: the chunks, and the models by their tags."""
        chunks = self.chunks.read().agg(F.count("*"), F.sum(F.xxhash64("id", "doc", "clause", "chapter", "text", "chunk_seq").cast("decimal(38,0)"))).first()
        tags = {what: as_model(model).tag for what, model in (("answer", self.backends.answer), ("judge", self.backends.judge))}
        return {"chunks": chunks[0], "chunks_sum": str(chunks[1] or 0), "models": tags}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="clauselake", description=__doc__)
    top.add_argument("--store", default="clauselake-store", help="folder of the tables")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("check", "ingest"):
        command = commands.add_parser(name)
        command.add_argument("pages", help="Parquet table of pages, or a folder of files")
        command.add_argument("--files", metavar="PATTERN", help="read the files of this pattern (*.pdf) in the folder with the registered extractor")
        command.add_argument("-v", "--verbose", action="store_true")
        if name == "ingest":
            command.add_argument("--force-ocr", action="store_true")
            command.add_argument("--only", nargs="*")
    commands.add_parser("index").add_argument("--only", nargs="*")
    remove = commands.add_parser("remove")
    remove.add_argument("docs", nargs="+")
    remove.add_argument("--delete-pdf", metavar="FOLDER", help="delete the documents' files in this folder, too")
    for name in ("search", "ask"):
        command = commands.add_parser(name)
        command.add_argument("question")
        command.add_argument("-k", type=int, default=answers.TOP_K)
    commands.add_parser("chat").add_argument("-k", type=int, default=answers.TOP_K)
    commands.add_parser("learn").add_argument("words", help="Parquet table with a column word: the dictionary of texts without spaces")
    evaluate = commands.add_parser("eval")
    for command in (commands.choices["search"], commands.choices["ask"], commands.choices["chat"], evaluate):
        command.add_argument("--bm25-weight", type=float, help="share of keyword search in the hybrid")
    evaluate.add_argument("target", choices=["retrieval", "answers"])
    evaluate.add_argument("--questions", required=True)
    evaluate.add_argument("--locked")
    evaluate.add_argument("--allow-test-set", action="store_true")
    evaluate.add_argument("--limit", type=int)
    return top


def chat(ask: Callable[[str], dict], lines, say: Callable[[str], None] = print) -> None:
    """One question a line, each on its own; /sources shows what the last answer cites, /exit ends."""
    last = None
    for line in lines:
        text = line.strip()
        if text in ("/exit", "/quit"):
            return
        if text == "/sources":
            say(last["sources"] if last else answers.NO_SOURCES)
        elif text.startswith("/"):
            say("/sources  /exit")
        elif text:
            last = ask(text)
            say(last["answer"])


def show(rows: DataFrame) -> None:
    """All rows, one a line, read one partition at a time."""
    print(" | ".join(rows.columns))
    for r in rows.toLocalIterator():
        print(" | ".join("" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None, backends: Backends | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("clauselake").getOrCreate()
    backends = backends or Backends()
    if getattr(args, "bm25_weight", None) is not None:
        backends = replace(backends, bm25_weight=args.bm25_weight)
    tables = Store(spark, args.store, backends)
    one = lambda text: spark.createDataFrame([("q", text)], "query_id string, question string")
    try:
        used = {"ingest": [backends.read_page], "ask": [backends.answer], "chat": [backends.answer], "eval": [backends.answer, backends.judge] if getattr(args, "target", "") == "answers" else []}
        checked(backends, *used.get(args.command, []))
        if args.command in ("check", "ingest"):
            pages, broken = tables.pages(args.pages, args.files)
            bad = [f"{r['doc']}: {r['error']}" for r in broken.orderBy("doc").toLocalIterator()]
            for line in bad:
                print(line, file=sys.stderr)
            if pages.isEmpty():
                print("no pages", file=sys.stderr)
                return 1
            if args.command == "check":
                found = tables.check(pages).orderBy(F.col("doc").asc_nulls_last())
                show(found if args.verbose else found.drop("which"))
                return int(bool(bad))
            records = tables.ingest(pages, args.only, args.force_ocr)
            show(records.orderBy("doc"))
            short = chunking.short_chunks(tables.chunks.read().join(records.select("doc"), "doc", "left_semi"))
            for r in short.select("doc", "id").orderBy("doc", "id").toLocalIterator():
                print(f"short chunk: {r['id']}")
            return int(bool(bad) or not records.where("size(failed_pages) > 0").isEmpty())
        if args.command == "learn":
            print(tables.learn(spark.read.parquet(args.words)))
        elif args.command == "index":
            print(tables.index(args.only))
        elif args.command == "remove":
            for name in tables.remove(args.docs, args.delete_pdf):
                print(f"deleted {name}")
        elif args.command == "search":
            chunks = tables.chunks.read().select(F.col("id").alias("chunk_id"), "text")
            for method in ("vector", "keyword", "hybrid"):
                found = tables.retrieve(one(args.question), method, args.k).join(chunks, "chunk_id")
                found.select(F.lit(method).alias("method"), "rank", "chunk_id", F.round("score", 4).alias("score"), retrieval.preview("text").alias("text")).orderBy("rank").show(truncate=False)
        elif args.command in ("ask", "chat"):

            def ask(text: str) -> dict:
                found = tables.ask(one(text), args.k)
                shown = found.select(answers.formatted("answer", "citations", "contexts").alias("answer"), answers.formatted_sources("citations", "contexts").alias("sources"), "error").first()
                if shown["error"]:
                    raise RuntimeError(shown["error"])
                return shown.asDict()

            as_model(tables.backends.answer).warm_up()
            print(ask(args.question)["answer"]) if args.command == "ask" else chat(ask, sys.stdin)
        else:
            questions = store.read_questions(spark, args.questions, args.locked, args.allow_test_set)
            questions = questions.orderBy("id").limit(args.limit) if args.limit else questions
            stamp, facts = time.strftime("%Y%m%d-%H%M%S"), {"questions": args.questions, "questions_sha": spark.read.format("binaryFile").load(args.questions).select(store.short_hash("content")).first()[0]}
            began, facts, broken = time.time(), facts | tables.facts(), 0
            if args.target == "retrieval":
                frame = written(tables.eval_retrieval(questions), "report").orderBy("method", "type")
                found, text = [r.asDict() for r in frame.collect()], evaluation.retrieval_markdown(frame)  # a row a method and type
            else:
                frame = tables.eval_answers(questions)
                by_type = evaluation.answer_metrics(frame, "type").orderBy("type")
                found = [evaluation.answer_metrics(frame).first().asDict(), *(r.asDict(recursive=True) for r in by_type.collect())]
                text = evaluation.answers_markdown(by_type, evaluation.failures(frame))
                broken = frame.where("size(errors) > 0").count()
            facts["minutes"] = round((time.time() - began) / 60, 2)
            evaluation.write_report(frame, f"{args.target} {stamp} {json.dumps(facts, ensure_ascii=False)}\n\n{text}", f"{args.store.rstrip('/')}/reports", f"{args.target}-{stamp}")
            print(json.dumps({"at": stamp, **facts, "report": found}, ensure_ascii=False))
            if broken:
                print(f"{broken} questions were not answered or judged; the report lists them", file=sys.stderr)
                return 1
    except Exception as failure:
        print(f"{type(failure).__name__}: {failure}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

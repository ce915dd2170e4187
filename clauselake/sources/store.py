"""Tables replaced by document: chunks, registry, vectors, caches; and the readers of their inputs.

A table is a folder of buckets of rows, by a hash of their key, and a log of versions: a
version says which folders hold each bucket. A change of some keys writes the buckets
they are in and then the next version, as a file that must not be there yet. Of two
writers one finds it there: it takes up the other's version and, if that changed a bucket
of its own, makes its rows anew from it. So no writer's rows are lost, readers see whole
versions, and a failed write leaves no trace but unused files, which ``clean`` removes.
Files are reached through Spark's file system, whatever store the folder is in, as long
as that store makes a file only where there is none.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.sources.scratch import written

CHUNKS = "id string, doc string, clause string, chapter string, text string, chunk_seq long"
REGISTRY = "doc string, sha256 string, pages int, ocr_pages array<int>, failed_pages array<int>, chunks int, ingested_at timestamp_ntz"
VECTORS = "point_id string, chunk_id string, doc string, clause string, chapter string, text string, embedding array<float>"
QUESTIONS = "id string, question string, type string, expected array<struct<doc:string,clause:string>>, reference_answer string"
OCR_CACHE = "key string, response string"
DICTIONARY = "word string"
#: Buckets of a table.
BUCKETS = 64
#: How often, and how many seconds apart, a writer looks for the version that another one has claimed.
PATIENCE, PAUSE = 200, 0.1


def replace_by(existing: DataFrame, new: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """Rows of ``existing`` whose key is neither in ``new`` nor in ``gone``, and all of ``new``."""
    keys = new.select(key)
    if gone is not None:
        keys = keys.unionByName(gone.select(key))
    return existing.join(keys.distinct(), key, "left_anti").unionByName(new)


def last_by(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """One row of each key: the last."""
    order = F.col(order) if isinstance(order, str) else order
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    # Combined before the shuffle, so a key may have any number of rows.
    return rows.groupBy(F.col(f"`{key}`").alias("key")).agg(F.max_by(whole, order).alias("row")).select("row.*")


def find_by_hash(registry: DataFrame, hashes: DataFrame) -> DataFrame:
    """sha256, doc: the first document with each hash, null if none has it."""
    return hashes.select("sha256").distinct().join(registry.groupBy("sha256").agg(F.min("doc").alias("doc")), "sha256", "left")


class Conflict(RuntimeError):
    """Another writer changed what a version was made from."""


class Table:
    """A table in ``folder``, its rows in buckets by ``key``. Rows without a key are in one bucket."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "doc", buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def _log(self, version: int):
        return self._path(f"{self.folder}/log/{version:020d}")

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        folder = self._path(f"{self.folder}/log")
        if not self._fs.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit() and f.getLen() > 0), default=0)

    def _placed(self, version: int) -> dict[str, list[str]]:
        """Folders of each bucket."""
        if not version:
            return {}
        stream = self._fs.open(self._log(version))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, version: int, placed: dict[str, list[str]]) -> bool:
        """Make a version; false if another writer was first. The content is written aside, so that the file appears whole."""
        aside = self._path(f"{self.folder}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(placed, sort_keys=True).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        renames = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(renames, 1)
        options[0] = renames.NONE
        claim = self._path(f"{self.folder}/log/{version:020d}.claim")
        try:
            self._fs.create(claim, False).close()  # made by one writer only
        except Exception as failure:
            if "AlreadyExists" not in str(failure):
                raise
            self._fs.delete(aside, False)
            return False
        context.rename(aside, self._log(version), options)
        return True

    # rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last."""
        return self._rows(self._placed(self.version() if version is None else version))

    def _rows(self, placed: dict[str, list[str]], buckets: set[str] | None = None) -> DataFrame:
        paths = sorted({f"{self.folder}/{p}" for k, found in placed.items() if buckets is None or k in buckets for p in found})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`").cast("string")), F.lit(self.buckets)).cast("string")

    def _written(self, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows by bucket; where each bucket is."""
        name = f"data/{uuid.uuid4().hex}"
        empty = self.spark.createDataFrame([], self.schema)
        typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in empty.schema])
        typed.withColumn("__bucket", self._bucket()).write.partitionBy("__bucket").parquet(f"{self.folder}/{name}")
        found = self._fs.listStatus(self._path(f"{self.folder}/{name}"))
        names = [f.getPath().getName() for f in found]
        return {n.removeprefix("__bucket="): [f"{name}/{n}"] for n in names if n.startswith("__bucket=")}

    def write(self, rows: DataFrame, seen: int | None = None) -> None:
        """All rows anew. ``seen``: the version they were made from; another one in its place is an error, and nothing is changed."""
        placed = self._written(rows)
        while True:
            version = self.version()
            if seen is not None and version != seen:
                raise Conflict(f"{self.folder} was changed by another writer; nothing was written")
            if self._commit(version + 1, placed):
                return
            self._wait(version)

    def replace(self, new: DataFrame, key: str, gone: DataFrame | None = None) -> None:
        """Rows whose key is in ``new`` or ``gone`` go, those of ``new`` come. Only their buckets are written."""
        if key != self.key:
            raise ValueError(f"{self.folder} is kept by {self.key}, not by {key}")
        new = written(new, "new-rows")
        keys = new.select(key) if gone is None else new.select(key).unionByName(gone.select(key))
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # at most one a bucket
        if not touched:
            return
        version, ours = self.version(), None
        before: dict[str, list[str]] = {}
        while True:
            now = self._placed(version)
            held = {k: now.get(k, []) for k in touched}
            if ours is None or held != before:  # made from what another writer has replaced since
                before = held
                ours = self._written(replace_by(self._rows(now, touched), new, key, gone))
            placed = {k: p for k, p in now.items() if k not in touched} | ours
            if self._commit(version + 1, placed):
                return
            version = self._wait(version)

    def append(self, new: DataFrame) -> None:
        """Rows come beside those that are there; nothing is read or rewritten. For keys that are new."""
        ours, version = self._written(new), self.version()
        while ours:
            now = self._placed(version)
            if self._commit(version + 1, now | {k: now.get(k, []) + p for k, p in ours.items()}):
                return
            version = self._wait(version)

    def compact(self, most: int = 8) -> None:
        """Buckets of more than ``most`` folders become one folder each; an error, with nothing changed, where another writer came between."""
        version = self.version()
        now = self._placed(version)
        long = {k for k, found in now.items() if len(found) > most}
        if long and not self._commit(version + 1, now | self._written(self._rows(now, long))):
            raise Conflict(f"{self.folder} was changed by another writer; nothing was written")

    def _wait(self, version: int) -> int:
        """The version after ``version``, once its writer has made it. A writer that claimed it and died is passed over."""
        for _ in range(PATIENCE):
            now = self.version()
            if now > version:
                return now
            time.sleep(PAUSE)
        self._fs.delete(self._path(f"{self.folder}/log/{version + 1:020d}.claim"), False)
        return self.version()

    def remove(self, key: str, gone: DataFrame) -> None:
        """Rows with these keys go; keys that are not there are passed over."""
        self.replace(self.spark.createDataFrame([], self.schema), key, gone)

    def clean(self, keep: int = 10) -> int:
        """Remove all versions but the last ``keep``, and the folders that only they name; returns how many folders. Run it while nobody writes."""
        last = self.version()
        kept = {p.split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for found in self._placed(v).values() for p in found}
        for v in range(last - keep, 0, -1):
            if not self._fs.delete(self._log(v), False):
                break
            self._fs.delete(self._path(f"{self.folder}/log/{v:020d}.claim"), False)
        data, n = self._path(f"{self.folder}/data"), 0
        for f in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if f.getPath().getName() not in kept:
                self._fs.delete(f.getPath(), True)
                n += 1
        return n


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """doc (file name), path, sha256 and content of the files in a folder; an error if there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc"), "path", F.sha2("content", 256).alias("sha256"), "content")


def extract_pages(files: DataFrame, extract: Callable[[bytes], list[str | None]]) -> DataFrame:
    """doc, page_number (from 1), text, error: the pages of each file of ``read_files``. Null text is empty.

    ``extract`` gets a file's bytes and gives the text of each page. A file that it
    fails on is one row with the error and no page; the others are not touched by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                doc = batch.column(0)[k].as_py()
                try:
                    texts = [t or "" for t in extract(batch.column(1)[k].as_py())]
                    rows = [(doc, n, t, None) for n, t in enumerate(texts, 1)]
                except Exception as failure:
                    rows = [(doc, None, None, f"{type(failure).__name__}: {failure}")]
                docs, numbers, texts, errors = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["doc", "page_number", "text", "error"])

    return files.select("doc", "content").mapInArrow(run, "doc string, page_number int, text string, error string")


def delete_files(spark: SparkSession, folder: str, docs: list[str]) -> list[str]:
    """Delete the files of these names in ``folder``; returns those that were there. Names with a path are an error."""
    if bad := [d for d in docs if "/" in d or d in ("", ".", "..")]:
        raise ValueError(f"not file names: {bad}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [d for d in docs if system.delete(path(f"{folder.rstrip('/')}/{d}"), False)]


def short_hash(content: Column | str) -> Column:
    return F.substring(F.sha2(F.col(content) if isinstance(content, str) else content, 256), 1, 12)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; blank lines are passed over, malformed ones and unknown keys are errors."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    known = spark.createDataFrame([], schema).columns
    keys = F.json_object_keys("value")
    odd = F.array_except(keys, F.array(*[F.lit(k) for k in known]))
    checked = F.when(keys.isNull(), F.raise_error(F.lit("malformed line"))).when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(odd, ", ")))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked.cast("string"), schema).alias("r")).select("r.*")


def resolved(spark: SparkSession, path: str) -> str:
    """The full address of a path, however it is written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return posixpath.normpath(system.resolvePath(path).toString() if system.exists(path) else system.makeQualified(path).toString())


def read_questions(spark: SparkSession, path: str, locked: str | None = None, allow_locked: bool = False) -> DataFrame:
    """A question set; the locked one only if that is allowed."""
    if locked and resolved(spark, path) == resolved(spark, locked) and not allow_locked:
        raise ValueError("this question set is locked; allow it to use it")
    return read_jsonl(spark, path, QUESTIONS)


def export_registry(registry: DataFrame, path: str) -> None:
    registry.orderBy("doc").write.mode("overwrite").json(path)

"""Pages to documents, documents to clause-structured chunks.

Positions of headings come from the pieces between the matches of the heading pattern:
a match begins where the lengths of all pieces and matches before it end. A text is
read once; its pieces are placed by document once and put together by segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.functions.text import LINES, S, arabic_digits, clean, col, doc_slug, slug, strip
from clauselake.sources.scratch import measured, written

# Heading patterns, the label of a preamble, and sizes of chunks.
CLAUSE = rf"{LINES}^{S}*(ข้อ|มาตรา){S}+(\d+(?:/\d+)?){S}*"
CHAPTER = rf"{LINES}^{S}*(หมวด|ส่วนที่){S}+(\d+){S}*(.*)$"
PREAMBLE = "เกริ่นนำ"
MAX_CHARS, OVERLAP = 1200, 200
FALLBACK_CHARS, FALLBACK_OVERLAP = 1000, 200
SHORT_CHUNK = 15

#: Characters of documents that a task cuts, about; a document counts as 200 at least.
CHARS_A_TASK = 8_000_000

CHUNK = "id string, doc string, clause string, chapter string, text string, chunk_seq long"


def join_pages(pages: DataFrame) -> DataFrame:
    """doc, text: the pages of a document in order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def page_texts(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Text of each page: what OCR read (empty if it failed) where the gate asked for it, else what was extracted."""
    read = ocr.select("doc", "page_number", F.col("text").alias("__read"))
    chosen = F.when(F.col("needs_ocr"), F.coalesce("__read", F.lit(""))).otherwise(F.col("text"))
    return pages.join(read, ["doc", "page_number"], "left").select("doc", "page_number", chosen.alias("text"))


def headings(docs: DataFrame, pattern: str, groups: int) -> DataFrame:
    """doc, pos (from 0) and the groups g1, g2, ... of every match."""
    text = F.col("text")
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(groups + 1)]
    sizes = lambda a: F.transform(a, F.length)
    pieces = F.arrays_zip(sizes(F.split(text, pattern, -1)).alias("before"), sizes(found[0]).alias("own"), *[g.alias(f"g{k}") for k, g in enumerate(found[1:], 1)])
    rows = docs.where(text.rlike(pattern)).select("doc", F.posexplode(pieces).alias("n", "m")).select("doc", "n", "m.*")
    upto = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos = F.sum(F.col("before") + F.coalesce("own", F.lit(0))).over(upto) - F.col("own")
    return rows.withColumn("pos", pos).where("own is not null").select("doc", F.col("pos").cast("int").alias("pos"), *[f"g{k}" for k in range(1, groups + 1)])


def leading_number(number: Column | str) -> Column:
    """5 of 5/1."""
    return F.split_part(arabic_digits(col(number)), F.lit("/"), F.lit(1)).cast("decimal(38,0)")


def _in_parts(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` in ranges of key and order, numbered by ``__part``: a key of any size is in as many parts as it fills. Written, so that parts stay as they are."""
    return written(rows.repartitionByRange(F.col(key), *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()), "ranges")


def _carried(sums: DataFrame, key: str, name: str, carry: Callable[[Column], Column]) -> DataFrame:
    """``__key``, ``__part``, ``name``: what the parts of the key before a part come to, from one row a key and part."""
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumnRenamed(key, "__key").withColumn(name, carry(F.col(name)).over(before)).where(F.col(name).isNotNull()).select("__key", "__part", name)


def _with_carried(rows: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """What comes over from the parts before goes to each part once; ``carried`` has rows for keys of several parts only."""
    part = carried.withColumnRenamed("__part", "__of")
    return rows.join(part, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")), "left").drop("__key", "__of")


def rising_in_key(rows: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """As ``accept_rising``, for keys whose rows are few, as the headings of a document are."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    largest = F.max(number).over(before)
    return rows.withColumn("__largest", largest).where(F.col("__largest").isNull() | (F.col(number) >= F.col("__largest"))).drop("__largest")


def accept_rising(rows: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """Rows whose number is not below any number before it; smaller ones are references back.

    A scan in two levels: parts of a key are scanned by themselves, and the largest
    number of the parts before comes over. One key may hold all rows.
    """
    placed = _in_parts(rows, key, order)
    carried = _carried(placed.groupBy(key, "__part").agg(F.max(number).alias("__ahead")), key, "__ahead", F.max)
    before = Window.partitionBy(key, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = _with_carried(placed.withColumn("__within", F.max(number).over(before)), carried, key)
    largest = F.greatest("__within", "__ahead")
    return found.where(largest.isNull() | (F.col(number) >= largest)).select(*rows.columns)


def label_in_key(events: DataFrame, labels: DataFrame, key: str, order: str) -> DataFrame:
    """As ``label_as_of``, for keys whose rows are few."""
    both = labels.select(key, order, "label", F.lit(0).alias("__kind")).unionByName(events.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy(order, "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("label", ignorenulls=True).over(upto)
    return both.withColumn("label", last).where("__kind = 1").drop("__kind")


def label_as_of(events: DataFrame, labels: DataFrame, key: str, order: str) -> DataFrame:
    """``events`` with ``label``: the last of ``labels`` of the key at or before the event. Scanned in two levels; one key may hold all rows."""
    both = labels.select(key, order, "label", F.lit(0).alias("__kind")).unionByName(events.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    placed = _in_parts(both, key, order, "__kind")
    of_part = placed.where("label is not null").groupBy(key, "__part").agg(F.max_by("label", F.struct(order)).alias("__ahead"))
    every = placed.select(key, "__part").distinct().withColumnsRenamed({key: "__k", "__part": "__p"})
    sums = every.join(of_part, F.col("__k").eqNullSafe(F.col(key)) & (F.col("__p") == F.col("__part")), "left").select(F.col("__k").alias(key), F.col("__p").alias("__part"), "__ahead")
    carried = _carried(sums, key, "__ahead", lambda c: F.last(c, ignorenulls=True))
    upto = Window.partitionBy(key, "__part").orderBy(order, "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = _with_carried(placed.withColumn("__within", F.last("label", ignorenulls=True).over(upto)), carried, key)
    return found.where("__kind = 1").withColumn("label", F.coalesce("__within", "__ahead")).select(*events.columns, *[c for c in ["label"] if c not in events.columns])


def split_overlapping(text: Column | str, most: int, overlap: int) -> Column:
    """Array of parts of at most ``most`` characters, each ``overlap`` into the one before."""
    step = most - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(col(text)) - most) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(col(text), i * step + 1, F.lit(most)))


def _pieces(pattern: str, made: Callable[[Column, Column, Column], Column]) -> Column:
    """Array of ``made(n, head, body)`` of ``text``: a match and what follows it to the next; the first has no head."""
    heads = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    both = F.arrays_zip(heads.alias("head"), F.split("text", pattern, -1).alias("body"))
    return F.transform(both, lambda x, n: made(n, x["head"], x["body"]))


def _segments(docs: DataFrame) -> DataFrame:
    """doc, seg (0 before the first accepted heading), clause, chapter, text: documents cut at their accepted headings.

    A document is read once and becomes its pieces between headings, which carry the
    text, and its chapter headings, which carry lengths only. Both are ordered by
    where they begin; pieces behind a heading that is not accepted join the segment before.
    """

    def row(kind: int, n: Column, head: Column, body: Column, kept: Column) -> Column:
        size = F.coalesce(F.length(head), F.lit(0)) + F.length(body)
        return F.struct(F.lit(kind).alias("kind"), n.alias("n"), size.alias("size"), head.alias("head"), kept.alias("body"))

    chapters = _pieces(CHAPTER, lambda n, head, body: row(0, n, head, body, F.lit(None).cast("string")))
    pieces = _pieces(CLAUSE, lambda n, head, body: row(1, n, head, body, body))
    found = docs.select("doc", F.inline(F.concat(chapters, pieces)))
    clause = [F.when(F.col("kind") == 1, F.regexp_extract("head", CLAUSE, g)) for g in (1, 2)]
    chapter = [F.when(F.col("kind") == 0, F.regexp_extract("head", CHAPTER, g)) for g in (1, 2, 3)]
    label = F.when((F.col("kind") == 0) & F.col("head").isNotNull(), strip(F.concat_ws(" ", *chapter[:2], strip(chapter[2]))))
    found = found.select("*", F.concat_ws(" ", *clause).alias("clause"), leading_number(clause[1]).alias("number"), label.alias("label"))

    before = Window.partitionBy("doc").orderBy("kind", "n").rowsBetween(Window.unboundedPreceding, -1)
    begins = [F.sum(F.when(F.col("kind") == kind, F.col("size"))).over(before) for kind in (0, 1)]
    pos = F.coalesce(F.when(F.col("kind") == 0, begins[0]).otherwise(begins[1]), F.lit(0))
    largest = F.max("number").over(before)
    accepted = (F.col("kind") == 1) & F.col("head").isNotNull() & (largest.isNull() | F.coalesce(F.col("number") >= largest, F.lit(False)))
    placed = found.select("doc", "kind", "n", "head", "body", "clause", "label", pos.alias("pos"), accepted.alias("accepted"))

    upto = Window.partitionBy("doc").orderBy("pos", "kind", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumns({"chapter": F.last("label", ignorenulls=True).over(upto), "seg": F.sum(F.col("accepted").cast("int")).over(upto)}).where("kind = 1")
    whole = F.array_sort(F.collect_list(F.struct("n", F.concat(F.coalesce("head", F.lit("")), "body").alias("text"))))
    return placed.groupBy("doc", "seg").agg(
        F.max(F.when(F.col("accepted"), F.col("clause"))).alias("clause"), F.min_by("chapter", "n").alias("chapter"), F.array_join(F.transform(whole, lambda x: x["text"]), "").alias("text")
    )


def chunk_documents(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, fallback_chars: int = FALLBACK_CHARS, fallback_overlap: int = FALLBACK_OVERLAP) -> DataFrame:
    """Chunks of documents (doc, text): id, doc, clause, chapter, text, chunk_seq (order within the document).

    A segment reaches from an accepted heading to the next. What stands before the
    first, chapter headings taken out, is the preamble. Documents without a heading
    are cut by length alone. Null text is empty text; ids of equal labels are equal.
    Documents are written, then placed by ``doc`` once, in as many tasks as they fill;
    texts meet no join.
    """
    size = F.sum(F.greatest(F.length("text"), F.lit(200)))
    texts, seen = measured(docs.select("doc", F.coalesce("text", F.lit("")).alias("text")), "documents", chars=size)
    segments = _segments(texts.repartition(max(1, -(-(seen["chars"] or 0) // CHARS_A_TASK)), "doc"))
    of_doc = Window.partitionBy("doc").orderBy("seg")
    segments = segments.withColumn("plain", (F.col("seg") == 0) & F.lead("seg").over(of_doc).isNull())
    body = strip(F.when(F.col("seg") == 0, F.regexp_replace("text", CHAPTER, "")).otherwise(F.col("text")))
    segments = segments.withColumn("body", F.when(F.col("plain"), F.col("text")).otherwise(body))
    parts = F.when(F.col("plain"), split_overlapping("body", fallback_chars, fallback_overlap)).when((F.col("seg") > 0) | (F.col("body") != ""), split_overlapping("body", max_chars, overlap))
    segments = segments.select("doc", "seg", "clause", "chapter", "plain", parts.alias("parts")).withColumn("n", F.array_size("parts"))
    ahead = F.coalesce(F.sum("n").over(of_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = segments.withColumn("ahead", ahead).select("doc", "seg", "clause", "chapter", "plain", "n", "ahead", F.posexplode("parts").alias("part", "text"))
    number = (F.col("part") + 1).cast("string")
    name = F.when(F.col("seg") == 0, F.lit(PREAMBLE)).otherwise(slug("clause"))
    structured = F.concat_ws("_", doc_slug("doc"), name, F.when(F.col("n") > 1, number))
    return found.select(
        F.when(F.col("plain"), F.concat(doc_slug("doc"), F.lit("_chunk"), number)).otherwise(structured).alias("id"),
        "doc", "clause", F.when(~F.col("plain"), F.col("chapter")).alias("chapter"), "text", (F.col("ahead") + F.col("part") + 1).cast("long").alias("chunk_seq"),
    )


def short_chunks(chunks: DataFrame, least: int = SHORT_CHUNK) -> DataFrame:
    return chunks.where(F.length("text") < least)


def ingest(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Gated pages and what OCR read to chunks."""
    return chunk_documents(join_pages(page_texts(pages, ocr)).withColumn("text", clean("text")))


def markdown(chunks: DataFrame) -> DataFrame:
    """doc, markdown: each document's chunks as one page for people to look through."""
    heading = F.concat(F.lit("## "), F.coalesce(F.nullif("clause", F.lit("")), F.lit(PREAMBLE)), F.lit("  ("), F.col("id"), F.lit(")\n"))
    chapter = F.when(F.coalesce("chapter", F.lit("")) != "", F.concat(F.lit("\n*"), F.col("chapter"), F.lit("*\n"))).otherwise("")
    block = F.concat(heading, chapter, F.lit("\n"), F.col("text"), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_seq", block.alias("block"))))
    return chunks.groupBy("doc").agg(F.concat(F.lit("# "), F.col("doc"), F.lit("\n\n"), F.array_join(F.transform(ordered, lambda b: b["block"]), "\n")).alias("markdown"))

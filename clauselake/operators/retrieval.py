"""Retrieval for a batch of queries: BM25, nearest vectors, clause references, rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.functions.text import arabic_digits, col
from clauselake.sources.scratch import measured, written

# Fusion constant, candidates of each ranking, weights, BM25 constants.
RRF_K = 60
CANDIDATES = 20
VECTOR_WEIGHT, BM25_WEIGHT, CLAUSE_WEIGHT = 1.0, 0.0, 1.0
K1, B, EPSILON = 1.5, 0.75, 0.25
CLAUSE_REF = "(ข้อ|มาตรา)(?U)[\\s\\x1c-\\x1f]*([0-9๐-๙]+)"
#: Digits by which scores are ordered, so that the order of a sum decides nothing.
DIGITS = 9


def embed_text(doc: Column, chapter: Column, clause: Column, text: Column) -> Column:
    """The text of a chunk as it is embedded and searched."""
    blank = F.lit("")
    return F.concat_ws(" | ", F.nullif(doc, blank), F.nullif(chapter, blank), F.nullif(clause, blank), F.nullif(text, blank))


def words(text: Column | str) -> Column:
    """Letters and digits in a row, lower case; for languages that put spaces between words."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ranked(scores: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of each query: rank from 1, by score, then by ``ties``."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Asked words times queries whose weights are sent to every task, at most (eight bytes each), and the words of all queries that the driver looks at for it.
SENT_WEIGHTS, SENT_WORDS = 4_000_000, 1_000_000
#: Repeated ids and hits that are sent to every task, at most.
SENT_ROWS = 500_000
#: Queries with a clause and their candidates that are sent to every task, at most (a kilobyte or two each).
SENT_ASKED = 10_000


def few(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, of which there are ``n``, for a join: to every task if they are few."""
    return F.broadcast(rows) if n <= SENT_ROWS else rows


class Bm25:
    """Statistics of chunks (chunk_id, tokens array) and the search in them. An index over no chunks is an error.

    Texts are read once: tokens with their number are written to the shared folder, a row
    a chunk, and words with the number of chunks that have them. Rows of one chunk_id are
    a chunk each, whose scores are added.
    """

    def __init__(self, chunks: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> None:
        self.k1, self.b = k1, b
        rows = chunks.select("chunk_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
        self.tokens, seen = measured(rows.select("chunk_id", F.size("tokens").alias("dl"), "tokens"), "tokens", n=F.count("*"), total=F.sum("dl"))
        self.n = seen["n"]
        if not self.n:
            raise ValueError("no chunks to index")
        self.mean_length = (seen["total"] or 0) / self.n
        # Counts of words are summed before they travel, and no row of a chunk's word does.
        frequency = self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
        idf = written(frequency.select("term", (F.log(self.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), "words")
        mean = idf.agg(F.avg(F.round("idf", 12).cast("decimal(30,12)"))).first()[0]
        floor = epsilon * float(mean or 0)
        self.idf = idf.select("term", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")).alias("idf"))
        repeated = self.tokens.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("__again"), F.lit(True).alias("again"))
        self.repeated, seen = measured(repeated, "repeated", n=F.count("*"))
        self.n_repeated = seen["n"]

    def search(self, queries: DataFrame, k: int = 5, sent: int = SENT_WEIGHTS) -> DataFrame:
        """query_id, chunk_id, score, rank for queries (query_id, tokens). A repeated word counts again; scores of 0 or less are no hits.

        Weights of at most ``sent`` words times queries go to every task, which reads its
        chunks once and gives on the k best of each query. With more of them the asked
        words of chunks are joined with the queries.
        """
        asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        weighed = asked.join(self.idf, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
        some = weighed.limit(SENT_WORDS + 1).toArrow()
        if some.num_rows > SENT_WORDS or pc.count_distinct(some["term"]).as_py() * pc.count_distinct(some["query_id"], mode="all").as_py() > sent:
            return self._joined(weighed, k)
        rows = self.tokens.withColumn("again", F.lit(False))
        if self.n_repeated:
            rows = self.tokens.join(few(self.repeated, self.n_repeated), F.col("chunk_id").eqNullSafe(F.col("__again")), "left").select("chunk_id", "dl", "tokens", F.coalesce("again", F.lit(False)).alias("again"))
        kinds = {name: kind for df in (self.tokens, weighed) for name, kind in df.dtypes}
        found = rows.mapInArrow(_scored(k, some, self.k1, self.b, self.mean_length or 1.0), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
        if self.n_repeated:
            found = found.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score")).where("score > 0")
        return ranked(found, k, "chunk_id")

    def _joined(self, weighed: DataFrame, k: int) -> DataFrame:
        numbered = self.tokens.withColumn("row", F.monotonically_increasing_id())
        rows = numbered.select("row", "chunk_id", "dl", F.explode("tokens").alias("term"))
        postings = rows.join(weighed.select("term").distinct(), "term", "left_semi").groupBy("row", "chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
        gain = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / self.mean_length))
        scores = postings.join(weighed, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * gain).alias("score")).where("score > 0")
        return ranked(scores, k, "chunk_id")


def _scored(k: int, weighed: pa.Table, k1: float, b: float, mean_length: float, numbers_at_once: int = 500_000):
    """The k best of each query (query_id, term, weight) among a task's chunks, and all scores of chunks that have several rows."""

    def run(batches):
        terms, ids = weighed["term"].combine_chunks().unique(), weighed["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        weights = np.zeros((len(terms), len(ids.dictionary)))
        weights[pc.index_in(weighed["term"].combine_chunks(), terms).to_numpy(), ids.indices.to_numpy()] = weighed["weight"].to_numpy()
        held = _Held(k)
        step = max(1, min(2_000, numbers_at_once // max(1, *weights.shape)))
        for batch in batches if len(terms) else ():
            for at in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(at, step)])
                part = part.take(pc.array_sort_indices(part["chunk_id"].combine_chunks()))
                tokens, again = part["tokens"].combine_chunks(), part["again"].to_numpy()
                place = pc.index_in(tokens.flatten(), terms)
                of_row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy())
                cell = of_row[place.is_valid().to_numpy(zero_copy_only=False)] * len(terms) + place.drop_null().to_numpy()
                tf = np.bincount(cell, minlength=len(tokens) * len(terms)).reshape(len(tokens), -1).astype(np.float64)
                base = k1 * (1 - b + b * part["dl"].to_numpy() / mean_length)
                gain = np.divide(tf * (k1 + 1), tf + base[:, None], out=np.zeros_like(tf), where=tf > 0)
                scores = (gain @ weights).T
                held.add(_k_best(np.where(again, np.nan, scores), k, 0.0), scores, ids.dictionary, part["chunk_id"])
                if again.any():  # summed with their other rows before they are cut
                    q, c = np.nonzero((scores != 0) & again)
                    yield from _table(q, c, scores, ids.dictionary, part["chunk_id"]).to_batches()
        yield from held.rest()

    return run


#: Numbers of the query vectors that are sent to every task, at most (eight bytes each).
SENT_NUMBERS = 4_000_000


def knn(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 16_384, part: int = 65_536, sent: int = SENT_NUMBERS) -> DataFrame:
    """query_id, chunk_id, score, rank: the k vectors of greatest cosine for each query.

    ``vectors``: chunk_id, embedding; ``queries``: query_id, embedding. Queries of at most
    ``sent`` numbers in all go to every task, which reads its vectors once. More of them
    are dealt into blocks and vectors into parts of about these sizes; a task multiplies
    one part with one block. Each gives on the k best of each query, ties by chunk_id,
    which meet in one ranking. Null or zero vectors are no hits.
    """
    rows = vectors.select("chunk_id", "embedding").where("embedding is not null")
    # Both may come from one table; the columns of a cogroup must not be the same.
    asked = queries.select(F.col("query_id").alias("query_id"), F.col("embedding").alias("wanted")).where("wanted is not null")
    kind, id_kind = rows.schema["chunk_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    found = f"query_id {id_kind}, chunk_id {kind}, score double"
    first = asked.select(F.size("wanted").alias("n")).first()
    few = sent // max(1, first["n"]) if first else 0
    some = asked.limit(few + 1).toArrow() if first else None
    if some is not None and some.num_rows <= few:
        return ranked(rows.mapInArrow(_best_of_all(k, some), found), k, "chunk_id")
    parts, blocks = max(1, -(-rows.count() // part)), max(1, -(-asked.count() // block))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"part": F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"), "block": all_of(blocks)})
    right = asked.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "part": all_of(parts)})
    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    return ranked(met.applyInArrow(_best(k), found), k, "chunk_id")


def _k_best(scores: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row of ``scores`` that are over ``least``, ties by place; no numbers are no hits."""
    shown = np.round(np.where(scores > least, scores, -np.inf), DIGITS)
    r = min(k, shown.shape[1])
    # The k-th best value; places stand by chunk_id, so a stable sort of those that reach it settles ties.
    enough = -np.partition(-shown, r - 1, axis=1)[:, r - 1]
    q, c = np.nonzero((shown >= enough[:, None]) & (shown > -np.inf))
    by = np.lexsort((c, -shown[q, c], q))
    q, c = q[by], c[by]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], c[place < k]


def _table(q: np.ndarray, c: np.ndarray, scores: np.ndarray, query_ids, chunk_ids) -> pa.Table:
    return pa.table({"query_id": query_ids.take(pa.array(q)), "chunk_id": chunk_ids.take(pa.array(c)), "score": scores[q, c]})


class _Held:
    """The best of each query that a task has met, cut back as they grow over twice what is kept of all queries."""

    def __init__(self, k: int, least: int = 250_000) -> None:
        self.k, self.held, self.n, self.least, self.most = k, [], 0, least, least

    def add(self, best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, query_ids, chunk_ids) -> None:
        if len(best[0]):
            self.held.append(_table(*best, scores, query_ids, chunk_ids))
            self.n += len(best[0])
        if self.n > self.most:
            self.held = [self._cut()]
            self.n = self.held[0].num_rows
            self.most = max(self.least, 2 * self.n)

    def _cut(self) -> pa.Table:
        rows = pa.concat_tables(self.held)
        shown = pa.array(np.round(rows.column("score").to_numpy(), DIGITS))
        order = pc.sort_indices(rows.select(["query_id", "chunk_id"]).append_column("shown", shown), [("query_id", "ascending"), ("shown", "descending"), ("chunk_id", "ascending")])
        rows = rows.take(order)
        of = pc.dictionary_encode(rows.column("query_id").combine_chunks(), null_encoding="encode").indices.to_numpy()
        return rows.filter(pa.array(np.arange(len(of)) - np.searchsorted(of, of) < self.k))

    def rest(self) -> list[pa.RecordBatch]:
        return self._cut().to_batches() if self.held else []


#: Queries whose best are held, and cut back, together.
QUERIES_HELD = 1_000


def _best_of_all(k: int, asked: pa.Table, held_rows: int = 250_000):
    """The k best of each query among a task's vectors, batch by batch; what is held of some queries is cut back to the best as it grows."""

    def run(batches):
        ids, (rows, norms) = asked.column("query_id").combine_chunks(), _units(asked.column("wanted"))
        held = {low: _Held(k, min(held_rows, 2 * k * QUERIES_HELD)) for low in range(0, len(ids), QUERIES_HELD)}
        for batch in batches:
            for low, best in held.items():
                some = slice(low, low + QUERIES_HELD)
                for found in _cosines(k, pa.Table.from_batches([batch]), ids[some], (rows[some], norms[some])):
                    best.add(*found)
        for best in held.values():
            yield from best.rest()

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _units(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    rows = _matrix(column)
    return rows, np.linalg.norm(rows, axis=1)


#: Scores that a task has at once; some copies of them stand side by side.
SCORES_AT_ONCE = 500_000


def _cosines(k: int, vectors: pa.Table, ids: pa.Array, wanted: tuple[np.ndarray, np.ndarray], most: int = 10_000):
    """The k best of some queries among some vectors, with all their scores: a few of both at a time."""
    if not len(ids):
        return
    for low in range(0, vectors.num_rows, most):
        part = vectors.slice(low, most)
        part = part.take(pc.array_sort_indices(part.column("chunk_id").combine_chunks()))
        rows, norms = _units(part.column("embedding"))
        step = max(1, SCORES_AT_ONCE // len(rows))
        for start in range(0, len(ids), step):
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = wanted[0][start : start + step] @ rows.T
                scores /= wanted[1][start : start + step, None]
                scores /= norms[None, :]
            yield _k_best(scores, k), scores, ids.slice(start, step), part.column("chunk_id")


def _best(k: int):
    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        held, ids = _Held(k), asked.column("query_id").combine_chunks()
        if vectors.num_rows and asked.num_rows:
            for best, scores, some, chunk_ids in _cosines(k, vectors, ids, _units(asked.column("wanted"))):
                held.add(best, scores, some, chunk_ids)
        kinds = pa.schema([("query_id", asked.schema.field("query_id").type), ("chunk_id", vectors.schema.field("chunk_id").type), ("score", pa.float64())])
        return pa.Table.from_batches(held.rest(), schema=kinds)

    return run


def clause_refs(query: Column | str) -> Column:
    """Clauses that a query names, each once, in order, as marker and plain number."""
    query = col(query)
    markers = F.regexp_extract_all(query, F.lit(CLAUSE_REF), F.lit(1))
    numbers = F.regexp_extract_all(query, F.lit(CLAUSE_REF), F.lit(2))
    return F.array_distinct(F.zip_with(markers, numbers, lambda m, n: F.concat_ws(" ", m, arabic_digits(n).cast("decimal(38,0)").cast("string"))))


def clause_base(clause: Column | str) -> Column:
    return F.split_part(col(clause), F.lit("/"), F.lit(1))


def fuse(rankings: DataFrame, weights: dict[int, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion: query_id, chunk_id, score, rank.

    ``rankings``: query_id, ranking_no, rank, chunk_id. Ties go to the chunk seen first,
    by ranking and rank. Without weights all weigh 1; a ranking without one is an error.
    """
    weight = F.lit(1.0)
    if weights:
        weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("ranking_no"))
        weight = F.coalesce(weight, F.raise_error(F.lit("a ranking has no weight")).cast("double"))
    share = F.struct("ranking_no", "rank", (weight / (k + F.col("rank"))).alias("share"))
    grouped = rankings.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(share)).alias("shares"))
    # A chunk stands once in each ranking: as many shares as rankings; added in their order.
    total = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x["share"])
    seen = F.col("shares")[0]
    fused = grouped.select("query_id", "chunk_id", total.alias("score"), seen["ranking_no"].alias("first_no"), seen["rank"].alias("first_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_no", "first_rank")
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", "score", "rank")


#: Rows that a task sorts, about.
ROWS_A_TASK = 250_000


def _tasks(n: int) -> int:
    return max(1, -(-n // ROWS_A_TASK))


def clause_ranking(refs: DataFrame, candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank: chunks of the clauses that a query names.

    ``refs``: query_id, ref; ``candidates``: query_id, chunk_id, rank (a few a query);
    ``chunks``: chunk_id, doc, clause, chunk_seq. Documents with more and better
    candidates come first; within a document candidates in their order, then the other
    chunks in theirs.
    """
    return _named(refs, candidates, chunks).select("query_id", "chunk_id", "rank")


def _named(refs: DataFrame, candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """``clause_ranking``, with ``before`` (the rank as a candidate) and ``fresh`` (how many up to here are none).

    Rows are as many as queries and chunks share clauses. They are made with all that
    orders them from the candidates of their query, and travel once, to as many tasks
    as they fill.
    """
    refs = refs.where("ref is not null").select("query_id", "ref").distinct()
    known = chunks.select("chunk_id", "doc", clause_base("clause").alias("ref"), "chunk_seq").where("ref is not null")
    best = candidates.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    of_docs = candidates.join(chunks.select("chunk_id", "doc").distinct(), "chunk_id").where("doc is not null").groupBy("query_id", "doc").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("affinity"))
    pairs = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    asked = (
        refs.join(refs.groupBy("query_id").agg(F.collect_list("ref").alias("refs")), "query_id")
        .join(best.where("chunk_id is not null").groupBy("query_id").agg(pairs("chunk_id", "rank").alias("ranks")), "query_id", "left")
        .join(of_docs.groupBy("query_id").agg(pairs("doc", "affinity").alias("affinities")), "query_id", "left")
    )
    asked, seen = measured(asked, "asked", n=F.count("*"))
    # A chunk of several clauses stands by the first of those that the query names.
    dealt = known.repartition(_tasks(chunks.count()), "chunk_id")
    of_ref = dealt.groupBy("chunk_id", "ref").agg(F.min_by("doc", "chunk_seq").alias("doc"), F.min("chunk_seq").alias("chunk_seq"))
    ahead = Window.partitionBy("chunk_id").orderBy("chunk_seq", "ref").rowsBetween(Window.unboundedPreceding, -1)
    of_ref = written(of_ref.withColumn("ahead", F.collect_list("ref").over(ahead)), "clauses")
    sizes = asked.groupBy("ref").agg(F.count("*").alias("asked")).join(of_ref.groupBy("ref").agg(F.count("*").alias("known")), "ref")
    n = sizes.agg(F.sum(F.col("asked") * F.col("known"))).first()[0] or 0
    if seen["n"] <= SENT_ASKED:
        met = of_ref.join(F.broadcast(asked), "ref")
    else:  # a clause of many chunks meets its queries in many parts
        parts = _tasks(chunks.count())
        left = of_ref.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
        met = left.join(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["ref", "part"])
    rows = met.where(~F.arrays_overlap("ahead", "refs")).select(
        "query_id", "chunk_id", "chunk_seq", F.try_element_at("ranks", "chunk_id").alias("before"), F.round(F.coalesce(F.try_element_at("affinities", "doc"), F.lit(0.0)), 12).alias("affinity")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("affinity"), F.col("before").asc_nulls_last(), "chunk_seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.repartition(_tasks(n), "query_id")
    return placed.select("query_id", "chunk_id", F.row_number().over(order).alias("rank"), "before", F.count_if(F.col("before").isNull()).over(upto).alias("fresh"))


def hybrid(vector: DataFrame, keyword: DataFrame | None, refs: DataFrame, chunks: DataFrame, k: int = 5, bm25_weight: float = BM25_WEIGHT) -> DataFrame:
    """Fuse vector and keyword rankings (of 20 each) and, for queries that name clauses, the clause ranking."""
    rankings = vector.select("query_id", "chunk_id", "rank").withColumn("ranking_no", F.lit(0))
    weights = {0: VECTOR_WEIGHT, 2: CLAUSE_WEIGHT}
    if bm25_weight > 0 and keyword is not None:
        rankings = rankings.unionByName(keyword.select("query_id", "chunk_id", "rank").withColumn("ranking_no", F.lit(1)))
        weights[1] = bm25_weight
    rankings = written(rankings, "rankings")
    # A chunk that stands in the clause ranking alone is behind all such chunks before it: beyond the k-th none is among the k best.
    named = _named(refs, fuse(rankings, weights), chunks).where(F.col("before").isNotNull() | (F.col("fresh") <= k))
    return fuse(rankings.unionByName(named.select("query_id", "chunk_id", "rank").withColumn("ranking_no", F.lit(2))), weights).where(F.col("rank") <= k)


def preview(text: Column | str, n: int = 60) -> Column:
    return F.substring(F.replace(col(text), F.lit("\n"), F.lit(" ")), 1, n)

"""Queries by name, each with the SQL that states its result where SQL can.

Inputs that the driver's tables do not have (Thai clauses, dirty text, rankings, judged
answers) are made from them inside the query, row by row, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import text as T
from clauselake.operators import answers, chunking, enrich, evaluation, retrieval, segment
from clauselake.sources import store
from clauselake.sources.scratch import spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# pages and text

_GATE = r"""
    WITH s AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
    m AS (SELECT doc_id, lang, t, length(t) AS n, regexp_replace(t, '[\p{C}\p{Z}]', '', 'g') AS p FROM s),
    r AS (SELECT doc_id, lang, n, contains(t, '(cid:') AS cid, length(regexp_replace(t, '[^\x{F700}-\x{F8FF}]', '', 'g')) AS pua,
                 CASE WHEN length(p) = 0 THEN 0.0 ELSE CAST(length(regexp_replace(p, '[^SCRIPT]', '', 'g')) AS DOUBLE) / length(p) END AS ratio FROM m),
    q AS (SELECT *, CASE WHEN n < 20 THEN 'short' WHEN cid THEN 'cid' WHEN pua > 0 THEN 'private_use' WHEN ratio < 0.15 THEN 'ratio' ELSE 'ok' END AS reason FROM r)
"""


def _gate(spark: SparkSession, sf_dir: str, script: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.quality("text", script).alias("q"))


@query(_GATE.replace("SCRIPT", r"\x{0E00}-\x{0E7F}") + "SELECT doc_id, reason <> 'ok' AS needs_ocr, reason, CASE reason WHEN 'short' THEN n WHEN 'private_use' THEN pua WHEN 'ratio' THEN round(ratio, 9) END AS detail FROM q")
def quality_gate(spark, sf_dir):
    return _gate(spark, sf_dir, T.THAI).select("doc_id", "q.needs_ocr", "q.reason", F.round("q.detail", 9).alias("detail"))


@query(_GATE.replace("SCRIPT", "a-zA-Z") + "SELECT coalesce(lang, 'all') AS lang, count(*) AS pages, count(*) FILTER (WHERE reason <> 'ok') AS ocr_pages FROM q GROUP BY ROLLUP (lang)")
def quality_report(spark, sf_dir):
    return _gate(spark, sf_dir, "a-zA-Z").rollup("lang").agg(F.count("*").alias("pages"), F.count_if("q.needs_ocr").alias("ocr_pages")).withColumn("lang", F.coalesce("lang", F.lit("all")))


def _conversation_pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("page_number"), "text")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, ''))) AS sha, sum(length(coalesce(text, ''))) + 2 * (count(*) - 1) AS n FROM conversations GROUP BY conv_id")
def join_pages(spark, sf_dir):
    return chunking.join_pages(_conversation_pages(spark, sf_dir)).select("doc", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber,
        'ำ "' || l_returnflag || '" ''' || CAST(l_orderkey AS VARCHAR) || '''' || chr(10) || chr(10) || 'x  y' || chr(10) || 'ข้อ ' || CAST(l_linenumber AS VARCHAR) AS cleaned
    FROM lineitem"""
)
def clean_text(spark, sf_dir):
    """Split vowel, Thai digits, curly quotes, blank lines, trailing white space, page-number and figure lines."""
    number = F.translate(F.col("l_orderkey").cast("string"), "0123456789", T.THAI_DIGITS)
    dirty = F.concat(
        F.lit(" ํา “"), "l_returnflag", F.lit("” ‘"), number, F.lit("’ \t\n\n\n- 3 -\n\n(University logo)\nx  y   \nข้อ "), F.translate(F.col("l_linenumber").cast("string"), "0123456789", T.THAI_DIGITS), F.lit("\nหน้า ๑๒\n<page_number>5/30</page_number>\n\n")
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.clean(dirty).alias("cleaned"))


@query("SELECT n_nationkey, 'a' || chr(10) || n_name || ' ' || r_name || chr(10) || r_name || chr(10) || 'b' AS lines FROM nation JOIN region ON n_regionkey = r_regionkey")
def flatten_tables(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    html = F.concat(F.lit("a<TABLE><tr><td>"), "n_name", F.lit("</td><td> </td><td class='x'> "), "r_name", F.lit("</td></tr><tr><td></td></tr><tr><td>"), "r_name", F.lit("</td></tr></table>b"))
    return both.select("n_nationkey", T.flatten_tables(html).alias("lines"))


@query("SELECT n_nationkey, n_name || chr(10) || chr(10) || 'see 3/10' AS kept FROM nation")
def remove_page_lines(spark, sf_dir):
    page = F.concat(F.col("n_name"), F.lit("\n\n  - "), F.col("n_nationkey").cast("string"), F.lit(" -  \n\n3/10\nsee 3/10"))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.collapse_blank_lines(T.remove_page_lines(page)).alias("kept"))


# chunks

_ORDERS = """
    WITH k AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, l_linenumber AS n, l_returnflag AS flag,
                      'ข้อ ' || CAST(l_linenumber AS VARCHAR) || ' ' || l_linestatus || ' ' || CAST(l_partkey AS VARCHAR) AS line FROM lineitem),
    l AS (SELECT *, lag(flag) OVER w AS was, lead(flag) OVER w AS next, row_number() OVER w AS seq FROM k WINDOW w AS (PARTITION BY doc ORDER BY n, flag, line))
"""


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of clauses per order: a clause a line, a chapter heading where the return flag changes."""
    line = F.concat_ws(" ", F.lit("ข้อ"), F.col("l_linenumber").cast("string"), "l_linestatus", F.col("l_partkey").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("flag"), line.alias("line"))))
    items = table(spark, sf_dir, "lineitem")
    # Lists of a task are sorted: as many tasks as lines fill.
    dealt = items.repartition(max(1, -(-items.count() // 500_000)), F.col("l_orderkey").cast("string"))
    docs = dealt.groupBy(F.col("l_orderkey").cast("string").alias("doc")).agg(lines.alias("lines"))

    def shown(x, i):
        new = (i == 0) | (F.get("lines", i - 1)["flag"] != x["flag"])
        return F.when(new, F.concat(F.lit("หมวด 1 "), x["flag"], F.lit("\n"), x["line"])).otherwise(x["line"])

    return docs.select("doc", F.array_join(F.transform("lines", shown), "\n").alias("text"))


@query(
    _ORDERS
    + """SELECT doc || '_ข_อ_' || CAST(n AS VARCHAR) AS id, doc, 'ข้อ ' || CAST(n AS VARCHAR) AS clause, 'หมวด 1 ' || flag AS chapter,
               line || CASE WHEN next IS NOT NULL AND next <> flag THEN chr(10) || 'หมวด 1 ' || next ELSE '' END AS text, seq AS chunk_seq FROM l"""
)
def chunk_clauses(spark, sf_dir):
    return chunking.chunk_documents(order_documents(spark, sf_dir))


@query("SELECT doc_id, CAST(greatest(0, ceil((length(text) - 1000) / 800.0)) AS INTEGER) + 1 AS parts, sha256(substr(text, 1, 1000)) AS first, sha256(substr(text, CAST(greatest(0, ceil((length(text) - 1000) / 800.0)) AS INTEGER) * 800 + 1, 1000)) AS last FROM documents")
def overlap_split(spark, sf_dir):
    parts = chunking.split_overlapping("text", chunking.FALLBACK_CHARS, chunking.FALLBACK_OVERLAP)
    found = table(spark, sf_dir, "documents").select("doc_id", parts.alias("p"))
    return found.select("doc_id", F.size("p").alias("parts"), F.sha2(F.get("p", F.lit(0)), 256).alias("first"), F.sha2(F.element_at("p", -1), 256).alias("last"))


@query("WITH w AS (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) SELECT event_id, user_id, value FROM w WHERE m IS NULL OR value >= m")
def rising_numbers(spark, sf_dir):
    return chunking.accept_rising(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM events QUALIFY event_type <> 'error'")
def chapter_as_of(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    labels = events.where("event_type = 'error'").select("user_id", "event_id", F.col("props").alias("label"))
    return chunking.label_as_of(events.where("event_type <> 'error'").select("user_id", "event_id"), labels, "user_id", "event_id").select("event_id", "user_id", "label")


@query(_ORDERS + "SELECT DISTINCT doc, 'ข้อ ' || CAST(n AS VARCHAR) AS clause FROM l")
def known_clauses(spark, sf_dir):
    return evaluation.known_clauses(chunking.chunk_documents(order_documents(spark, sf_dir)))


@query(
    _ORDERS
    + """, b AS (SELECT doc, seq, '## ข้อ ' || CAST(n AS VARCHAR) || '  (' || doc || '_ข_อ_' || CAST(n AS VARCHAR) || ')' || chr(10) || chr(10) || '*หมวด 1 ' || flag || '*' || chr(10) || chr(10)
                || line || CASE WHEN next IS NOT NULL AND next <> flag THEN chr(10) || 'หมวด 1 ' || next ELSE '' END || chr(10) AS block FROM l)
        SELECT doc, '# ' || doc || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY seq) AS markdown FROM b GROUP BY doc"""
)
def debug_markdown(spark, sf_dir):
    return chunking.markdown(chunking.chunk_documents(order_documents(spark, sf_dir)))


# retrieval

_BM25 = r"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    dl AS (SELECT d.doc_id, count(term) AS dl FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id),
    s AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean FROM dl),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
    idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
    q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
    sc AS (SELECT query_id, doc_id AS chunk_id, sum(times * (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)))) AS score
           FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), s GROUP BY ALL),
    kw AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM sc WHERE score > 0)
"""


def _bm25(spark, sf_dir, k):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), retrieval.words("text").alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), retrieval.words("text").alias("tokens"))
    return retrieval.Bm25(docs).search(asked, k)


@query(_BM25 + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


_KNN = """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)) AS score FROM v q, v WHERE q.vec_id % 100 = 0),
    n AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s)
"""


def _knn(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.knn(vectors, vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), k)


@query(_KNN + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM n WHERE rank <= 5")
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir, 5).withColumn("score", F.round("score", 6))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = l_partkey THEN ['ข้อ ' || CAST(l_linenumber AS VARCHAR)] ELSE ['ข้อ ' || CAST(l_linenumber AS VARCHAR), 'ข้อ ' || CAST(l_partkey AS VARCHAR)] END
              || ['มาตรา ' || CAST(l_suppkey AS VARCHAR)] AS refs FROM lineitem"""
)
def clause_refs(spark, sf_dir):
    number = lambda c: F.col(c).cast("string")
    asked = F.concat(F.lit("ตามข้อ "), F.translate(number("l_linenumber"), "0123456789", T.THAI_DIGITS), F.lit(".2 และหัวข้อ"), number("l_partkey"), F.lit("/1 ข้อ 0"), number("l_linenumber"), F.lit(" มาตรา\n"), number("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", retrieval.clause_refs(asked).alias("refs"))


@query(
    _KNN
    + """, r AS (SELECT query_id, chunk_id, 0 AS no, rank, 1.0 / (60 + rank) AS share FROM n WHERE rank <= 20
                UNION ALL SELECT query_id, chunk_id, 1, CAST(21 - rank AS INTEGER), 0.5 / (60 + 21 - rank) FROM n WHERE rank <= 20 AND chunk_id % 2 = 0),
    f AS (SELECT query_id, chunk_id, coalesce(max(share) FILTER (WHERE no = 0), 0) + coalesce(max(share) FILTER (WHERE no = 1), 0) AS score, min(no * 1000 + rank) AS seen FROM r GROUP BY ALL)
    SELECT query_id, chunk_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INTEGER) AS rank FROM f"""
)
def rrf_fuse(spark, sf_dir):
    first = _knn(spark, sf_dir, 20).select("query_id", "chunk_id", "rank")
    second = first.where("chunk_id % 2 = 0").select("query_id", "chunk_id", (21 - F.col("rank")).alias("rank"), F.lit(1).alias("ranking_no"))
    return retrieval.fuse(first.withColumn("ranking_no", F.lit(0)).unionByName(second), {0: 1.0, 1: 0.5}).withColumn("score", F.round("score", 9))


_NAMED = (
    _KNN
    + """, c AS (SELECT * FROM n WHERE rank <= 20), p AS (SELECT vec_id AS chunk_id, vec_id % 7 AS doc, label FROM v),
    a AS (SELECT query_id, doc, sum(1.0 / (60 + rank)) AS affinity FROM c JOIN p USING (chunk_id) GROUP BY ALL),
    m AS (SELECT q.vec_id AS query_id, p.chunk_id, p.doc FROM v q JOIN p ON p.label = q.label WHERE q.vec_id % 100 = 0),
    k AS (SELECT m.query_id, m.chunk_id, CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY round(coalesce(affinity, 0), 12) DESC, c.rank NULLS LAST, m.chunk_id) AS INTEGER) AS rank
          FROM m LEFT JOIN a ON a.query_id = m.query_id AND a.doc = m.doc LEFT JOIN c ON c.query_id = m.query_id AND c.chunk_id = m.chunk_id)
"""
)


def _labelled(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    clause = F.concat(F.lit("ข้อ "), F.col("label").cast("string"))
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 7).cast("string").alias("doc"), F.concat(clause, F.lit("/1")).alias("clause"), F.col("vec_id").alias("chunk_seq"))
    refs = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), clause.alias("ref"))
    return chunks, refs


@query(_NAMED + "SELECT query_id, chunk_id, rank FROM k")
def clause_match(spark, sf_dir):
    chunks, refs = _labelled(spark, sf_dir)
    return retrieval.clause_ranking(refs, _knn(spark, sf_dir, retrieval.CANDIDATES), chunks)


@query(
    _NAMED
    + """, r AS (SELECT query_id, chunk_id, 0 AS no, rank FROM c UNION ALL SELECT query_id, chunk_id, 2, rank FROM k),
    f AS (SELECT query_id, chunk_id, coalesce(max(1.0 / (60 + rank)) FILTER (WHERE no = 0), 0) + coalesce(max(1.0 / (60 + rank)) FILTER (WHERE no = 2), 0) AS score, min(no * 100000 + rank) AS seen FROM r GROUP BY ALL),
    g AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INTEGER) AS rank FROM f)
    SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM g WHERE rank <= 5"""
)
def hybrid_topk(spark, sf_dir):
    chunks, refs = _labelled(spark, sf_dir)
    return retrieval.hybrid(_knn(spark, sf_dir, retrieval.CANDIDATES), None, refs, chunks, 5).withColumn("score", F.round("score", 9))


_BOTH = (
    _BM25
    + "," + _KNN.partition("WITH")[2].replace("q.vec_id % 100 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)").replace("v AS (", "ve AS (").replace("FROM v q, v", "FROM ve q, ve v").replace(" s AS (", " cosines AS (").replace("FROM s)", "FROM cosines)")
    + """, r AS (SELECT query_id, chunk_id, 0 AS no, rank, CAST(1 AS DOUBLE) / (60 + rank) AS share FROM n WHERE rank <= 20
                UNION ALL SELECT query_id, chunk_id, 1, rank, CAST(0.3 AS DOUBLE) / (60 + rank) FROM kw WHERE rank <= 20),
    f AS (SELECT query_id, chunk_id, coalesce(max(share) FILTER (WHERE no = 0), 0) + coalesce(max(share) FILTER (WHERE no = 1), 0) AS score, min(no * 1000 + rank) AS seen FROM r GROUP BY ALL),
    g AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INTEGER) AS rank FROM f)
    SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM g WHERE rank <= 5"""
)


@query(_BOTH)
def hybrid_keyword_topk(spark, sf_dir):
    """Vectors and keywords together, keywords at a weight of 0.3; vectors and documents share their numbers."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    near = retrieval.knn(vectors, vectors.withColumnRenamed("chunk_id", "query_id").join(asked, "query_id", "left_semi"), retrieval.CANDIDATES)
    chunks = vectors.select("chunk_id", F.lit("d").alias("doc"), F.lit(None).cast("string").alias("clause"), F.col("chunk_id").alias("chunk_seq"))
    refs = asked.select("query_id", F.lit(None).cast("string").alias("ref")).where("ref is not null")
    return retrieval.hybrid(near, _bm25(spark, sf_dir, retrieval.CANDIDATES), refs, chunks, 5, 0.3).withColumn("score", F.round("score", 9))


@query()
def segment_words(spark, sf_dir):
    """Documents without the spaces between their words, cut by the words of all benchmark items."""
    known = table(spark, sf_dir, "benchmark").select(F.explode(retrieval.words("text")).alias("word"))
    joined = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.replace("text", F.lit(" "), F.lit("")).alias("joined"))
    found = segment.segmented(joined, known, "doc_id", "joined", unspaced="a-zà-ÿ")
    return found.select("doc_id", F.size("tokens").alias("n"), F.sha2(F.array_join("tokens", " "), 256).alias("words"))


# contexts and answers

_CONTEXT = _BM25 + """, top AS (SELECT query_id, rank, d.* FROM kw JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 3),
    ctx AS (SELECT query_id, string_agg('[' || CAST(rank AS VARCHAR) || '] (' || source || ', ' || lang || ')' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank) AS c, count(*) AS n FROM top GROUP BY query_id)
""".replace("\\\\", "\\")


def _contexts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), F.col("lang").alias("clause"), F.lit(None).cast("string").alias("chapter"), "text")
    return answers.contexts(_bm25(spark, sf_dir, 3), docs)


@query(_CONTEXT + "SELECT query_id, sha256('เอกสารอ้างอิง:' || chr(10) || chr(10) || c || chr(10) || chr(10) || 'คำถาม: ' || b.text) AS prompt FROM ctx JOIN benchmark b ON b.item_id = query_id")
def context_prompt(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return _contexts(spark, sf_dir).join(asked, "query_id").select("query_id", F.sha2(answers.prompt("question", "contexts"), 256).alias("prompt"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS a, CAST(l_suppkey % 10 AS INTEGER) AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN a BETWEEN 1 AND 5 THEN [a] ELSE [] END || CASE WHEN a <> 3 THEN [3] ELSE [] END
           || CASE WHEN c BETWEEN 1 AND 5 AND c <> 3 AND c <> a THEN [c] ELSE [] END AS cited FROM l"""
)
def citations(spark, sf_dir):
    answer = F.concat(F.lit("ก ["), F.translate(F.col("l_linenumber").cast("string"), "0123456789", T.THAI_DIGITS), F.lit("] ข [3]["), (F.col("l_suppkey") % 10).cast("string"), F.lit("] [3] [0] [99999999999] [x]"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answers.citations(answer, F.lit(5)).alias("cited"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AND l_linestatus <> 'F' AS refused FROM lineitem")
def refused(spark, sf_dir):
    answer = F.concat(F.lit("<think>a\n[1]</think>"), F.when(F.col("l_returnflag") == "N", F.lit(answers.REFUSAL)).otherwise("คำตอบ"), F.when(F.col("l_linestatus") == "F", F.lit(" [1]")).otherwise(""))
    text = answers.without_thoughts(answer)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answers.refused(text, answers.citations(text, F.lit(3))).alias("refused"))


def _stub(prompt: str) -> str:
    """A backend that cites the second and the first context it is given."""
    return f"<think>{len(prompt)}</think>  answer of {len(prompt)} characters [2] [1] [9]  "


@query(_CONTEXT + """SELECT query_id, 'answer of ' || CAST(length('เอกสารอ้างอิง:' || c || 'คำถาม: ' || b.text) + 4 AS VARCHAR) || ' characters [2] [1] [9]' AS answer,
                     CASE WHEN n >= 2 THEN [2, 1] ELSE [1] END AS citations, false AS refused FROM ctx JOIN benchmark b ON b.item_id = query_id""")
def generate_answers(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    contexts = written(_contexts(spark, sf_dir), "contexts")
    found = answers.generate(asked.join(contexts.select("query_id"), "query_id", "left_semi"), contexts, _stub)
    return found.select("query_id", "answer", "citations", "refused")


# evaluation

_HITS = _KNN + """, r AS (SELECT query_id, rank, p.vec_id % 50 AS doc, p.label FROM n JOIN v p ON p.vec_id = chunk_id WHERE rank <= 20),
    d AS (SELECT query_id, doc, label, min(rank) AS rank FROM r GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM d),
    h AS (SELECT q.vec_id AS query_id, CAST(min(place) AS INTEGER) AS hit, any_value(CASE q.label % 2 WHEN 0 THEN 'direct' ELSE 'semantic' END) AS type
          FROM v q LEFT JOIN o ON o.query_id = q.vec_id AND o.label = q.label AND o.doc = (q.vec_id + 7) % 50 WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id)
"""


def _hits(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("clause"), (F.col("vec_id") % 50).cast("string").alias("doc"), "label")
    results = _knn(spark, sf_dir, evaluation.DEPTH).join(vectors.select(F.col("vec_id").alias("chunk_id"), "doc", "clause"), "chunk_id")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), ((F.col("vec_id") + 7) % 50).cast("string").alias("doc"), "clause")
    kinds = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") % 2 == 0, "direct").otherwise("semantic").alias("type"))
    return evaluation.first_hit(results, asked).join(kinds, "query_id")


@query(_HITS + "SELECT query_id, hit, type FROM h")
def first_hit(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(_HITS + "SELECT coalesce(type, 'all') AS type, count(*) AS n, count(*) FILTER (WHERE hit <= 1) AS hit1, count(*) FILTER (WHERE hit <= 3) AS hit3, count(*) FILTER (WHERE hit <= 5) AS hit5, round(sum(coalesce(1.0 / hit, 0)) / count(*), 9) AS mrr FROM h GROUP BY ROLLUP (type)")
def retrieval_report(spark, sf_dir):
    return evaluation.retrieval_report(_hits(spark, sf_dir), "type")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 < 3 AND l_linenumber BETWEEN 1 AND 5 AND l_quantity <= 5 THEN CAST(l_linenumber AS INTEGER) END AS correctness,
              CASE WHEN l_suppkey % 4 < 3 AND l_linenumber BETWEEN 1 AND 5 AND l_quantity <= 5 THEN CAST(l_quantity AS INTEGER) END AS faithfulness FROM lineitem"""
)
def judge_parse(spark, sf_dir):
    """Whole numbers, numbers with a fraction, numbers as text, and broken answers."""
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_suppkey") % 4
    given = F.when(kind == 0, F.concat(F.lit("ok {\"correctness\": "), n, F.lit(", \"faithfulness\": \""), q, F.lit("\", \"reason\": \"r\"} end"))).when(kind == 1, F.concat(F.lit("{\"correctness\": "), n, F.lit(".7,\n\"faithfulness\": "), q, F.lit("}"))).when(
        kind == 2, F.concat(F.lit("{\"faithfulness\": "), q, F.lit(", \"correctness\": \" "), n, F.lit("\"}"))
    )
    given = given.otherwise(F.concat(F.lit("{\"correctness\": "), n, F.lit("}")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evaluation.judgement(given).alias("j")).select("l_orderkey", "l_linenumber", "j.correctness", "j.faithfulness")


_ROWS = """
    WITH r AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'direct' ELSE 'multi' END AS type, l_returnflag = 'R' AS refused,
                      CAST(l_partkey % 3 AS INTEGER) AS a, CAST(l_suppkey % 3 AS INTEGER) AS b,
                      CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_suppkey % 5 AS INTEGER) END AS correctness, CASE WHEN l_partkey % 6 > 0 THEN CAST(l_partkey % 6 AS INTEGER) END AS faithfulness, l_partkey % 7 = 0 AS bad FROM lineitem)
"""
_MEASURES = """
    count(*) AS n, count(*) FILTER (WHERE type <> 'unanswerable') AS n_answerable, count(*) FILTER (WHERE type = 'unanswerable') AS n_unanswerable,
    round((count(*) FILTER (WHERE (type = 'unanswerable') = refused)) / count(*), 9) AS refusal_accuracy,
    count(*) FILTER (WHERE type = 'unanswerable' AND refused) AS correct_refusals, count(*) FILTER (WHERE type = 'unanswerable' AND NOT refused) AS hallucinated_answers,
    count(*) FILTER (WHERE type <> 'unanswerable' AND refused) AS false_refusals,
    round((count(*) FILTER (WHERE type <> 'unanswerable' AND NOT refused AND a = b)) / nullif(count(*) FILTER (WHERE type <> 'unanswerable' AND NOT refused), 0), 9) AS citation_hit,
    round((2 * count(*) FILTER (WHERE type <> 'unanswerable' AND NOT refused AND a = b)) / nullif(3 * count(*) FILTER (WHERE type <> 'unanswerable' AND NOT refused), 0), 9) AS citation_precision,
    round(avg(correctness) FILTER (WHERE type <> 'unanswerable'), 9) AS correctness, round(avg(faithfulness) FILTER (WHERE type <> 'unanswerable' AND NOT refused), 9) AS faithfulness,
    count(*) FILTER (WHERE bad) AS judge_errors FROM r
"""


def _eval_rows(spark, sf_dir):
    pair = lambda c, doc: F.struct(F.lit(doc).alias("doc"), F.when(F.col(c) % 3 > 0, (F.col(c) % 3).cast("string")).alias("clause"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "unanswerable").when(F.col("l_linenumber") % 3 == 1, "direct").otherwise("multi")
    score = lambda c, n: F.when(F.col(c) % n > 0, F.col(c) % n).cast("int")
    bad = F.when(F.col("l_partkey") % 7 == 0, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "lineitem").select(
        kind.alias("type"), (F.col("l_returnflag") == "R").alias("refused"), F.array(pair("l_partkey", "d"), pair("l_partkey", "e"), pair("l_partkey", "d")).alias("cited"), F.array(pair("l_suppkey", "d")).alias("expected"), score("l_suppkey", 5).alias("correctness"), score("l_partkey", 6).alias("faithfulness"), bad.alias("errors")
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_ROWS + "SELECT" + _MEASURES)
def answer_metrics(spark, sf_dir):
    return _rounded(evaluation.answer_metrics(_eval_rows(spark, sf_dir)))


@query(_ROWS + "SELECT type," + _MEASURES + "GROUP BY type")
def answer_metrics_by_type(spark, sf_dir):
    return _rounded(evaluation.answer_metrics(_eval_rows(spark, sf_dir), "type"))


@query(
    """WITH q AS (SELECT o_orderkey AS line, CAST(o_custkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'direct' WHEN 'O' THEN 'unanswerable' ELSE 'other' END AS type, o_orderkey % 3 AS k FROM orders),
    n AS (SELECT type, count(*) AS n FROM q GROUP BY type)
    SELECT line, 'repeated id' AS rule, id AS detail FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS r FROM q) WHERE r > 1
    UNION ALL SELECT line, 'unknown type', type FROM q WHERE type = 'other'
    UNION ALL SELECT line, 'expected not empty', CAST(k AS VARCHAR) FROM q WHERE type = 'unanswerable' AND k > 0
    UNION ALL SELECT line, 'expected empty', type FROM q WHERE type <> 'unanswerable' AND k = 0
    UNION ALL SELECT line, 'unknown clause', 'd|-' FROM q WHERE k = 2
    UNION ALL SELECT NULL, 'too few', t || '=' || CAST(coalesce(n, 0) AS VARCHAR) FROM (SELECT unnest(['direct', 'multi', 'semantic', 'unanswerable']) AS t) LEFT JOIN n ON t = type WHERE coalesce(n, 0) < 10"""
)
def validate_questions(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "direct").when(F.col("o_orderstatus") == "O", "unanswerable").otherwise("other")
    pair = lambda clause: F.struct(F.lit("d").alias("doc"), clause.alias("clause"))
    both = F.array(pair(F.lit("ข้อ 1")), pair(F.lit(None).cast("string")))
    questions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), F.col("o_custkey").cast("string").alias("id"), kind.alias("type"), F.lit("q").alias("question"), F.slice(both, F.lit(1), (F.col("o_orderkey") % 3).cast("int")).alias("expected"), F.lit("a").alias("reference_answer"))
    return evaluation.validate_questions(questions, spark.createDataFrame([("d", "ข้อ 1")], "doc string, clause string"))


# tables and caches


@query("SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE source <> 'src1' AND NOT (doc_id % 3 <> 0 AND source IN (SELECT source FROM documents WHERE doc_id % 3 = 0 AND source <> 'src1' AND doc_id % 2 = 0)) AND (doc_id % 3 <> 0 OR doc_id % 2 = 0 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 3 = 0 AND source <> 'src1' AND doc_id % 2 = 0))")
def replace_by_doc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    marked = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "new").otherwise(F.col("lang")))
    new = marked.where("doc_id % 3 = 0 and source <> 'src1' and doc_id % 2 = 0")
    return store.replace_by(marked, new, "source", spark.createDataFrame([("src1",)], "source string"))


@query("SELECT sha256(text) AS sha256, min('doc' || lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS doc FROM documents GROUP BY 1")
def find_by_hash(spark, sf_dir):
    registry = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("doc"))
    return store.find_by_hash(registry, registry)


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def registry_upsert(spark, sf_dir):
    """One record of each key, the last one saved."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return store.last_by(rows, "o_custkey", "o_orderkey")


@query(
    """SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id
    FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc_' || CAST(doc_id AS VARCHAR))) AS d FROM documents)"""
)
def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.point_id(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("point_id"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(1 AS INTEGER) AS page_number, CASE WHEN doc_id % 2 = 0 THEN 'cached' ELSE 'read h' || CAST(doc_id AS VARCHAR) || '/stub_m/1' END AS text
       FROM documents WHERE length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 200""".replace("\\\\", "\\")
)
def ocr_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = enrich.page_key(F.concat(F.lit("h"), F.col("doc_id").cast("string")), enrich.model_key(F.lit("stub"), F.lit("m")), F.lit(1))
    pages = docs.select(F.col("doc_id").cast("string").alias("doc"), F.lit(1).alias("page_number"), T.quality("text", "a-zA-Z", 200, 0.0)["needs_ocr"].alias("needs_ocr"), key.alias("key"))
    cache = docs.where("doc_id % 2 = 0").select(key.alias("key"), F.lit("cached").alias("response"))
    return enrich.ocr(pages, cache, enrich.escalating(lambda page, size: (f"read {page}", size < 16384)))[0].select("doc", "page_number", "text")

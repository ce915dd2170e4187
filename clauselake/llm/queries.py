"""The operators as queries over the tables of ``sf_dir``, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import bpe, chat, conversation, divergence, edit_fingerprint, exact_dedup, langid, mixing, near_dedup, pii, repeats, tokenfile, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    mix = mixing.mix(docs, F.array("source"), mixing.n_words(F.col("text")), mixing.cyclic_weights, share=1.5, max_epochs=2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf_dir), width=4, percent=80)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary(spark, f"file:{public_tokenizers.path('byte_bpe_50k.tiktoken')}", public_tokenizers.PATTERN)
    return bpe.round_trip(_documents(spark, sf_dir), vocabulary)


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir), key="a key of the corpus")


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.token_table(_documents(spark, sf_dir), f"file:{public_tokenizers.path('byte_bpe_50k.json')}", end_id=2)


def op7_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.with_edited(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score(_documents(spark, sf_dir), labels, usable=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = langid.identify(_documents(spark, sf_dir), train=~F.coalesce(held_out, F.lit(True)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir), least_docs=3, most=200)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_passages(_documents(spark, sf_dir), least=400)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_chat_repair": op4_chat_repair,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_wavelet_shards": op6_wavelet_shards,
    "op7_edit_fingerprint": op7_edit_fingerprint,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_repeated_passages": op13_repeated_passages,
}

ORACLE: dict[str, str] = {
    "op1_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('17:' || CAST(doc_id AS VARCHAR)) AS o
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
            FROM sized GROUP BY source
        ), ranked AS (  -- in the order in which sources reach twice their size
            SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k FROM sources
        ), levels AS (
            SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM ranked
        ), stop AS (
            SELECT min_by(level, k) AS level FROM levels WHERE level * w <= 2.0 * source_size
        ), targets AS (
            SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), (SELECT level FROM stop) * w) AS target FROM sources
        ), placed AS (
            SELECT doc_id, size, source_size, target,
                   sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
            FROM sized JOIN targets USING (source)
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * ((2 * start + size < 2 * CAST(floor(target) AS BIGINT))::INT
                    + (2 * (source_size + start) + size < 2 * CAST(floor(target) AS BIGINT))::INT) AS BIGINT) AS taken
        FROM placed
    """,
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] || ' ' || a[i + 3] AS sh FROM w, unnest(range(1, len(a) - 2)) AS t(i) WHERE len(a) >= 4
            UNION ALL SELECT doc_id, array_to_string(a, ' ') FROM w WHERE len(a) BETWEEN 1 AND 3
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
        ), edges AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reach AS (
            SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN edges ON x = r
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
        FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
    """,
    "op10_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op11_source_divergence": r"""
        WITH words AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, doc_id,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), kept AS (
            SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3
        ), langs AS (
            SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
        ), occurring AS (
            SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
        ), counts AS (
            SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), sizes AS (
            SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL
        ), shares AS (  -- of every kept term in every group
            SELECT o.lang, o.source, k.term, coalesce(c.c, 0) AS c, k.c AS lang_c,
                   1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + l.v)::HUGEINT AS p,
                   1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v)::HUGEINT AS q
            FROM occurring o JOIN kept k USING (lang) JOIN langs l USING (lang)
            LEFT JOIN sizes s ON s.lang = o.lang AND s.source = o.source
            LEFT JOIN counts c ON c.lang = o.lang AND c.source = o.source AND c.term = k.term
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source != b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), terms AS (
            SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM shares WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
            UNION ALL
            SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
        )
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}

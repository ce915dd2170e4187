"""Scores of retrieval and of answers, and checks of question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.functions.text import col

# Cut-offs, question types, and the least number of questions of each type.
HITS = (1, 3, 5)
DEPTH = 20
TYPES = ("direct", "multi", "semantic", "unanswerable")
FIELDS = ("id", "question", "type", "expected", "reference_answer")
MIN_PER_TYPE = 10


def first_hit(results: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, hit: rank of the first expected (doc, clause) among the different ones in the results; null if none.

    ``results``: query_id, rank, doc, clause; ``expected``: query_id, doc, clause. A null
    clause stands for a document's preamble and equals itself.
    """
    different = results.groupBy("query_id", "doc", "clause").agg(F.min("rank").alias("rank"))
    placed = different.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    wanted = expected.select(F.col("query_id").alias("q"), F.col("doc").alias("d"), F.col("clause").alias("c")).distinct()
    same = (F.col("query_id") == F.col("q")) & F.col("doc").eqNullSafe(F.col("d")) & F.col("clause").eqNullSafe(F.col("c"))
    hits = placed.join(wanted, same, "left_semi").groupBy("query_id").agg(F.min("place").alias("hit"))
    return expected.select("query_id").distinct().join(hits, "query_id", "left")


def retrieval_report(ranks: DataFrame, *keys: str) -> DataFrame:
    """n, hit1, hit3, hit5, mrr for each of ``keys`` (the last: question type) and over all types."""
    *outer, kind = keys
    rows = ranks.where(F.col(kind) != "unanswerable")
    sets = [[*outer, kind], outer]
    hits = [F.count_if(F.col("hit") <= k).alias(f"hit{k}") for k in HITS]
    mrr = F.round(F.sum(F.coalesce(1 / F.col("hit"), F.lit(0.0))) / F.count("*"), 9)
    grouped = rows.groupingSets(sets, *keys).agg(F.grouping(kind).alias("__all"), F.count("*").alias("n"), *hits, mrr.alias("mrr"))
    return grouped.withColumn(kind, F.when(F.col("__all") == 1, "all").otherwise(F.col(kind))).drop("__all")


def judgement(text: Column | str) -> Column:
    """struct(correctness, faithfulness, reason) from the outermost braces of a judge's answer; null unless both scores are 1 to 5."""
    found = F.regexp_extract(col(text), r"(?s)\{.*\}", 0)
    read = F.from_json(found, "correctness string, faithfulness string, reason string")

    def score(value: Column) -> Column:
        # A number is cut to a whole one; text must be a whole number.
        return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("int")).when(value.rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), F.floor(F.abs(value.try_cast("double"))).cast("int") * F.sign(value.try_cast("double")).cast("int"))

    c, f = score(read["correctness"]), score(read["faithfulness"])
    return F.when(c.between(1, 5) & f.between(1, 5), F.struct(c.alias("correctness"), f.alias("faithfulness"), F.coalesce(read["reason"], F.lit("")).alias("reason")))


def _in(pair: Column, pairs: Column) -> Column:
    return F.exists(pairs, lambda p: p["doc"].eqNullSafe(pair["doc"]) & p["clause"].eqNullSafe(pair["clause"]))


def answer_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Twelve measures of answers, for each of ``keys`` or over all rows. A mean over nothing is null.

    ``rows``: type, refused, cited and expected (arrays of struct(doc, clause)),
    correctness, faithfulness, errors. Questions whose call failed (refused is null)
    are counted, with their error, and take part in no share and no mean.
    """
    open_, no = F.col("type") != "unanswerable", F.col("refused")
    answered = open_ & ~no
    right = F.size(F.filter("cited", lambda c: _in(c, F.col("expected"))))
    measures = [
        F.count("*").alias("n"),
        F.count_if(open_).alias("n_answerable"),
        F.count_if(~open_).alias("n_unanswerable"),
        F.try_divide(F.count_if((~open_ & no) | answered), F.count("refused")).alias("refusal_accuracy"),
        F.count_if(~open_ & no).alias("correct_refusals"),
        F.count_if(~open_ & ~no).alias("hallucinated_answers"),
        F.count_if(open_ & no).alias("false_refusals"),
        F.try_divide(F.count_if(answered & (right > 0)), F.count_if(answered)).alias("citation_hit"),
        F.try_divide(F.sum(F.when(answered, right)), F.sum(F.when(answered, F.size("cited")))).alias("citation_precision"),
        F.avg(F.when(open_, F.col("correctness"))).alias("correctness"),
        F.avg(F.when(answered, F.col("faithfulness"))).alias("faithfulness"),
        F.count_if(F.size("errors") > 0).alias("judge_errors"),
    ]
    return rows.groupBy(*keys).agg(*measures)


def failures(rows: DataFrame) -> DataFrame:
    """Rows to look at: failed calls, made-up answers, false refusals, low scores, judge errors."""
    kind = F.when(F.col("refused").isNull(), "call_failed").when((F.col("type") == "unanswerable") & ~F.col("refused"), "hallucinated").when((F.col("type") != "unanswerable") & F.col("refused"), "false_refusal").when(F.coalesce("correctness", F.lit(5)) <= 2, "low").when(F.size("errors") > 0, "error")
    return rows.withColumn("failure", kind).where("failure is not null")


def evaluate_answers(answers: DataFrame, questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows for ``answer_metrics``: unanswerable questions are not judged; a false refusal scores 1 without a judge.

    ``answers``: query_id, answer, sources, refused, error; ``questions``: query_id,
    question, type, expected; ``verdicts``: query_id, response (of the judge), error. What
    either model failed with is in ``errors``; where an answer failed, ``refused`` is null.
    """
    given = answers.withColumn("__failed", F.col("error") if "error" in answers.columns else F.lit(None).cast("string"))
    said = verdicts.select("query_id", "response", (F.col("error") if "error" in verdicts.columns else F.lit(None).cast("string")).alias("__unjudged"))
    open_ = F.col("type") != "unanswerable"
    judged = open_ & ~F.col("refused")
    cited = F.transform("sources", lambda s: F.struct(s["doc"].alias("doc"), s["clause"].alias("clause")))
    rows = questions.join(given, "query_id").join(said, "query_id", "left").withColumn("verdict", judgement("response"))
    told = F.when(F.col("__failed").isNotNull(), F.concat(F.lit("answer: "), "__failed")).when(judged & F.col("__unjudged").isNotNull(), F.concat(F.lit("judge: "), "__unjudged")).when(judged & F.col("verdict").isNull(), "judge output could not be read")
    return rows.select(
        "query_id",
        "type",
        "question",
        "answer",
        F.when(F.col("__failed").isNull(), F.col("refused")).alias("refused"),
        cited.alias("cited"),
        "expected",
        F.when(open_ & F.col("refused"), 1).when(judged, F.col("verdict.correctness")).alias("correctness"),
        F.when(judged, F.col("verdict.faithfulness")).alias("faithfulness"),
        F.when(judged, F.col("verdict.reason")).alias("judge_reason"),
        F.array_compact(F.array(told)).alias("errors"),
    )


def known_clauses(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc", "clause").distinct()


def validate_questions(questions: DataFrame, known: DataFrame, least: int = MIN_PER_TYPE) -> DataFrame:
    """line, rule, detail: everything wrong with a question set.

    ``questions``: line, id, type, question, expected, reference_answer; a missing field
    is null. Rows about the whole set have no line.
    """
    q = questions
    missing = q.select("line", F.explode(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS])).alias("detail")).where("detail is not null").select("line", F.lit("missing").alias("rule"), "detail")
    again = F.row_number().over(Window.partitionBy("id").orderBy("line"))
    repeated = q.where("id is not null").withColumn("k", again).where("k > 1").select("line", F.lit("repeated id").alias("rule"), F.col("id").alias("detail"))
    unknown = q.where(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))).select("line", F.lit("unknown type").alias("rule"), F.col("type").alias("detail"))
    n = F.coalesce(F.size("expected"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    none = F.coalesce(F.col("type"), F.lit("")) == "unanswerable"
    expects = q.where(none & (n > 0)).select("line", F.lit("expected not empty").alias("rule"), n.cast("string").alias("detail"))
    lacks = q.where(~none & (n == 0)).select("line", F.lit("expected empty").alias("rule"), F.col("type").alias("detail"))
    asked = q.select("line", F.explode("expected").alias("e")).select("line", F.col("e.doc").alias("d"), F.col("e.clause").alias("c"))
    absent = asked.join(known.select("doc", "clause").distinct(), F.col("d").eqNullSafe(F.col("doc")) & F.col("c").eqNullSafe(F.col("clause")), "left_anti")
    absent = absent.select("line", F.lit("unknown clause").alias("rule"), F.concat_ws("|", "d", F.coalesce("c", F.lit("-"))).alias("detail"))
    every = q.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    few = every.join(q.groupBy("type").agg(F.count("*").alias("n")), "type", "left").where(F.coalesce("n", F.lit(0)) < least)
    few = few.select(F.lit(None).cast(questions.schema["line"].dataType).alias("line"), F.lit("too few").alias("rule"), F.concat_ws("=", "type", F.coalesce("n", F.lit(0)).cast("string")).alias("detail"))
    out = missing
    for part in (repeated, unknown, expects, lacks, absent, few):
        out = out.unionByName(part)
    return out


def retrieval_markdown(report: DataFrame) -> str:
    """A table of a retrieval report (method, type, n, hits, mrr): one row a method and type. Shares of nothing are dashes."""
    lines = ["| method | type | n | " + " | ".join(f"Hit@{k}" for k in HITS) + " | MRR |", "|" + "---|" * (len(HITS) + 4)]
    for r in report.orderBy("method", F.col("type") == "all", "type").collect():  # a few rows a method
        shares = [f"{r[f'hit{k}'] / r['n']:.3f}" if r["n"] else "-" for k in HITS]
        lines.append(f"| {r['method']} | {r['type']} | {r['n']} | " + " | ".join(shares) + f" | {r['mrr'] or 0:.3f} |")
    return "\n".join(lines)


def answers_markdown(metrics: DataFrame, bad: DataFrame) -> str:
    """Measures by type as a list, then all failures (see ``failures``), read one partition at a time."""
    lines = []
    for r in metrics.collect():  # one row a type
        row = r.asDict()
        lines.append(f"## {row.pop('type', 'all')}")
        lines += [f"- {name}: {'-' if v is None else round(v, 3)}" for name, v in row.items()]
    lines.append("## failures")
    places = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(" ", p["doc"], F.coalesce(p["clause"], F.lit("-")))), ", ")
    shown = [c for c in ("correctness", "faithfulness", "judge_reason") if c in bad.columns]
    for r in bad.select("query_id", "failure", "question", "answer", places("cited").alias("cited"), places("expected").alias("expected"), *shown, F.array_join("errors", "; ").alias("errors")).orderBy("query_id").toLocalIterator():
        row = r.asDict()
        lines.append(f"- {row.pop('query_id')} ({row.pop('failure')}): {row.pop('question')}\n  {row.pop('answer') or '-'}")
        lines += [f"  - {name}: {value}" for name, value in row.items() if value not in (None, "")]
    return "\n".join(lines)


def write_report(frame: DataFrame, text: str, folder: str, name: str) -> None:
    """A report as text and its rows as JSON, side by side in ``folder``."""
    spark = frame.sparkSession
    frame.coalesce(1).write.mode("errorifexists").json(f"{folder}/{name}.json")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/{name}.md")

import math

import pytest
from pyspark.sql import functions as F

from clauselake.operators import answers, enrich, evaluation, retrieval, vectors
from clauselake.sources import store


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_bm25_equals_the_formula(spark):
    texts = {1: ["a", "b", "a"], 2: ["a", "c"], 3: ["a", "d", "e"], 4: []}
    index = retrieval.Bm25(spark.createDataFrame(list(texts.items()), "chunk_id int, tokens array<string>"))
    n, mean = 4, 2.0
    df = {t: sum(t in x for x in texts.values()) for t in "abcde"}
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / 5
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    asked = spark.createDataFrame([("q", ["a", "b", "b", "zz"]), ("none", ["zz"])], "query_id string, tokens array<string>")
    got = {r["chunk_id"]: (r["score"], r["rank"]) for r in index.search(asked).collect()}
    want = {}
    for i, words in texts.items():
        s = sum(idf.get(t, 0) * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for t in ["a", "b", "b"])
        if s > 0:
            want[i] = s
    assert {i: pytest.approx(s) for i, s in want.items()} == {i: s for i, (s, _) in got.items()} and got[1][1] == 1
    with pytest.raises(ValueError):
        retrieval.Bm25(spark.createDataFrame([], "chunk_id int, tokens array<string>"))


def test_knn_orders_by_cosine_then_id(spark):
    v = spark.createDataFrame([(i, [1.0 if i % 3 == k else 0.0 for k in range(3)]) for i in range(9)] + [(99, [0.0, 0.0, 0.0]), (98, None)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([("x", [2.0, 0.0, 0.0]), ("y", [0.0, 1.0, 1.0])], "query_id string, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 6)) for r in retrieval.knn(v, q, 4, block=1).collect()}
    assert [got["x", k][0] for k in (1, 2, 3, 4)] == [0, 3, 6, 1] and got["x", 1][1] == 1.0 and got["y", 1] == (1, round(0.5**0.5, 6))
    assert retrieval.knn(v, q.limit(0)).count() == 0


def test_fusion_formula_weights_and_ties(spark):
    r = spark.createDataFrame([("q", 0, 1, "x"), ("q", 1, 1, "y"), ("q", 1, 2, "x"), ("q", 1, 3, "z")], "query_id string, ranking_no int, rank int, chunk_id string")
    got = [(x["chunk_id"], x["score"]) for x in retrieval.fuse(r).orderBy("rank").collect()]
    assert got == [("x", 1 / 61 + 1 / 62), ("y", 1 / 61), ("z", 1 / 63)]
    assert [x["chunk_id"] for x in retrieval.fuse(r, {0: 1.0, 1: 0.0}).orderBy("rank").collect()] == ["x", "y", "z"]
    with pytest.raises(Exception, match="no weight"):
        retrieval.fuse(r, {0: 1.0}).collect()


@pytest.mark.parametrize("sent,held", [(4_000_000, 500_000), (4_000_000, 5), (0, 0)])
def test_knn_equals_all_pairs(spark, monkeypatch, sent, held):
    """Queries sent to all tasks, cut back as they grow, and joined in blocks; equal scores, null and zero vectors."""
    import random

    rng = random.Random(1)
    plain = retrieval._best_of_all
    monkeypatch.setattr(retrieval, "_best_of_all", lambda k, asked: plain(k, asked, held))
    vectors = {i: [float(rng.randrange(-2, 3)) for _ in range(4)] for i in range(300)}
    v = spark.createDataFrame([*vectors.items(), (900, None), (901, [0.0] * 4)], "chunk_id long, embedding array<float>").repartition(5)
    asked = {i: vectors[i] for i in range(0, 300, 30)}
    q = spark.createDataFrame([*asked.items(), (902, None)], "query_id long, embedding array<float>")
    norm = lambda x: sum(a * a for a in x) ** 0.5
    want = set()
    for i, x in asked.items():
        scores = [(-round(sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y), 9), j) for j, y in vectors.items() if norm(x) and norm(y)]
        want |= {(i, j, r) for r, (_, j) in enumerate(sorted(scores)[:7], 1)}
    got = {(r.query_id, r.chunk_id, r["rank"]) for r in retrieval.knn(v, q, 7, block=4, part=100, sent=sent).collect()}
    assert got == want


def test_clause_references_and_ranking(spark):
    asked = ["ข้อ 15", "ข้อ ๑๕", "ข้อ17.2.5", "ข้อ 3 และ มาตรา 18 ข้อ 3", "ไม่มี", "หัวข้อ 007"]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    assert [r[0] for r in df.orderBy("i").select(retrieval.clause_refs("q")).collect()] == [["ข้อ 15"], ["ข้อ 15"], ["ข้อ 17"], ["ข้อ 3", "มาตรา 18"], [], ["ข้อ 7"]]
    chunks = spark.createDataFrame([("d6", "d", "ข้อ 6", 1), ("g1", "g", "ข้อ 1", 2), ("g2", "g", "ข้อ 2", 3), ("g6", "g", "ข้อ 6/1", 4)], "chunk_id string, doc string, clause string, chunk_seq long")
    found = spark.createDataFrame([("q", "d6", 4), ("q", "g1", 1), ("q", "g2", 2)], "query_id string, chunk_id string, rank int")
    refs = spark.createDataFrame([("q", "ข้อ 6")], "query_id string, ref string")
    assert [r["chunk_id"] for r in retrieval.clause_ranking(refs, found, chunks).orderBy("rank").collect()] == ["g6", "d6"]
    fused = retrieval.hybrid(found, None, refs, chunks, 2)
    assert [r["chunk_id"] for r in fused.orderBy("rank").collect()] == ["d6", "g1"]


def test_citations_refusals_and_formats(spark):
    df = spark.createDataFrame([(0, "ก [2] ข [1][2] ค [2]", 3), (1, "[0] [4] [3]", 3), (2, "[๑]", 1), (3, "none", 2)], "i int, t string, n int")
    assert [r[0] for r in df.orderBy("i").select(answers.citations("t", "n")).collect()] == [[2, 1], [3], [1], []]
    text = spark.createDataFrame([("<think>x\ny</think> " + answers.REFUSAL,)], "t string").select(answers.without_thoughts("t").alias("t"))
    assert text.select(answers.refused("t", F.array().cast("array<int>"))).first()[0] and not text.select(answers.refused("t", F.array(F.lit(1)))).first()[0]


def test_generation_context_and_prompt(spark):
    chunks = spark.createDataFrame([("a", "d.pdf", "ข้อ 1", None, " หนึ่ง "), ("b", "e.pdf", None, "หมวด 2", "สอง")], "chunk_id string, doc string, clause string, chapter string, text string")
    hits = spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "query_id string, chunk_id string, rank int")
    asked = spark.createDataFrame([("q", "อะไร"), ("r", "ไม่มี")], "query_id string, question string")
    found = answers.contexts(hits, chunks)
    out = {r["query_id"]: r for r in answers.generate(asked, found, lambda p: "ตาม [2]").collect()}
    assert out["q"]["citations"] == [2] and [s["chunk_id"] for s in out["q"]["sources"]] == ["a"] and not out["q"]["refused"]
    assert out["r"]["answer"] == answers.REFUSAL and out["r"]["refused"]
    prompt = asked.join(found, "query_id").select(answers.prompt("question", "contexts")).first()[0]
    assert prompt == "เอกสารอ้างอิง:\n\n[1] (e.pdf, หมวด 2)\nสอง\n\n[2] (d.pdf, ข้อ 1)\nหนึ่ง\n\nคำถาม: อะไร"
    shown = answers.generate(asked, found, lambda p: "ตาม [2]").where("query_id = 'q'").select(answers.formatted("answer", "citations", "contexts"), answers.formatted_sources("citations", "contexts")).first()
    assert shown[0] == "ตาม [2]\n\nแหล่งอ้างอิง:\n  [2] d.pdf, ข้อ 1" and shown[1] == "[2] d.pdf, ข้อ 1\nหนึ่ง"


def test_retry_policy():
    def failing(statuses):
        todo = iter(statuses)

        def call():
            status = next(todo)
            if status != 200:
                raise answers.CallFailed(*status) if isinstance(status, tuple) else answers.CallFailed(status)
            return "ok"

        return call

    waits = []
    policy = answers.Retry(sleep=waits.append)
    assert policy.call(failing([503, 429, 200])) == "ok" and waits == [2, 4]
    with pytest.raises(answers.CallFailed):
        policy.call(failing([400]))
    assert policy.call(failing([503] * 5), failing([200])) == "ok" and waits[2:] == [2, 4, 8, 16]
    assert policy.call(failing([(429, "PerDay")]), failing([200])) == "ok" and len(waits) == 6


def test_calls_are_cached_and_failures_are_rows(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "fail"), ("c", "y")], "k string, request string")
    cache = spark.createDataFrame([("c", "kept")], "k string, response string")

    def backend(text):
        if text == "fail":
            raise answers.CallFailed(400, "bad")
        return text.upper()

    found, fresh = answers.cached_calls(asked, cache, "k", "request", backend)
    assert sorted(rows(found.select("k", "response"))) == [("a", "X"), ("b", None), ("c", "kept")] and rows(fresh) == [("a", "X")]
    calls = []
    read = enrich.escalating(lambda page, size: (calls.append(size) or f"{page}{size}", size < 16384))
    assert read("p") == "p16384" and calls == [8192, 16384]
    assert enrich.escalating(lambda page, size: (str(size), True))("p") == "32768"


def test_first_hits_and_report(spark):
    results = spark.createDataFrame([("q", 1, "d", "ข้อ 10"), ("q", 2, "d", "ข้อ 10"), ("q", 3, "d", "ข้อ 10"), ("q", 4, "d", "ข้อ 3"), ("n", 1, "d", None)], "query_id string, rank int, doc string, clause string")
    expected = spark.createDataFrame([("q", "d", "ข้อ 3"), ("n", "d", None), ("m", "d", "ข้อ 9")], "query_id string, doc string, clause string")
    assert sorted(rows(evaluation.first_hit(results, expected)), key=str) == [("m", None), ("n", 1), ("q", 2)]
    ranks = spark.createDataFrame([("direct", 1), ("direct", 2), ("multi", None), ("multi", 4), ("unanswerable", 1)], "type string, hit int")
    report = {r["type"]: r for r in evaluation.retrieval_report(ranks, "type").collect()}
    assert (report["all"]["n"], report["all"]["hit1"], report["all"]["hit3"], report["all"]["hit5"], report["all"]["mrr"]) == (4, 1, 2, 3, 0.4375)


def test_judgements(spark):
    given = ['ok {"correctness": 4, "faithfulness": 5, "reason": "r"} end', "none", '{"correctness": 9, "faithfulness": 1}', '{"correctness": "x", "faithfulness": 1}', "{bad}", '{"correctness": 4.7, "faithfulness": "5"}']
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    got = [r[0] and tuple(r[0]) for r in df.orderBy("i").select(evaluation.judgement("t")).collect()]
    assert got == [(4, 5, "r"), None, None, None, None, (4, 5, "")]


def test_answer_metrics(spark):
    pair = "array<struct<doc:string,clause:string>>"
    schema = f"type string, refused boolean, cited {pair}, expected {pair}, correctness int, faithfulness int, errors array<string>"
    data = [
        ("direct", False, [("d", "1"), ("d", None)], [("d", None)], 5, 4, []),
        ("direct", False, [("d", "2")], [("d", "1")], None, 5, ["bad"]),
        ("multi", True, [], [("d", "1")], 1, None, []),
        ("unanswerable", True, [], [], None, None, []),
        ("unanswerable", False, [], [], None, None, []),
    ]
    m = evaluation.answer_metrics(spark.createDataFrame(data, schema)).first()
    assert (m["refusal_accuracy"], m["citation_hit"], m["citation_precision"], m["correctness"], m["faithfulness"]) == (0.6, 0.5, pytest.approx(1 / 3), 3.0, 4.5)
    assert (m["correct_refusals"], m["hallucinated_answers"], m["false_refusals"], m["judge_errors"]) == (1, 1, 1, 1)
    assert evaluation.answer_metrics(spark.createDataFrame([], schema)).first()["refusal_accuracy"] is None
    assert evaluation.failures(spark.createDataFrame(data, schema)).count() == 3


def test_question_checks(spark):
    pair = "array<struct<doc:string,clause:string>>"
    data = [(i, f"q{i}", t, "?", [] if t == "unanswerable" else [("doc.pdf", None)], "a") for i, t in enumerate(evaluation.TYPES * 10)]
    schema = f"line int, id string, type string, question string, expected {pair}, reference_answer string"
    known = spark.createDataFrame([("doc.pdf", "ข้อ 1"), ("doc.pdf", None)], "doc string, clause string")
    assert evaluation.validate_questions(spark.createDataFrame(data, schema), known).count() == 0
    bad = [(100, "q1", "odd", None, [("doc.pdf", "ข้อ 9")], "a"), (101, "z", "unanswerable", "?", [("doc.pdf", None)], "a"), (102, "y", "direct", "?", [], "a")]
    got = {(r["line"], r["rule"]) for r in evaluation.validate_questions(spark.createDataFrame(data + bad, schema), known).collect()}
    assert got == {(100, "repeated id"), (100, "unknown type"), (100, "missing"), (100, "unknown clause"), (101, "expected not empty"), (102, "expected empty")}
    assert {r["detail"] for r in evaluation.validate_questions(spark.createDataFrame(data[:4], schema), known).where("rule = 'too few'").collect()} == {f"{t}=1" for t in evaluation.TYPES}


def test_tables_replace_by_document(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}/t", "doc string, n int")
    assert table.read().count() == 0
    row = lambda *x: spark.createDataFrame(list(x), "doc string, n int")
    table.replace(row(("a", 1), ("b", 2)), "doc")
    table.replace(row(("a", 3)), "doc")
    table.replace(row(("a", 3)), "doc")
    assert sorted(rows(table.read())) == [("a", 3), ("b", 2)]
    table.replace(row(), "doc", row(("b", 0)).select("doc"))
    table.remove("doc", row(("absent", 0)))
    assert rows(table.read()) == [("a", 3)]


def test_json_lines_and_locked_sets(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"id": "1", "question": "x", "type": "direct", "expected": [{"doc": "d", "clause": null}], "reference_answer": "a"}\n\n')
    assert store.read_questions(spark, f"file://{path}").first()["expected"][0]["doc"] == "d"
    with pytest.raises(ValueError):
        store.read_questions(spark, f"file://{path}", locked=f"file://{path}")
    for bad in ('{"id": "1", "extra": 1}', "not json"):
        path.write_text(bad + "\n")
        with pytest.raises(Exception, match="unknown keys|malformed"):
            store.read_questions(spark, f"file://{path}").collect()
    (tmp_path / "x.pdf").write_bytes(b"abc")
    assert store.read_files(spark, f"file://{tmp_path}").first()["sha256"].startswith("ba7816bf")
    with pytest.raises(FileNotFoundError):
        store.read_files(spark, f"file://{tmp_path}", "*.none")


def test_vectors_upsert_and_reindex(spark):
    schema = "id string, doc string, clause string, chapter string, text string, chunk_seq long"
    chunks = spark.createDataFrame([("a", "d", "ข้อ 1", None, "old", 1), ("a", "d", "ข้อ 1", None, "new", 2), ("b", "e", None, None, "x", 1)], schema)
    points = vectors.chunk_vectors(chunks)
    assert sorted(rows(points.select("chunk_id", "text"))) == [("a", "new"), ("b", "x")]
    assert all(abs(sum(x * x for x in r[0]) - 1) < 1e-5 and len(r[0]) == vectors.DIMENSION for r in points.select("embedding").collect())
    assert vectors.upsert(points, points).count() == 2
    left = vectors.reindex(points, chunks.where("doc = 'e'"), spark.createDataFrame([("d",), ("e",)], "doc string"))
    assert rows(left.select("chunk_id")) == [("b",)]


def test_reports(spark, tmp_path):
    ranks = spark.createDataFrame([("vector", "direct", 1), ("vector", "multi", None)], "method string, type string, hit int")
    report = evaluation.retrieval_report(ranks, "method", "type")
    text = evaluation.retrieval_markdown(report)
    assert text.splitlines()[2:] == ["| vector | direct | 1 | 1.000 | 1.000 | 1.000 | 1.000 |", "| vector | multi | 1 | 0.000 | 0.000 | 0.000 | 0.000 |", "| vector | all | 2 | 0.500 | 0.500 | 0.500 | 0.500 |"]
    pair = "array<struct<doc:string,clause:string>>"
    rows_ = spark.createDataFrame([("q", "unanswerable", "?", "made up", False, [], [], None, None, [])], f"query_id string, type string, question string, answer string, refused boolean, cited {pair}, expected {pair}, correctness int, faithfulness int, errors array<string>")
    shown = evaluation.answers_markdown(evaluation.answer_metrics(rows_), evaluation.failures(rows_))
    assert "- correctness: -" in shown and "- q (hallucinated): ?\n  made up" in shown
    evaluation.write_report(report, text, f"file://{tmp_path}", "r1")
    assert spark.read.json(f"file://{tmp_path}/r1.json").count() == 3 and spark.read.text(f"file://{tmp_path}/r1.md").count() == 5


def test_bm25_by_both_paths_and_with_repeated_ids(spark):
    rows = [(i % 97, [f"w{(i * j) % 23}" for j in range(i % 11)]) for i in range(150)] + [(200 + i, ["w1", "w2"]) for i in range(40)] + [(300, None)]
    index = retrieval.Bm25(spark.createDataFrame(rows, "chunk_id long, tokens array<string>").repartition(5))
    asked = spark.createDataFrame([(q, [f"w{(q * j) % 29}" for j in range(6)]) for q in range(12)], "query_id int, tokens array<string>")
    shown = lambda df: {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in df.collect()}
    assert index.n == 191 and index.n_repeated == 53
    got = shown(index.search(asked, 7))
    assert got == shown(index.search(asked, 7, sent=1)) and len(got) > 40


def test_bm25_moves_no_row_of_a_chunks_word(spark):
    docs = spark.createDataFrame([(i, [f"w{j}" for j in range(40)]) for i in range(300)], "chunk_id long, tokens array<string>").repartition(3)
    asked = spark.createDataFrame([(q, ["w1", f"w{q + 2}"]) for q in range(30)], "query_id int, tokens array<string>")
    plan = retrieval.Bm25(docs).search(asked, 3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan.split("Physical Plan")[1]


def test_held_best_are_cut_as_they_grow():
    import numpy as np
    import pyarrow as pa

    held, want = retrieval._Held(2, 10), {}
    for at in range(0, 60, 3):
        scores = np.round(np.sin(np.arange(at * 4, at * 4 + 12).reshape(4, 3)), 1)
        held.add(retrieval._k_best(scores, 2), scores, pa.array([0, 1, 2, None]), pa.chunked_array([[at, at + 1, at + 2]]))
        for q, c in np.ndindex(scores.shape):
            want.setdefault((0, 1, 2, None)[q], []).append((-scores[q, c], at + c))
    got = {}
    for batch in held.rest():
        for r in batch.to_pylist():
            got.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
    assert got == {q: sorted(x)[:2] for q, x in want.items()} and held.n <= held.most == 16


def test_texts_of_chunks_that_no_hit_names_do_not_travel(spark):
    chunks = spark.createDataFrame([(str(i), "d", "c", "h", "t" * 50) for i in range(400)], "chunk_id string, doc string, clause string, chapter string, text string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = answers.contexts(spark.createDataFrame([("q", "7", 1), ("q", "5", 2)], "query_id string, chunk_id string, rank int"), chunks)
        assert [c["chunk_id"] for c in found.first()["contexts"]] == ["7", "5"]
        assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _clauses(spark):
    """Chunks of several clauses and documents, null ones too, and queries that name some."""
    chunks = [(f"c{i % 140}", f"d{i * 7 % 11}" if i % 13 else None, f"ข้อ {i * i % 9}/{i % 3}" if i % 17 else None, i * 31 % 211) for i in range(200)]
    found = [(q, f"c{(q * 37 + r * r) % 140}", r) for q in range(14) for r in range(1, 9)]
    refs = [(q, f"ข้อ {(q + j) % 10}") for q in range(12) for j in range(q % 4)] + [(1, None)]
    make = spark.createDataFrame
    return make(refs, "query_id int, ref string"), make(found, "query_id int, chunk_id string, rank int").dropDuplicates(["query_id", "chunk_id"]), make(chunks, "chunk_id string, doc string, clause string, chunk_seq long")


@pytest.mark.parametrize("sent", [10_000, 0])
def test_clause_ranking_by_its_definition(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieval, "ROWS_A_TASK", 50)
    monkeypatch.setattr(retrieval, "SENT_ASKED", sent)
    refs, found, chunks = _clauses(spark)
    of_chunk, docs = {}, {}
    for c in chunks.collect():
        docs.setdefault(c.chunk_id, set()).add(c.doc)
        if c.clause:
            of_chunk.setdefault(c.chunk_id, []).append((c.chunk_seq, c.doc, c.clause.split("/")[0]))
    want = {}
    for q in range(14):
        named, before = {r.ref for r in refs.collect() if r.query_id == q and r.ref}, {r.chunk_id: r["rank"] for r in found.collect() if r.query_id == q}
        affinity = {}
        for c, r in before.items():
            for d in docs.get(c, set()) - {None}:
                affinity[d] = affinity.get(d, 0) + 1 / (60 + r)
        rows = [(min(x for x in of if x[2] in named), c) for c, of in of_chunk.items() if any(x[2] in named for x in of)]
        placed = sorted((-round(affinity.get(d, 0), 12), before.get(c, 10**9), seq, c) for (seq, d, _), c in rows)
        want |= {(q, c): n for n, (*_, c) in enumerate(placed, 1)}
    found_at = {(r.query_id, r.chunk_id): r["rank"] for r in retrieval.clause_ranking(refs, found, chunks).collect()}
    assert found_at == want and len(want) == 295


def test_hybrid_fuses_only_named_chunks_that_can_be_among_the_best(spark, monkeypatch):
    refs, found, chunks = _clauses(spark)
    seen, fuse = [], retrieval.fuse
    monkeypatch.setattr(retrieval, "fuse", lambda rankings, *a: (seen.append(rankings), fuse(rankings, *a))[1])
    got = rows(retrieval.hybrid(found, None, refs, chunks, 4).orderBy("query_id", "rank"))
    every = found.withColumn("ranking_no", F.lit(0)).unionByName(retrieval.clause_ranking(refs, found, chunks).withColumn("ranking_no", F.lit(2)))
    assert got == rows(fuse(every, {0: 1.0, 2: 1.0}).where("rank <= 4").orderBy("query_id", "rank"))
    assert seen[-1].count() <= found.count() * 2 + 4 * 14 < every.count()


def test_scores_at_once_are_bounded():
    import numpy as np
    import pyarrow as pa

    vectors = pa.table({"chunk_id": list(range(12_000)), "embedding": [[float(i % 7), 1.0] for i in range(12_000)]})
    asked = retrieval._units(pa.chunked_array([[[1.0, float(i % 5)] for i in range(300)]]))
    sizes = [scores.size for _, scores, *_ in retrieval._cosines(3, vectors, pa.array(np.arange(300)), asked)]
    assert sum(sizes) == 12_000 * 300 and max(sizes) <= retrieval.SCORES_AT_ONCE


def test_the_best_of_a_few_queries_are_cut_back_together(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    vectors, wanted = rng.standard_normal((900, 4)), rng.standard_normal((250, 4))
    batches = [pa.RecordBatch.from_pydict({"chunk_id": list(range(i, i + 100)), "embedding": vectors[i : i + 100].tolist()}) for i in range(0, 900, 100)]
    sizes, cut = [], retrieval._Held._cut
    monkeypatch.setattr(retrieval._Held, "_cut", lambda self: sizes.append(self.n) or cut(self))
    monkeypatch.setattr(retrieval, "QUERIES_HELD", 20)
    found = pa.Table.from_batches(retrieval._best_of_all(3, pa.table({"query_id": list(range(250)), "wanted": wanted.tolist()}))(batches))
    cosines = wanted @ vectors.T / np.linalg.norm(vectors, axis=1)
    got = sorted(zip(found["query_id"].to_pylist(), found["chunk_id"].to_pylist(), strict=True))
    assert got == sorted((q, int(c)) for q in range(250) for c in np.argsort(-cosines[q])[:3])
    assert max(sizes) <= 2 * 3 * 20 + 3 * 20

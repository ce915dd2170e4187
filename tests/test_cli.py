import pytest

from clauselake import cli

GOOD = "นักศึกษาต้องลงทะเบียนเรียนตามระเบียบของมหาวิทยาลัย"


@pytest.fixture
def pages(spark, tmp_path):
    rows = [("a.pdf", 1, f"คำนำ\nข้อ 1 {GOOD}\nข้อ 2 การสอบ {GOOD}"), ("a.pdf", 2, "bad"), ("b.pdf", 1, "scan"), ("c.pdf", 1, f"ข้อ 9 {GOOD}")]
    path = f"file://{tmp_path}/pages"
    spark.createDataFrame(rows, "doc string, page_number int, text string").write.parquet(path)
    return path


@pytest.mark.parametrize("line", ["check p", "ingest p --only a.pdf --force-ocr", "ingest d --files *.pdf", "index --only a.pdf", "remove a.pdf --delete-pdf d", "search q -k 3", "ask q", "chat", "eval retrieval --questions q --limit 3"])
def test_parser_reads_all_commands(line):
    assert cli.parser().parse_args(line.split()).command == line.split()[0]


def test_ingest_index_search_ask_eval_remove(spark, pages, tmp_path, capsys):
    def read(page):
        if "/1" in page[-2:]:
            raise RuntimeError("unreadable")
        return "ข้อ 3 จากภาพ " + GOOD

    backends = cli.Backends(read_page=read, answer=lambda p: "ตามข้อ [1]", judge=lambda p: '{"correctness": 5, "faithfulness": 4}')
    import clauselake.operators.enrich as enrich
    from clauselake.operators.answers import Retry

    patch = pytest.MonkeyPatch()
    patch.setattr(enrich, "Retry", lambda **k: Retry(sleep=lambda s: None, **k))
    folder = f"file://{tmp_path}/store"
    run = lambda *args: cli.main(["--store", folder, *args], backends)
    assert run("check", pages) == 0 and run("ingest", pages) == 1  # one page failed
    tables = cli.Store(spark, folder, backends)
    records = {r["doc"]: r for r in tables.registry.read().collect()}
    assert records["a.pdf"]["ocr_pages"] == [2] and records["b.pdf"]["failed_pages"] == [1] and records["c.pdf"]["chunks"] == 1
    assert [r["clause"] for r in tables.chunks.read().where("doc = 'a.pdf'").orderBy("chunk_seq").collect()] == [None, "ข้อ 1", "ข้อ 2", "ข้อ 3"]
    assert tables.ocr_cache.read().count() == 1
    assert run("index") == 0 and run("index", "--only", "c.pdf") == 0
    n = tables.vectors.read().count()
    assert n == tables.chunks.read().select("id").distinct().count()
    assert run("search", "ข้อ 2 การสอบ", "-k", "2") == 0 and run("ask", "ข้อ 2") == 0
    assert "แหล่งอ้างอิง" in capsys.readouterr().out
    asked = tmp_path / "q.jsonl"
    asked.write_text('{"id": "1", "question": "ข้อ 2 การสอบ", "type": "direct", "expected": [{"doc": "a.pdf", "clause": "ข้อ 2"}], "reference_answer": "x"}\n{"id": "2", "question": "z", "type": "unanswerable", "expected": [], "reference_answer": ""}\n')
    assert run("eval", "retrieval", "--questions", f"file://{asked}") == 0 and run("eval", "answers", "--questions", f"file://{asked}") == 0
    assert '"hallucinated_answers": 1' in capsys.readouterr().out and tables.llm_cache.read().count() == 3  # two answers, one judgement
    assert run("eval", "answers", "--questions", f"file://{asked}", "--locked", f"file://{asked}") == 1
    assert run("remove", "a.pdf", "none.pdf") == 0 and tables.chunks.read().where("doc = 'a.pdf'").count() == 0
    assert run("check", f"file://{tmp_path}/absent") == 1
    patch.undo()


def test_chat_lines():
    said = []
    cli.chat(lambda q: {"answer": f"answer to {q}", "sources": "s"}, ["/sources", "", "q ", "/sources", "/help", "/exit", "never"], said.append)
    assert said == ["(คำตอบล่าสุดไม่ได้อ้างอิงเอกสาร)", "answer to q", "s", "/sources  /exit"]


def test_files_are_read_by_an_extractor_and_broken_ones_are_listed(spark, tmp_path, capsys):
    folder = tmp_path / "files"
    folder.mkdir()
    for k in range(3):
        (folder / f"d{k}.txt").write_text(f"ข้อ 1 {GOOD}\fข้อ 2 {GOOD}{k}" if k else "broken")

    def extract(data):
        if data == b"broken":
            raise ValueError("no pages in it")
        return data.decode().split("\f")

    seen = []
    backends = cli.Backends(extract=extract, progress=lambda stage, done, total: seen.append(stage))
    run = lambda *args: cli.main(["--store", f"file://{tmp_path}/store", *args], backends)
    assert run("check", f"file://{folder}", "--files", "*.txt") == 1 and "d0.txt: ValueError" in capsys.readouterr().err
    assert run("ingest", f"file://{folder}", "--files", "*.txt") == 1 and {"extract", "gate", "ocr", "chunk", "store"} <= set(seen)
    tables = cli.Store(spark, f"file://{tmp_path}/store", backends)
    assert {r["doc"]: r["chunks"] for r in tables.registry.read().collect()} == {"d1.txt": 2, "d2.txt": 2}
    assert {r["doc"] for r in tables.markdown.read().collect()} == {"d1.txt", "d2.txt"} and tables.markdown.read().first()["markdown"].startswith("# d")
    assert run("remove", "d1.txt", "--delete-pdf", f"file://{folder}") == 0 and not (folder / "d1.txt").exists() and (folder / "d2.txt").exists()
    assert tables.markdown.read().count() == 1 and run("remove", "../x", "--delete-pdf", f"file://{folder}") == 1


def test_each_question_is_answered_and_judged_once(spark, pages, tmp_path):
    from clauselake.operators.backends import Model

    calls = tmp_path / "calls"
    calls.mkdir()

    def call(what, answer):
        def made(prompt, system):
            import uuid

            (calls / f"{what}-{uuid.uuid4().hex}").write_text(system)
            if what == "down":
                from clauselake.operators.answers import CallFailed

                raise CallFailed(429, "PerDay")
            return answer

        return made

    answer = Model(call("down", ""), "main", fallback=call("answer", "ตามข้อ [1]"))
    backends = cli.Backends(read_page=lambda p: GOOD, answer=answer, judge=Model(call("judge", '{"correctness": 5, "faithfulness": 4}')))
    tables = cli.Store(spark, f"file://{tmp_path}/store", backends)
    tables.ingest(spark.read.parquet(pages))
    tables.index()
    asked = spark.createDataFrame([("1", "ข้อ 2 การสอบ", "direct", [("a.pdf", "ข้อ 2")], "x")], cli.store.QUESTIONS)
    n = lambda what: len(list(calls.glob(f"{what}-*")))
    for _ in range(2):
        judged = tables.eval_answers(asked)
        assert cli.evaluation.answer_metrics(judged).first()["correctness"] == 5.0 and cli.evaluation.answer_metrics(judged, "type").count() == 1
        assert (n("down"), n("answer"), n("judge")) == (1, 1, 1)
    assert all("[1]" in f.read_text() for f in calls.glob("answer-*")) and all("JSON" in f.read_text() for f in calls.glob("judge-*"))


def test_a_reindex_embeds_each_chunk_once(spark, tmp_path):
    import numpy as np

    from clauselake.operators import vectors

    def model():
        def embed(texts):
            for t in texts:
                (tmp_path / f"{len(list(tmp_path.iterdir()))}-{abs(hash(t))}").write_text("")
            return np.ones((len(texts), 4))

        return embed

    chunks = spark.createDataFrame([("c1", "d", None, None, "t", 0)], cli.store.CHUNKS)
    old = spark.createDataFrame([], cli.store.VECTORS)
    assert vectors.reindex(old, chunks, chunks.select("doc"), model).count() == 1
    assert len(list(tmp_path.iterdir())) == 1


def test_failed_calls_are_reported_and_end_the_command_with_an_error(spark, pages, tmp_path, capsys):
    from clauselake.operators.answers import CallFailed

    def down(prompt):
        raise CallFailed(401, "no key")

    folder, asked = f"file://{tmp_path}/store", tmp_path / "q.jsonl"
    asked.write_text('{"id": "1", "question": "ข้อ 2 การสอบ", "type": "direct", "expected": [{"doc": "a.pdf", "clause": "ข้อ 2"}], "reference_answer": "x"}\n{"id": "2", "question": "z", "type": "unanswerable", "expected": [], "reference_answer": ""}\n')
    working = cli.Backends(read_page=lambda p: GOOD, answer=lambda p: "ตามข้อ [1]", judge=lambda p: '{"correctness": 5, "faithfulness": 4}')
    tables = cli.Store(spark, folder, working)
    tables.ingest(spark.read.parquet(pages))
    tables.index()
    run = lambda **b: cli.main(["--store", folder, "eval", "answers", "--questions", f"file://{asked}"], cli.Backends(read_page=lambda p: GOOD, **b))
    assert run(answer=down, judge=down) == 1
    told = capsys.readouterr()
    assert "2 questions were not answered" in told.err and '"refusal_accuracy": null' in told.out and '"judge_errors": 2' in told.out
    (report,) = (tmp_path / "store" / "reports").glob("*.md")
    text = "".join(p.read_text() for p in report.iterdir() if p.name.startswith("part"))
    assert text.count("call_failed") == 2 and "errors: answer: 401 no key" in text and "expected: a.pdf ข้อ 2" in text
    assert tables.llm_cache.read().count() == 0  # failures are not kept
    # The judge alone fails; then all works, and what was answered is not asked again.
    rows = cli.Store(spark, folder, cli.Backends(answer=lambda p: "ตามข้อ [1]", judge=down)).eval_answers(cli.store.read_questions(spark, f"file://{asked}")).collect()
    assert {tuple(r.errors) for r in rows} == {("judge: 401 no key",), ()} and tables.llm_cache.read().count() == 2
    rows = cli.Store(spark, folder, cli.Backends(answer=down, judge=working.judge)).eval_answers(cli.store.read_questions(spark, f"file://{asked}")).collect()
    assert all(r.errors == [] for r in rows) and {r.correctness for r in rows} == {5, None}


def test_a_broken_run_keeps_what_was_called(spark, tmp_path):
    """A run that ends in the middle: what its portions were given is not called for again."""
    from clauselake.operators import answers

    calls = tmp_path / "calls"
    calls.mkdir()

    def backend(text):
        import uuid

        (calls / uuid.uuid4().hex).write_text(text)
        return f"<{text}>"

    cache = cli.store.Table(spark, f"file://{tmp_path}/cache", cli.store.OCR_CACHE, "key")
    asked = spark.createDataFrame([(f"k{i}", f"r{i}") for i in range(60)], "key string, request string")
    seen = []

    def stop(done, total):
        seen.append((done, total))
        if len(seen) == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        answers.kept_calls(asked, cache, "key", "request", backend, at_once=10, progress=stop)
    made = len(list(calls.iterdir()))
    assert seen[0][1] == 60 and made == seen[2][0] == cache.read().count() < 60 and seen == sorted(seen)
    found = answers.kept_calls(asked, cache, "key", "request", backend, at_once=10).collect()
    assert sorted(r.response for r in found) == sorted(f"<r{i}>" for i in range(60)) and len(list(calls.iterdir())) == 60
    answers.kept_calls(asked, cache, "key", "request", backend, at_once=100, again=True)
    assert len(list(calls.iterdir())) == 120 and cache.read().count() == 60


def test_missing_settings_are_named_before_any_work(spark, tmp_path, capsys):
    from clauselake.operators.backends import MODELS, Model, Reader

    MODELS.add("hosted", Model(lambda p, s: "x", needs=("HOST", "KEY")))
    run = lambda settings, *line: cli.main(["--store", f"file://{tmp_path}/none", *line], cli.Backends(answer="hosted", judge=Model(lambda p, s: "", needs=("KEY", "JUDGE")), read_page=Reader(lambda p, n: ("", False), needs=("OCR",)), settings=settings))
    for settings, line, missing in (({}, ["ask", "q"], "HOST, KEY"), ({"HOST": "h", "KEY": ""}, ["chat"], "KEY"), ({"HOST": "h"}, ["eval", "answers", "--questions", "q"], "KEY, JUDGE"), ({}, ["ingest", "p"], "OCR")):
        assert run(settings, *line) == 1 and f"missing settings: {missing}\n" in capsys.readouterr().err
    MODELS.known.pop("hosted")
    with pytest.raises(KeyError, match="no model named 'hosted'"):
        cli.checked(cli.Backends(), "hosted")


def test_embeddings_of_another_length_are_an_error(spark, tmp_path):
    from clauselake.operators import vectors

    tables = cli.Store(spark, f"file://{tmp_path}/store", cli.Backends(make_embedder=lambda: vectors.hashed_ngrams(16)))
    tables.chunks.replace(spark.createDataFrame([(f"c{k}", f"d{k}", None, None, f"text {k}", k) for k in range(4)], cli.store.CHUNKS), "doc")
    assert tables.index() == 4
    tables.backends.make_embedder = lambda: vectors.hashed_ngrams(32)
    asked = spark.createDataFrame([("q", "text 1")], "query_id string, question string")
    with pytest.raises(ValueError, match="32 numbers, those of the collection 16; index"):
        tables.index(["d1"])
    with pytest.raises(ValueError, match="ask with the model"):
        tables.retrieve(asked, "vector")
    assert vectors.dimension(tables.vectors.read()) == 16 and tables.index() == 4 and vectors.dimension(tables.vectors.read()) == 32
    assert tables.retrieve(asked, "vector").count() == 4
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>")
    with pytest.raises(ValueError, match="1 to 2 numbers"):
        vectors.dimension(mixed)
    assert vectors.dimension(mixed.limit(0)) is None

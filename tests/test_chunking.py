import random

from clauselake.operators import chunking
from clauselake.streaming.incremental import follow_pages
from clauselake.sources.store import CHUNKS, Table


def chunks(spark, *texts, **limits):
    docs = spark.createDataFrame([(f"d{i}.pdf", t) for i, t in enumerate(texts)], "doc string, text string")
    return [r.asDict() for r in chunking.chunk_documents(docs, **limits).orderBy("doc", "chunk_seq").collect()]


def test_clauses_chapters_and_preamble(spark):
    text = "คำนำของระเบียบ\nหมวด 1 บททั่วไป\nข้อ 1 หนึ่ง\nข้อ 5/1 แทรก\nหมวด 2 การเรียน\nข้อ 6 หก"
    got = chunks(spark, text)
    assert [(c["id"], c["clause"], c["chapter"]) for c in got] == [
        ("d0_เกริ่นนำ", None, None),
        ("d0_ข_อ_1", "ข้อ 1", "หมวด 1 บททั่วไป"),
        (got[2]["id"], "ข้อ 5/1", "หมวด 1 บททั่วไป"),
        (got[3]["id"], "ข้อ 6", "หมวด 2 การเรียน"),
    ]
    assert got[2]["id"] == "d0_ข_อ_5_1" and got[2]["text"] == "ข้อ 5/1 แทรก\nหมวด 2 การเรียน"


def test_smaller_numbers_are_references_back(spark):
    got = chunks(spark, "ข้อ 14 ก\nข้อ 15 ตาม\nข้อ 3 วรรคสอง\nข้อ 16 ข")
    assert [c["clause"] for c in got] == ["ข้อ 14", "ข้อ 15", "ข้อ 16"] and "ข้อ 3" in got[1]["text"]


def test_long_clauses_and_plain_text_are_cut_with_overlap(spark):
    body = "ข้อ 1 " + "ก" * 1700
    got = chunks(spark, body, "x" * 2500, "", None)
    assert [c["id"] for c in got] == ["d0_ข_อ_1_1", "d0_ข_อ_1_2", "d1_chunk1", "d1_chunk2", "d1_chunk3", "d2_chunk1", "d3_chunk1"]
    assert got[0]["text"][-200:] == got[1]["text"][:200] and [c["text"] for c in got[5:]] == ["", ""]


def test_split_equals_a_loop(spark):
    def loop(text, most, overlap):
        if len(text) <= most:
            return [text]
        parts, at = [], 0
        while True:
            parts.append(text[at : at + most])
            if at + most >= len(text):
                return parts
            at += most - overlap

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab😀") for _ in range(n)) for n in [0, 1, 9, 10, 11, 17, 18, 19, *(rng.randint(0, 200) for _ in range(60))]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(chunking.split_overlapping("t", 10, 3)).collect()]
    assert got == [loop(t, 10, 3) for t in texts]


def test_headings_equal_a_search(spark):
    import re

    clause = re.compile(r"^\s*(ข้อ|มาตรา)\s+(\d+(?:/\d+)?)\s*", re.MULTILINE)
    rng = random.Random(2)
    parts = ["ข้อ 1", "ข้อ ๒", "มาตรา 3/1", "หมวด 1", "\n", "\n  ", " ", "x", "\r", " ", "ข้อ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(300)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, text string")
    got = {(r["doc"], r["pos"], r["g1"], r["g2"]) for r in chunking.headings(df, chunking.CLAUSE, 2).collect()}
    assert got == {(str(i), m.start(), m.group(1), m.group(2)) for i, t in enumerate(texts) for m in clause.finditer(t)}


def test_pages_in_order_and_failed_pages_empty(spark):
    pages = spark.createDataFrame([("d", 2, "b", False), ("d", 1, "bad", True), ("d", 10, "c", True), ("e", 1, None, False)], "doc string, page_number int, text string, needs_ocr boolean")
    read = spark.createDataFrame([("d", 1, "A")], "doc string, page_number int, text string")
    got = {r["doc"]: r["text"] for r in chunking.join_pages(chunking.page_texts(pages, read)).collect()}
    assert got == {"d": "A\n\nb\n\n", "e": ""}


def test_markdown_and_short_chunks(spark):
    docs = spark.createDataFrame([("d.pdf", "นำ\nข้อ 1 ก")], "doc string, text string")
    found = chunking.chunk_documents(docs)
    assert chunking.markdown(found).first()["markdown"] == "# d.pdf\n\n## เกริ่นนำ  (d_เกริ่นนำ)\n\nนำ\n\n## ข้อ 1  (d_ข_อ_1)\n\nข้อ 1 ก\n"
    assert chunking.short_chunks(found).count() == 2


def test_pages_that_arrive_again_replace_their_chunks(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/chunks", CHUNKS)
    schema = "doc string, page_number int, text string, needs_ocr boolean"
    for text in ("ข้อ 1 เก่า", "ข้อ 1 ใหม่"):
        spark.createDataFrame([("d.pdf", 1, text, False)], schema).write.mode("append").parquet(f"{tmp_path}/pages")
        follow_pages(spark, f"{tmp_path}/pages", table, f"{tmp_path}/checkpoint").awaitTermination()
    assert [r["text"] for r in table.read().collect()] == ["ข้อ 1 ใหม่"]


def test_scans_of_one_key_in_many_parts(spark):
    """One key with all rows, one with few, none and null: as window functions over whole keys give it."""
    import random

    rng = random.Random(2)
    rows = [("hot", i, rng.randrange(i // 3 + 5), rng.choice(["a", "b", None, None])) for i in range(3000)]
    rows += [("cold", i, rng.randrange(9), rng.choice(["c", None])) for i in range(20)] + [(None, i, rng.randrange(9), "d" if i % 5 == 1 else None) for i in range(20)] + [("one", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, at int, n int, l string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = chunking._in_parts(df, "k", "at").where("k = 'hot'").select("__part").distinct().count()
        assert parts > 2  # many tasks have the key's rows
        show = lambda x: sorted(map(str, x.collect()))
        assert show(chunking.accept_rising(df, "k", "at", "n")) == show(chunking.rising_in_key(df, "k", "at", "n"))
        labels, events = df.where("l is not null").select("k", "at", df["l"].alias("label")), df.where("l is null").select("k", "at", "n")
        assert show(chunking.label_as_of(events, labels, "k", "at").select("k", "at", "n", "label")) == show(chunking.label_in_key(events, labels, "k", "at").select("k", "at", "n", "label"))
        assert chunking.accept_rising(df.where("false"), "k", "at", "n").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chunks_equal_a_loop_over_the_text(spark):
    import re

    clause = re.compile(r"^\s*(ข้อ|มาตรา)\s+(\d+(?:/\d+)?)\s*", re.MULTILINE)
    chapter = re.compile(r"^\s*(หมวด|ส่วนที่)\s+(\d+)\s*(.*)$", re.MULTILINE)

    def cut(text, most, overlap):
        return [text[at : at + most] for at in range(0, max(1, len(text) - overlap), most - overlap)]

    def loop(text):
        text, largest, heads = text or "", None, []
        for m in clause.finditer(text):
            number = int(m[2].split("/")[0])
            if largest is None or number >= largest:
                largest = number
                heads.append((m.start(), f"{m[1]} {m[2]}"))
        if not heads:
            return [(None, None, t) for t in cut(text, 11, 3)]

        def as_of(at):
            found = [" ".join(x for x in (m[1], m[2], m[3].strip()) if x or x == m[3].strip()).strip() for m in chapter.finditer(text) if m.start() <= at]
            return found[-1] if found else None

        out = []
        preamble = chapter.sub("", text[: heads[0][0]]).strip()
        if preamble:
            out += [(None, as_of(0), t) for t in cut(preamble, 13, 4)]
        for (at, name), (end, _) in zip(heads, [*heads[1:], (len(text), None)], strict=True):
            out += [(name, as_of(at), t) for t in cut(text[at:end].strip(), 13, 4)]
        return out

    rng = random.Random(11)
    parts = ["ข้อ 1", "ข้อ 2", "ข้อ 12", "มาตรา 3/1", "หมวด 1", "หมวด 2 ก", "ส่วนที่ 4", "\n", "\n", "\n\n  ", " ", "x", "คำนำ 😀"]
    texts = [None, "", "\n", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(400))]
    long = "\n".join(f"ข้อ {n // 3 + 1}\nหมวด {n} ก" if n % 5 == 0 else f"ข้อ {n // 3 + 1} คำ" for n in range(3000))
    texts.append(long)
    got: dict[str, list] = {}
    for c in chunks(spark, *texts, max_chars=13, overlap=4, fallback_chars=11, fallback_overlap=3):
        got.setdefault(c["doc"], []).append((c["clause"], c["chapter"], c["text"]))
        assert c["chunk_seq"] == len(got[c["doc"]])
    for i, text in enumerate(texts):
        assert got.get(f"d{i}.pdf", []) == loop(text), text
    assert got[f"d{len(texts) - 1}.pdf"][-1][0] == "ข้อ 1000"


def test_no_documents_no_chunks(spark):
    assert chunks(spark) == []


def test_documents_go_to_as_many_tasks_as_they_fill(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"x\nข้อ {i % 4} a\nหมวด 1 b\nข้อ {i % 3} c\nข้อ 9 d" if i % 9 else None) for i in range(100)], "doc string, text string")
    want = [tuple(r) for r in chunking.chunk_documents(docs).collect()]
    monkeypatch.setattr(chunking, "CHARS_A_TASK", 1000)
    found = chunking.chunk_documents(docs)
    plan = found._jdf.queryExecution().toString()
    assert sorted(tuple(map(str, r)) for r in found.collect()) == sorted(tuple(map(str, r)) for r in want)
    assert "REPARTITION_BY_NUM" in plan and ", 20)" in plan and plan.split("Physical Plan")[1].count("Exchange") == 1
    assert chunking.chunk_documents(docs.limit(0)).count() == 0

"""Segmentation against every way through the lattice."""

import random

from pyspark.sql.functions import spark_partition_id

from clauselake.operators import segment
from clauselake.operators.retrieval import Bm25


def every_way(text, words):
    """All ways to cut a text into dictionary words and letters left over, the least by the stated order."""
    opens = segment.clusters(text)

    def ways(at):
        if at == len(text):
            yield []
            return
        for end in range(at + 1, len(text) + 1):
            if opens[end] and text[at:end] in words:
                for rest in ways(end):
                    yield [(text[at:end], True), *rest]
        step = next(k for k in range(at + 1, len(text) + 1) if opens[k])
        for rest in ways(step):
            yield [(text[at:step], False), *rest]

    def joined(way):
        out = []
        for part, known in way:
            if not known and out and not out[-1][1]:
                out[-1] = (out[-1][0] + part, False)
            else:
                out.append((part, known))
        return out

    def order(way):
        parts = joined(way)
        return sum(len(p) for p, known in parts if not known), len(parts), [-len(p) if known else -1 for p, known in way]

    return [p for p, _ in joined(min(ways(0), key=order))]


def dictionary(seed, n, letters):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(n)}


def test_least_path_equals_every_way():
    rng = random.Random(1)
    for seed in range(60):
        letters = rng.choice(["ab", "abc", "กขค้", "กะิข"])
        words = dictionary(seed, 8, letters)
        trie = segment.Trie(words)
        for _ in range(20):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 10)))
            assert segment.least_path(text, lambda k, t=text, x=trie: x.ends(t, k)) == every_way(text, words), (text, words)


def test_trie_finds_all_words_that_start_at_a_place():
    words = dictionary(3, 3000, "abcdefgh")
    trie, text = segment.Trie([*words, "", "a", "a"]), "abcdefghhgfedcba" * 5
    words.add("a")
    for k in range(len(text)):
        assert list(trie.ends(text, k)) == [e for e in range(k + 1, len(text) + 1) if text[k:e] in words]
    assert list(segment.Trie([]).ends("abc", 0)) == []


def test_column_and_join_agree(spark):
    """A dictionary that goes to all tasks and one that is joined; nulls, empty and very long texts, marks, other scripts, repeated rows."""
    words = spark.createDataFrame([("นักศึกษา",), ("นัก",), ("ศึกษา",), ("สอบ",), ("ปลายภาค",), ("การ",), ("สอบ",), (None,), ("",)], "word string")
    texts = [(1, "นักศึกษาสอบปลายภาค"), (2, "การสอบ GPA 3.50 ของนักศึกษา"), (3, None), (4, ""), (5, "สอบXYZสอบ"), (None, "สอบ"), (None, "สอบ"), (6, "ฃฃฃสอบฃ"), (7, "การสอบ" * 3000), (8, "ด้านการศึกษา"), (8, "plain words, ÉTÉ")]
    df = spark.createDataFrame(texts, "k int, t string")
    one = segment.segmented(df, words, "k", "t").collect()
    many = segment.segmented(df, words, "k", "t", most=3).collect()
    show = lambda rows: sorted((str(r.k), r.tokens) for r in rows)
    assert show(one) == show(many)
    found = {(r.k, len(r.tokens)): r.tokens for r in one}
    assert found[1, 3] == ["นักศึกษา", "สอบ", "ปลายภาค"]
    assert found[2, 7] == ["การ", "สอบ", "gpa", "3", "50", "ของ", "นักศึกษา"]
    assert found[3, 0] == found[4, 0] == []
    assert found[5, 3] == ["สอบ", "xyz", "สอบ"] and found[6, 3] == ["ฃฃฃ", "สอบ", "ฃ"]
    assert found[7, 6000][:2] == ["การ", "สอบ"]
    assert len([r for r in one if r.k is None]) == 2


def test_without_a_dictionary_a_run_is_a_word(spark):
    words = spark.createDataFrame([], "word string")
    df = spark.createDataFrame([(1, "นักศึกษา ab")], "k int, t string")
    assert segment.segmented(df, words, "k", "t").first().tokens == ["นักศึกษา", "ab"]


def test_search_by_segmented_words(spark):
    words = spark.createDataFrame([("นักศึกษา",), ("สอบ",), ("ลา",), ("พัก",)], "word string")
    cut = segment.segmenter(words)
    texts = [("a", "นักศึกษาสอบ"), ("b", "นักศึกษาลาพัก"), ("c", "ลาพักสอบสอบ"), ("d", "นักศึกษา"), ("e", "สอบนักศึกษา"), ("f", "สอบ")]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").select("chunk_id", cut("text").alias("tokens"))
    asked = spark.createDataFrame([(1, "ลาพัก")], "query_id int, text string").select("query_id", cut("text").alias("tokens"))
    assert {r.chunk_id for r in Bm25(chunks).search(asked).collect()} == {"b", "c"}


def test_store_searches_by_its_dictionary(spark, tmp_path):
    from clauselake import cli

    tables = cli.Store(spark, f"file://{tmp_path}/store", cli.Backends(bm25_weight=0.5))
    made = [(f"c{k}", "d.pdf", f"ข้อ {k}", None, t, k) for k, t in enumerate(["นักศึกษาสอบปลายภาค", "ลาพักการศึกษา", "ค่าธรรมเนียม", "การลงทะเบียน", "วินัยนักศึกษา"])]
    tables.chunks.replace(spark.createDataFrame(made, cli.store.CHUNKS), "doc")
    tables.index()
    asked = spark.createDataFrame([("q", "ขอลาพัก")], "query_id string, question string")
    assert tables.retrieve(asked, "keyword").count() == 0  # the whole phrase is one word
    assert tables.learn(spark.createDataFrame([("ลา",), ("พัก",), ("ขอ",), ("การ",), ("ศึกษา",), ("นักศึกษา",), ("สอบ",), ("ปลายภาค",), (None,)], "word string")) == 8
    assert [r.chunk_id for r in tables.retrieve(asked, "keyword").collect()] == ["c1"]
    hybrid = {r.chunk_id: r.score for r in tables.retrieve(asked).collect()}
    tables.backends.bm25_weight = 0.0
    without = {r.chunk_id: r.score for r in tables.retrieve(asked).collect()}
    assert abs(hybrid["c1"] - without["c1"] - 0.5 / 61) < 1e-9


def test_query_equals_plain_least_path(spark):
    """All documents of the given table, by a search over positions from the front."""
    import hashlib
    import re

    import duckdb

    from clauselake.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    known = {w for (t,) in duckdb.sql(f"select text from '{folder}/benchmark.parquet'").fetchall() for w in re.findall(r"[^\W_]+", t.lower())}

    def cut(run):
        """Least (left over, words, sizes from the front), kept for each position and whether a letter was left over before it."""
        best = {(0, False): (0, 0, [], [])}
        for at in range(len(run)):
            for rest in (False, True):
                if (at, rest) not in best:
                    continue
                left, n, sizes, out = best[at, rest]
                ways = [(end, False, left, n + 1, [*sizes, at - end], [*out, run[at:end]]) for end in range(at + 1, min(len(run), at + 64) + 1) if run[at:end] in known]
                ways.append((at + 1, True, left + 1, n + (not rest), [*sizes, -1], [*out[:-1], out[-1] + run[at]] if rest else [*out, run[at]]))
                for end, after, *way in ways:
                    if (end, after) not in best or tuple(way[:3]) < best[end, after][:3]:
                        best[end, after] = tuple(way)
        return min((best[k] for k in ((len(run), False), (len(run), True)) if k in best), key=lambda b: b[:3])[3]

    want = {}
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet' where length(text) < 3000").fetchall():
        words = []
        for run in re.findall(r"[^\W_]+", (text or "").replace(" ", "").lower()):
            for piece in re.findall(r"[a-zà-ÿ]+|[^a-zà-ÿ]+", run):
                words += cut(piece) if re.match("[a-zà-ÿ]", piece) else [piece]
        want[doc_id] = (len(words), hashlib.sha256(" ".join(words).encode()).hexdigest())
    got = {r.doc_id: (r.n, r.words) for r in QUERIES["segment_words"](spark, folder).collect()}
    assert len(want) > 50 and {k: got[k] for k in want} == want


def test_words_of_a_batch_are_never_there_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(segment, "LETTERS_AT_ONCE", 100)
    runs = [[f"{'ab' * (i % 7)}x{i}", "ab"] for i in range(90)] + [None, []]
    batch = pa.record_batch({"k": list(range(92)), "tokens": pa.array(runs, pa.list_(pa.string()))})
    trie, parts = segment.Trie(["ab", "x"]), segment._pattern("a-z")
    found = [*segment._cut_in_slices(trie, parts)(iter([batch, batch.slice(90)]))]
    assert max(sum(len(w) for words in b.column(1).to_pylist() for w in words) for b in found) < 130 and len(found) > 8
    got = [r for b in found for r in b.to_pylist()]
    want = [[w for run in row or () for piece, un in segment._pieces(run, parts) for w in (segment.least_path(piece, lambda k: trie.ends(piece, k)) if un else [piece])] for row in runs]
    assert [r["tokens"] for r in got] == want + [[], []] and [r["k"] for r in got] == [*range(92), 90, 91]


def cut_by_arrays(words, unspaced, rows):
    import pyarrow as pa

    batch = pa.record_batch({"k": list(range(len(rows))), "tokens": pa.array(rows, pa.list_(pa.string()))})
    return [r["tokens"] for b in segment._cut_in_slices(segment.Trie(words), segment._pattern(unspaced))(iter([batch])) for r in b.to_pylist()]


def cut_alone(words, unspaced, rows):
    trie, parts = segment.Trie(words), segment._pattern(unspaced)
    return [[w for run in row or () for piece, un in segment._pieces(run, parts) for w in (segment.least_path(piece, lambda k: trie.ends(piece, k)) if un else [piece])] for row in rows]


def test_lattices_of_many_runs_are_solved_together(monkeypatch):
    """Runs of usual and of great length take no search of their own."""
    rng = random.Random(5)
    words = dictionary(5, 300, "abcdefgh")
    texts = [["".join(rng.choice([*words, "x"]) for _ in range(n)) for n in (1, 5, 30)] for _ in range(200)] + [["การสอบ" * 3000, "x"], None, [], [""]]
    words |= {"การ", "สอบ"}
    want = cut_alone(words, "a-zก-๎", texts)
    monkeypatch.setattr(segment, "least_path", None)
    assert cut_by_arrays(words, "a-zก-๎", texts) == want


def test_arrays_equal_the_search_of_each_run(monkeypatch):
    """Marks, letters beyond the first plane, other scripts, small portions, and long runs whose stretches agree or do not."""
    rng, alone = random.Random(6), []
    plain = segment.least_path
    monkeypatch.setattr(segment, "least_path", lambda *a: alone.append(a[0]) or plain(*a))
    for k in range(15):
        letters = rng.choice(["ab", "abc", "กิี้้", "aé😀b"])
        words = dictionary(k, rng.choice([0, 3, 12]), letters)
        unspaced = rng.choice(["a-z", segment.UNSPACED, "a-zà-ÿ😀"])
        rows = [None, [], *([rng.choice([*letters, "7"]) * rng.randrange(90) + "".join(rng.choice([*words, *letters, "é"]) for _ in range(rng.choice([1, 9, 60, 700]))) for _ in range(3)] for _ in range(6))]
        monkeypatch.setattr(segment, "LETTERS_AT_ONCE", rng.choice([1, 200, 1_000_000]))
        monkeypatch.setattr(segment, "LATTICE_AT_ONCE", rng.choice([1, 200, 100_000]))
        monkeypatch.setattr(segment, "STRETCH", rng.choice([9, 80, 512]))
        monkeypatch.setattr(segment, "REACH", rng.choice([64, 256]))
        want = cut_alone(words, unspaced, rows)
        alone.clear()
        assert cut_by_arrays(words, unspaced, rows) == want, (words, rows)
    # The end of a run of one letter may tell how its beginning is cut: then it is solved as a whole.
    monkeypatch.setattr(segment, "STRETCH", 512)
    monkeypatch.setattr(segment, "REACH", 256)
    monkeypatch.setattr(segment, "LATTICE_AT_ONCE", 100_000)
    for n in (2000, 2001):
        alone.clear()
        got = cut_by_arrays(["aa"], "a-z", [["a" * n]])
        assert len(alone) == n % 2 and got == cut_alone(["aa"], "a-z", [["a" * n]])


def test_documents_of_one_file_go_to_many_tasks(spark):
    from clauselake.plans.registry import QUERIES

    found = QUERIES["segment_words"](spark, "/root/testdata/sf0.001").select("doc_id", spark_partition_id().alias("task"))
    assert found.select("task").distinct().count() > 4

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauselake.llm import bpe, components, exact_dedup, langid, mixing, near_dedup, tokenfile

DATA = "/root/testdata/sf0.001"
RANKS = f"file:{public_tokenizers.path('byte_bpe_50k.tiktoken')}"
MODEL = f"file:{public_tokenizers.path('byte_bpe_50k.json')}"


def ascii_low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# exact dedup


def brute_exact(data):
    groups = defaultdict(list)
    for r in data:
        groups[ascii_low(r["text"])].append(r["doc_id"])
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(
        (str(r["doc_id"]), str(best[t]), len(groups[t]), r["doc_id"] == best[t], hashlib.sha256(t.encode()).hexdigest())
        for r in data
        for t in [ascii_low(r["text"])]
    )


@pytest.mark.parametrize("bucket_entries", [1, 3, 1000])
def test_exact_dedup(odd, documents, bucket_entries):
    for docs in (odd, documents.limit(60)):
        got = exact_dedup.exact_dedup(docs, bucket_entries=bucket_entries)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got.collect()) == brute_exact(rows(docs))


def test_exact_dedup_buckets_double_until_none_is_overfull(documents):
    index = exact_dedup.build_index(documents, bucket_entries=10)
    loads = index.groupBy("bucket", "depth").count().collect()
    assert max(r["count"] for r in loads) <= 10 and len({r["depth"] for r in loads}) > 1


def test_exact_dedup_finds_entries_through_its_directory(documents):
    index = exact_dedup.build(documents, bucket_entries=10)
    n = documents.count()
    assert exact_dedup.probe(documents, index).count() == n
    # With every slot pointing to another bucket, nothing is found.
    astray = index._replace(slots=index.slots.withColumn("bucket", F.col("bucket") + 1))
    assert exact_dedup.probe(documents, astray).count() == 0
    # Without half of the slots, the documents of the other half are found.
    half = index._replace(slots=index.slots.where("slot % 2 = 0"))
    assert 0 < exact_dedup.probe(documents, half).count() < n


def test_exact_dedup_splits_a_hot_text_and_joins_a_large_directory(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("The same")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), F.lit(1).alias("slot"), F.lit(2).alias("row"))
    index = exact_dedup.build(docs, bucket_entries=100)
    assert index.slots.agg(F.max("shares")).first()[0] > 50
    got = exact_dedup.probe(docs, index)
    assert got.count() == 3000 and got.where("kept").count() == 2001 and got.agg(F.max("group_size")).first()[0] == 1000
    monkeypatch.setattr(exact_dedup, "BROADCAST_SLOTS", 0)
    kept = exact_dedup.deduplicated(docs, bucket_entries=100)
    assert kept.columns == docs.columns and kept.count() == 2001 and kept.where("text = 'The same'").first()["doc_id"] == 2997


def test_exact_dedup_keeps_columns_and_one_row_each(odd, no_docs):
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "2", "3", "5", "6", "8", "9", "None"]
    assert exact_dedup.exact_dedup(no_docs).count() == 0


# mixing


def test_min_cost_flow_routes_overlap_to_the_source_that_needs_it():
    flow = mixing.min_cost_flow({("a", "b"): 10, ("a",): 10}, {"a": 12, "b": 8}, 1)
    assert flow == {(("a",), "a"): 10, (("a", "b"), "a"): 2, (("a", "b"), "b"): 8}


def test_min_cost_flow_matches_a_linear_search():
    import itertools

    rng = random.Random(3)
    for _ in range(30):
        patterns = {p: rng.randint(0, 4) for p in [("a",), ("b",), ("a", "b"), ("b", "c")]}
        quotas = {s: rng.randint(0, 6) for s in "abc"}
        flow = mixing.min_cost_flow(patterns, quotas, 2)

        def cost(f, patterns=patterns):
            through = {p: sum(f.get((p, s), 0) for s in p) for p in patterns}
            return sum(max(0, through[p] - n) for p, n in patterns.items())

        def allowed(f, patterns=patterns, quotas=quotas):
            return all(sum(f.get((p, s), 0) for s in p) <= 2 * n for p, n in patterns.items()) and all(sum(v for (_, t), v in f.items() if t == s) <= q for s, q in quotas.items())

        assert allowed(flow)
        arcs = [(p, s) for p in patterns for s in p]
        best = max(
            ((sum(v), -cost(f)) for v in itertools.product(*[range(min(quotas[s], 2 * patterns[p]) + 1) for p, s in arcs]) if allowed(f := dict(zip(arcs, v, strict=True)))),
        )
        assert (sum(flow.values()), -cost(flow)) == best


def test_capped_targets():
    sizes = {"a": 10, "b": 100, "c": 100}
    targets = mixing.capped_targets(sizes, {"a": 5, "b": 2, "c": 1}, 1.5, 2)
    assert targets["a"] == 20 and sum(targets.values()) == pytest.approx(315) and targets["b"] == pytest.approx(2 * targets["c"], abs=1e-6) or targets["b"] == 200


def test_mix_is_near_its_targets_and_agrees_with_itself(documents, odd, no_docs):
    def run(docs):
        return mixing.mix(docs, F.array("source"), mixing.n_words(F.col("text")))

    first = sorted(map(str, run(documents).collect()))
    assert first == sorted(map(str, run(documents.repartition(7)).collect()))
    got = rows(run(documents))
    largest = max(r["size"] for r in got)
    for source in {r["members"][0] for r in got}:
        own = [r for r in got if r["members"] == [source]]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest
        assert sum(r["size"] for r in own) == own[0]["source_size"]
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert len(rows(run(odd))) == odd.count() and run(no_docs).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_rows_that_share_an_id_are_each_taken_as_the_mix_says(spark):
    docs = spark.createDataFrame([(1 + k // 40, f"{'word ' * (k % 5 + 1)}{k // 2}", "ab"[k % 3 == 0]) for k in range(120)], "doc_id long, text string, source string")
    taken = rows(mixing.mix(docs, F.array("source"), mixing.n_words(F.col("text"))))
    got = mixing.mixed(docs)
    assert got.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in taken)
    assert max(r["count"] for r in got.groupBy("doc_id", "text", "source").count().collect()) <= 4  # two equal rows, twice each
    same = spark.createDataFrame([(None, "one two", "a")] * 10 + [(2, "x", "b")], docs.schema)
    assert mixing.mixed(same).groupBy("source").count().orderBy("source").first()["count"] == sum(r["epochs"] for r in rows(mixing.mix(same, F.array("source"), mixing.n_words(F.col("text")))) if r["members"] == ["a"])


def test_mix_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, ["a"] if i % 3 else ["a", "b"], 10) for i in range(300)], "doc_id long, members array<string>, n long")
    got = rows(mixing.mix(docs, F.col("members"), F.col("n"), lambda names: {"a": 1, "b": 1}, share=0.5))
    taken = defaultdict(int)
    for r in got:
        for s in r["by_source"]:
            taken[s] += r["size"]
            assert s in r["members"]
    target = 0.5 * (3000 + 1000) / 2
    assert abs(taken["a"] - target) <= 10 and abs(taken["b"] - target) <= 10


# language


def test_suffix_automaton_parses_as_a_search_does():
    rng = random.Random(5)
    for _ in range(40):
        sample = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 60)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 200)))
        parser = langid.Parser({"x": sample}, letters=10, block=50)
        got = int(parser.phrases([text])[0][0, 0])
        ref, codes = parser._squeezed(parser._points(sample)).tobytes(), parser._squeezed(parser._points(text))
        if not np.count_nonzero(codes):
            assert got == 0
            continue
        want = 0
        for at in range(0, len(codes), 50):
            block = codes[at : at + 50].tobytes()
            while block:
                n = 1
                while n < len(block) and block[: n + 1] in ref:
                    n += 1
                if block[:1] not in ref:
                    n = 1
                block, want = block[n:], want + 1
        assert got == want


def test_language_accuracy_on_held_out_documents(spark, odd, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = langid.identify(docs, train=~held_out, keep=("lang",)).where(held_out)
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()
    found = {r["doc_id"]: r for r in rows(langid.identify(odd))}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[3]["lang_pred"] == "und" and found[1]["score"] == 0
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in rows(langid.identify(odd, train=F.lit(False)))} == {"und"}
    assert langid.accepted(odd).columns == odd.columns


def made_texts(seed, letters, n, words=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]


def test_a_rare_language_leaves_the_samples_of_others_whole(spark):
    a, b = made_texts(1, "abcdefgh", 140), made_texts(2, "abcdefgh", 140)
    labelled = [(i, t, "aa") for i, t in enumerate(a[:100])] + [(200 + i, t, "bb") for i, t in enumerate(b[:100])] + [(999, a[0][:25], "cc")]
    docs = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    samples = langid.collect_samples(docs, "text", "lang", F.col("doc_id"), 256, 400, 24_000)
    assert len(samples["aa"]) == len(samples["bb"]) > 20_000 and 0 < len(samples["cc"]) <= 26
    asked = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(a[100:] + b[100:])], docs.schema)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.union(asked), train=F.col("doc_id") < 1000).collect()}
    assert [found[1000 + i] for i in range(80)] == ["aa"] * 40 + ["bb"] * 40


def test_samples_come_from_all_over_the_texts(spark):
    a, b = made_texts(3, "abcdefgh", 60), made_texts(4, "abcdefgh", 60)
    head = made_texts(5, "abcdefgh", 1)[0][:450]  # the same first lines in both languages
    docs = spark.createDataFrame([(i, f"{head} {t}", ("aa", "bb")[i >= 40]) for i, t in enumerate(a[:40] + b[:40])], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(a[40:] + b[40:])], docs.schema)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.union(asked), train=F.col("doc_id") < 1000).collect()}
    assert [found[1000 + i] for i in range(40)] == ["aa"] * 20 + ["bb"] * 20
    samples = langid.collect_samples(spark.createDataFrame([(i, f"{i:05d}" * 400, "x") for i in range(5000)], docs.schema), "text", "lang", F.col("doc_id"), 256, 400, 24_000)
    assert len({piece[5:10] for piece in samples["x"].split()}) > 200  # nearly all of the 256 slots


def test_each_language_has_codes_for_all_its_letters():
    scripts = {"aa": "abcdefghijklmnopqrst", "bb": "αβγδεζηθικλμνξοπρστυ", "cc": "абвгдежзийклмнопрсту", "dd": "աբգդեզէըթժիլխծկհձղճմ", "ee": "".join(map(chr, range(0x4E00, 0x4E00 + 600)))}
    samples = {lang: " ".join(made_texts(k, letters, 4)) for k, (lang, letters) in enumerate(scripts.items())}
    asked = {lang: made_texts(k, letters, 4)[-1] + " 中文" for k, (lang, letters) in enumerate(scripts.items())}
    parser = langid.Parser(samples, letters=30, block=10**6)
    got, _ = parser.phrases(list(asked.values()))
    for i, text in enumerate(asked.values()):
        for k, sample in enumerate(samples.values()):
            left, want = text, 0
            while left:
                n = next((n for n in range(1, len(left)) if left[: n + 1] not in sample), len(left))
                left, want = left[n:], want + 1
            assert got[i, k] == want
    assert (got * parser.bits).argmin(axis=1).tolist() == [0, 1, 2, 3, 4]


def test_accepted_keeps_text_without_labels_and_writes_the_language(spark):
    a, b = made_texts(6, "abcdefgh", 60), made_texts(7, "abcdefgh", 60)
    rows = [(i, t, ("aa", "bb")[i >= 60]) for i, t in enumerate(a + b)]
    docs = spark.createDataFrame([(i, t, None if i % 60 == 1 else "aa" if i == 62 else lang) for i, t, lang in rows] + [(500, "12 .", "aa"), (501, None, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, langid.accepted(docs, train=F.col("doc_id") != 62).collect())) == rows
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(tuple, langid.accepted(bare).collect())) == [(i, t, None) for i, t, _ in rows]


# byte-level BPE and shard files


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS[5:], "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_rank_queue_takes_ranks_in_order():
    queue = bpe.RankQueue(70_000)
    ranks = random.Random(1).sample(range(70_000), 500)
    for r in ranks:
        queue.open(r, [r])
    assert [queue.take() for _ in ranks] == [(r, [r]) for r in sorted(ranks)] and queue.take() is None


def test_bpe_equals_the_library_on_random_and_long_texts():
    library, ranks = reference_encoding()
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN, remembered=500)
    rng = random.Random(2)
    parts = ["a", "b", "ing", " ", "  ", "\n", "\t", "é", "ß", "1", "'s", "'", "!", "😀", "̀", "\x85", "\x1c", "　", "日本", "\r\n", "A", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["ab" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(50_000)), "", "\x00", " \x00"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_order_when_a_merge_allows_an_earlier_one():
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"ab": 7, b"abc": 3, b"bc": 9, b"cab": 5, b"aba": 7 + 1, b"abab": 2}
    own, library = bpe.ByteBpe(ranks, r".+"), tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        assert own.encode([text])[0] == library.encode_ordinary(text)


def test_round_trip_query(spark, odd, no_docs):
    library, _ = reference_encoding()
    vocabulary = bpe.Vocabulary(spark, RANKS, public_tokenizers.PATTERN)
    got = sorted(map(tuple, bpe.round_trip(odd, vocabulary).collect()), key=str)
    want = []
    for r in rows(odd):
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(no_docs, vocabulary).count() == 0
    tokens = bpe.encode(odd, vocabulary)
    assert sorted(bytes(r["bytes"]) for r in bpe.decode(tokens, vocabulary).collect()) == sorted((r["text"] or "").encode() for r in rows(odd))


def test_few_texts_of_a_batch_are_encoded_at_once(monkeypatch):
    coder = bpe.ByteBpe({bytes([b]): b for b in range(256)}, public_tokenizers.PATTERN)
    sizes: list[int] = []
    encode = bpe.ByteBpe._ids
    monkeypatch.setattr(bpe.ByteBpe, "_ids", lambda self, texts: sizes.append(sum(map(len, texts))) or encode(self, texts))
    texts = [f"w{i} " * 1000 for i in range(400)]
    assert [bytes(x) for x in coder.encode(texts)] == [t.encode() for t in texts]
    assert max(sizes) < 310_000 and sum(sizes) == sum(map(len, texts))


def test_words_of_texts_are_looked_up_once_each(monkeypatch):
    model = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    encoder, library = tokenfile.LibraryEncoder(model, remembered=3), Tokenizer.from_str(model)
    asked: list[list[str]] = []
    values = bpe.Memory.values
    monkeypatch.setattr(bpe.Memory, "values", lambda self, different: asked.append(different) or values(self, different))
    texts = ["the cat the cat the", "the cat\u0e01 sat.\nThe", "", " ", "a  b", "x\0 y", "<|endoftext|> cat", "\u3000 the", "q" * 100 + " the"] * 50
    assert encoder.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert asked and all(len(set(x)) == len(x) < 20 for x in asked)


def test_words_go_to_the_library_once_whatever_marks_and_lines_stand_beside(monkeypatch):
    model = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    asked: list[str] = []
    pieces = tokenfile.LibraryEncoder._pieces
    monkeypatch.setattr(tokenfile.LibraryEncoder, "_pieces", lambda self, found: asked.extend(found) or pieces(self, found))
    encoder, library = tokenfile.LibraryEncoder(model), Tokenizer.from_str(model)
    texts = [f"the café{a} the café{b}" for a in ("", ",", ".", "!?", "$$$", "'s", "\nIs") for b in ("", ".", ";", ".\nIs", "\n")]
    assert encoder.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [p for p in asked if "café" in p] == [" café"]


def test_cut_texts_have_the_ids_of_whole_texts():
    model = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    encoder, library = tokenfile.LibraryEncoder(model, remembered=50, together=7), Tokenizer.from_str(model)
    rng = random.Random(9)
    letters = [*" \n\t\r\0\x1c\x85'.,$<1aasstlé×÷ßñ", " ", "\n", "\u0301", "\u00a0", "\u2003", "\u2019", "\u3000", "\u0e01", "日", "😀", "²", "\u02bc", "<|endoftext|>"]
    for most in (len(letters), 12, 4):
        some = rng.sample(letters, most)
        texts = ["".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(1500)]
        assert encoder.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_shard_access_count_and_occurrence():
    rng = np.random.default_rng(1)
    tokens = rng.zipf(1.3, 200_000).clip(0, 50_000).astype(np.uint32)
    shard = tokenfile.Shard(tokenfile.build(np.array([1, 2]), np.array([150_000, 50_000], np.uint32), tokens))
    assert (shard.all_tokens() == tokens).all()
    for i in (0, 65_535, 65_536, 199_999):
        assert shard.access(i) == tokens[i]
    for t in (1, 2, 77, 49_000, 70_000):
        places = np.flatnonzero(tokens == t)
        assert shard.count(t) == len(places) and shard.count(t, 1000, 90_000) == int(((places >= 1000) & (places < 90_000)).sum())
        assert [shard.occurrence(t, k) for k in range(min(4, len(places)))] == places[:4].tolist() and shard.occurrence(t, len(places)) is None
    empty = tokenfile.Shard(tokenfile.build(np.array([], np.int64), np.array([], np.uint32), np.array([], np.uint32)))
    assert len(empty.all_tokens()) == 0 and empty.count(3) == 0


def test_token_table(spark, odd, documents, no_docs):
    library = Tokenizer.from_file(MODEL[5:])
    special = spark.createDataFrame([(-1, "a <|endoftext|> b"), (-7, "<|endoftext|>"), (4, "x<|endoftext|>\n\n y"), (None, "z"), (5, "word " * 3000)], "doc_id long, text string")
    for docs in (odd, documents, special):
        data = sorted(rows(docs), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        want, start = [], 0
        for r in data:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = [tuple(r) for r in tokenfile.token_table(docs, MODEL, shard_tokens=5000).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert tokenfile.token_table(no_docs, MODEL).count() == 0


# near dedup


def brute_near(data, width, percent=80):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    sets = [shingles(r["text"]) for r in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, r in enumerate(data):
        groups[find(i)].append(r["doc_id"])
    out = []
    for i, r in enumerate(data):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((r["doc_id"], len(sets[i]), least, r["doc_id"] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [50, 0])
def test_near_dedup_equals_all_pairs(spark, odd, documents, no_docs, budget):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    near = [(1000, " ".join(base))]
    for k in range(60):  # a large group whose members are linked by some and not by others
        words = list(near[rng.randrange(len(near))][1].split())
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        near.append((1001 + k, " ".join(words)))
    planted = documents.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    for docs in (planted, odd) if budget else (planted,):
        got = near_dedup.near_dedup(docs, width=4, cross_budget=budget)
        assert sorted(map(tuple, got.collect()), key=str) == brute_near(rows(docs), 4)
    if budget:
        assert near_dedup.near_dedup(no_docs).count() == 0
        assert near_dedup.representatives(odd).columns == odd.columns


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}

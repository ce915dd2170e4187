import pytest

#: Odd texts: null, empty, white space, one word, repeated rows, long, copies that differ in case.
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n", None, "b"),
    (4, "word", "en", "a"),
    (5, "Word", "en", None),
    (5, "Word", "en", None),
    (6, "x" * 200_000, "de", "b"),
    (7, "one two three four five six seven eight nine ten", "en", "a"),
    (8, "ONE two three four five six seven eight nine ten", "en", "a"),
    (None, "no id at all", "en", "c"),
    (9, "été déjà là, ça va", "fr", "c"),
    (10, "日本語 текст 😀 <|endoftext|>  two  spaces \r\n", None, "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and extra columns whose names clash with what operators add."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit("clash"), "id": F.lit(-1), "key": F.lit("k"), "kept": F.lit(False), "score": F.lit(0.5), "node": F.lit(0)})


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.where("false")

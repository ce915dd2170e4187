import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from clauselake.functions import text as T


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function("t")).collect()]


@pytest.mark.parametrize(
    "function, given, want",
    [
        (T.fix_sara_am, "นํา", "นำ"),
        (T.arabic_digits, "ข้อ ๑๕/๒", "ข้อ 15/2"),
        (T.straight_quotes, "“a” ‘b’", "\"a\" 'b'"),
        (T.flatten_tables, "x<table><tr><td></td><td>ข้อ 4</td></tr><TR><TD a='b'> c\n</TD></TR><tr></tr></TABLE>y", "x\nข้อ 4\nc\ny"),
        (T.flatten_tables, "<table border=1><tr><td>a</td></tr></table>", "<table border=1><tr><td>a</td></tr></table>"),
        (T.remove_figure_lines, "a\n(University logo)\n(ก)\n(a1)", "a\n\n(ก)\n(a1)"),
        (T.remove_page_lines, "a\n- 3 -\nหน้า ๓\n3 / 10\n<page_number>5/30</page_number>\nsee 3/10", "a\n\n\n\n\nsee 3/10"),
        (T.strip_line_ends, "a  \n b\t\n\nc ", "a\n b\n\nc"),
        (T.collapse_blank_lines, "a\n\n\n\nb\n\nc", "a\n\nb\n\nc"),
        (T.strip, "  \t\x1ca b\n ", "a b"),
        (T.doc_slug, "rule G-2568.v2.pdf", "rule_G_2568_v2"),
    ],
)
def test_text_functions(spark, function, given, want):
    assert apply(spark, function, [given, None]) == [want, None]


def test_line_functions_equal_plain_patterns(spark):
    rng = random.Random(1)
    parts = ["- 3 -", "หน้า ๑", "3/10", "(Logo)", "(ก)", "a", " ", "\t", "\n", "\n\n\n", "\r", "\x85", " ", "\x1c", "<page_number>1</page_number>", " x "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    figure = re.compile(r"^\s*\([A-Za-z][A-Za-z ]*\)\s*$", re.MULTILINE)
    page = re.compile(r"^\s*(-\s*\d+\s*-|หน้า\s*\d+|\d+\s*/\s*\d+|<page_number>.*?</page_number>)\s*$", re.MULTILINE)
    assert apply(spark, T.remove_figure_lines, texts) == [figure.sub("", t) for t in texts]
    assert apply(spark, T.remove_page_lines, texts) == [page.sub("", t) for t in texts]
    assert apply(spark, T.strip, texts) == [t.strip() for t in texts]
    assert apply(spark, T.strip_line_ends, texts) == ["\n".join(line.rstrip() for line in t.split("\n")) for t in texts]


def test_quality_rules_in_order(spark):
    good = "นักศึกษาต้องลงทะเบียนเรียนตามระเบียบ 2568"
    values = [good, "", "   \n ", "สั้น", good + " (cid:12)", good + "", "abcdef ghijkl mnopqr stuvwx", None, "ก" * 20]
    got = apply(spark, T.quality, values)
    assert [g["reason"] for g in got] == ["ok", "short", "short", "short", "cid", "private_use", "ratio", "short", "ok"]
    assert got[5]["detail"] == 2 and got[6]["detail"] == 0 and got[3]["detail"] == 4 and not got[0]["needs_ocr"]
    shown = apply(spark, lambda t: T.reason_text(T.quality(t)["reason"], T.quality(t)["detail"]), values)
    assert "4" in shown[3] and "2" in shown[5] and "0.0%" in shown[6]


def test_point_ids(spark):
    keys = ["a", "rule_ข_อ_5", "x" * 300, ""]
    assert apply(spark, T.point_id, keys) == [str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys]


def test_null_columns(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(T.clean("t").alias("c"), F.lit(1)).first()["c"] is None

"""Column functions on text: white space, cleaning, and the quality gate of pages.

White space and digits are those of Unicode text, and only a line feed ends a line, so
that texts from any extractor are treated alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text processing knows it: Unicode's, and the four separator controls.
S = r"[\s\x1c-\x1f]"
#: Every line is matched on its own, a line feed alone ends it, classes are Unicode's.
LINES = "(?mdU)"

# Thai digits, curly quotes, and thresholds of the quality gate.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
CURLY, STRAIGHT = "“”‘’", "\"\"''"
MIN_TEXT_LENGTH = 20
MIN_SCRIPT_RATIO = 0.15
THAI = "฀-๿"
PRIVATE_USE = "-"

FIGURE_LINE = rf"{LINES}^{S}*\([A-Za-z][A-Za-z ]*\){S}*$"
PAGE_LINE = rf"{LINES}^{S}*(-{S}*\d+{S}*-|หน้า{S}*\d+|\d+{S}*/{S}*\d+|<page_number>.*?</page_number>){S}*$"
TABLE, ROW, CELL = "(?is)<table>(.*?)</table>", "(?is)<tr>(.*?)</tr>", "(?is)<td[^>]*>(.*?)</td>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"(?U)\A{S}+|{S}+\z", "")


def arabic_digits(text: Column | str) -> Column:
    return F.translate(col(text), THAI_DIGITS, "0123456789")


def fix_sara_am(text: Column | str) -> Column:
    return F.replace(col(text), F.lit("ํา"), F.lit("ำ"))


def straight_quotes(text: Column | str) -> Column:
    return F.translate(col(text), CURLY, STRAIGHT)


def flatten_tables(text: Column | str) -> Column:
    """A table becomes lines: one a row, its filled cells joined by a space."""

    def line(row: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(row, F.lit(CELL), F.lit(1)), strip)
        return F.array_join(F.filter(cells, lambda c: c != ""), " ")

    def lines(table: Column) -> Column:
        rows = F.transform(F.regexp_extract_all(table, F.lit(ROW), F.lit(1)), line)
        return F.array_join(F.filter(rows, lambda r: r != ""), "\n")

    def flat(text: Column) -> Column:
        outside = F.split(text, TABLE, -1)
        inside = F.regexp_extract_all(text, F.lit(TABLE), F.lit(1))
        joined = F.zip_with(outside, inside, lambda o, i: F.when(i.isNull(), o).otherwise(F.concat(o, F.lit("\n"), lines(i), F.lit("\n"))))
        return F.when(F.contains(F.lower(text), F.lit("<table>")), F.array_join(joined, "")).otherwise(text)

    return bound(col(text), flat)


def remove_figure_lines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), FIGURE_LINE, "")


def remove_page_lines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), PAGE_LINE, "")


def strip_line_ends(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"{LINES}[\s\x1c-\x1f&&[^\n]]+$", "")


def collapse_blank_lines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "\n{3,}", "\n\n")


def clean(text: Column | str) -> Column:
    """All steps; characters and tables come before whole lines are judged. A step runs where its characters are there."""

    def where(found: Callable[[Column], Column], step: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda t: F.when(found(t), step(t)).otherwise(t)

    text = flatten_tables(straight_quotes(arabic_digits(fix_sara_am(text))))
    text = bound(text, where(lambda t: F.contains(t, F.lit("(")), remove_figure_lines))
    text = bound(text, where(lambda t: t.rlike(r"(?U)\d|<page_number>"), remove_page_lines))
    text = bound(strip_line_ends(text), where(lambda t: F.contains(t, F.lit("\n\n\n")), collapse_blank_lines))
    return strip(text)


def script_ratio(text: Column | str, script: str = THAI) -> Column:
    """Share of a script's characters among those that print; 0 if none does."""
    printed = F.regexp_replace(col(text), r"[\p{C}\p{Z}]", "")
    return bound(printed, lambda p: F.when(F.length(p) == 0, 0.0).otherwise(F.length(F.regexp_replace(p, f"[^{script}]", "")) / F.length(p)))


def quality(text: Column | str, script: str = THAI, min_length: int = MIN_TEXT_LENGTH, min_ratio: float = MIN_SCRIPT_RATIO) -> Column:
    """struct(needs_ocr, reason, detail): the first rule that fires, and its number. Null text counts as empty."""

    def measured(t: Column) -> Column:
        private = F.length(t) - F.length(F.regexp_replace(t, f"[{PRIVATE_USE}]", ""))
        return F.struct(F.length(t).alias("n"), F.contains(t, F.lit("(cid:")).alias("cid"), private.alias("private"), script_ratio(t, script).alias("ratio"))

    def judged(m: Column) -> Column:
        rules = (("short", m["n"] < min_length, m["n"].cast("double")), ("cid", m["cid"], F.lit(None).cast("double")), ("private_use", m["private"] > 0, m["private"].cast("double")), ("ratio", m["ratio"] < min_ratio, m["ratio"]))
        found = F.lit(None)
        for name, fires, number in reversed(rules):
            found = F.when(fires, F.struct(F.lit(True).alias("needs_ocr"), F.lit(name).alias("reason"), number.alias("detail"))).otherwise(found)
        return F.coalesce(found, F.struct(F.lit(False).alias("needs_ocr"), F.lit("ok").alias("reason"), F.lit(None).cast("double").alias("detail")))

    return bound(bound(strip(F.coalesce(col(text), F.lit(""))), measured), judged)


def reason_text(reason: Column, detail: Column) -> Column:
    """The reason as it is shown to people (fixed wording)."""
    percent = F.format_string("%.1f", detail * 100)
    return (
        F.when(reason == "short", F.concat(F.lit("ข้อความสั้นเกินไป ("), detail.cast("int"), F.lit(" ตัวอักษร) น่าจะเป็นภาพสแกน")))
        .when(reason == "cid", F.lit("พบ (cid:...) ฟอนต์ไม่มีตาราง unicode"))
        .when(reason == "private_use", F.concat(F.lit("พบอักขระ Private Use Area "), detail.cast("int"), F.lit(" ตัว (ฟอนต์ไทยรุ่นเก่า)")))
        .when(reason == "ratio", F.concat(F.lit("สัดส่วนอักษรไทยต่ำเกินไป ("), percent, F.lit("%) ฟอนต์น่าจะเพี้ยน")))
        .otherwise(F.lit("ข้อความใช้ได้"))
    )


def slug(text: Column | str) -> Column:
    """Runs of anything but letters, digits and the underscore become one underscore."""
    return F.regexp_replace(col(text), r"[^\p{L}\p{N}_]+", "_")


def doc_slug(doc: Column | str) -> Column:
    """A file name without its last extension, as a slug."""
    return slug(F.regexp_replace(col(doc), r"(?<=.)\.[^.]*$", ""))


def point_id(key: Column | str) -> Column:
    """UUID of version 5 in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(col(key), "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 8))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))

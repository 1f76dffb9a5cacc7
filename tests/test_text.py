"""String rules on hand-written edges."""

import pytest
from pyspark.sql import functions as F

from parley.functions import text


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string")
    return [r.v for r in rows.select("i", column.alias("v")).orderBy("i").collect()]


def test_white_space_class_and_characters_agree(spark):
    points = spark.range(1, 0xD800).union(spark.range(0xE000, 0x10000))
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    seen = points.select(char.alias("c")).where(F.col("c").rlike(rf"\A{text.WS}\z"))
    assert {r.c for r in seen.collect()} == set(text.WHITESPACE)


def test_trim(spark):
    got = values(spark, text.js_trim("c"), "\t\n a b \u00a0\ufeff\u3000", "\u200ba\u200b", "   ", "", None)
    assert got == ["a b", "\u200ba\u200b", "", "", None]


def test_lengths_count_utf16_units(spark):
    assert values(spark, text.js_length("c"), "abc", "a\U0001f600b", "é", "") == [3, 4, 1, 0]


@pytest.mark.parametrize("units, expected", [(1, "a"), (2, "a"), (3, "a\U0001f600"), (9, "a\U0001f600b")])
def test_slice_never_returns_half_a_character(spark, units, expected):
    assert values(spark, text.js_slice("c", units), "a\U0001f600b") == [expected]


def test_titles(spark):
    fifty, more = "x" * 50, "x" * 51
    assert values(spark, text.shorten_title("c"), fifty, more, "y") == [fifty, fifty + "...", "y"]
    emoji = "x" * 49 + "\U0001f600"
    assert values(spark, text.shorten_title("c"), emoji) == ["x" * 49 + "..."]


def test_title_base(spark):
    rows = spark.createDataFrame(
        [(0, " hi ", "a.txt"), (1, " \n", "a.txt"), (2, "", ""), (3, None, None)], "i int, t string, n string"
    )
    got = rows.select("i", text.title_base("t", "n").alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == ["hi", "File: a.txt", "New chat", "New chat"]


def test_three_defaults(spark):
    assert values(spark, text.stored_title("c"), "", None, "a") == ["New Chat", "New Chat", "a"]
    assert values(spark, text.shown_title("c"), "", None, "a") == ["Untitled chat", "Untitled chat", "a"]


def test_names_and_emails(spark):
    rows = spark.createDataFrame(
        [(0, "Ann", "x@y"), (1, "", "bob@y"), (2, None, "nobody"), (3, "", "@y"), (4, None, None)],
        "i int, n string, e string",
    )
    got = rows.select(
        "i", text.display_name("n", "e").alias("v"), text.placeholder_email("e", "i").alias("m")
    ).orderBy("i").collect()
    assert [r.v for r in got] == ["Ann", "bob", "nobody", "Student", "Student"]
    assert [r.m for r in got] == ["x@y", "bob@y", "nobody", "@y", "4@local.invalid"]


def test_ages(spark):
    inputs = ["17", "017", "", None, "12abc", "-5", "99999999999", " 8", "17\n", "abc", "+4"]
    assert values(spark, text.age_strict("c"), *inputs) == [17, 17, None, None, None, None, None, None, None, None, None]
    assert values(spark, text.age_lenient("c"), *inputs) == [17, 17, None, None, 12, -5, None, 8, 17, None, 4]


def test_long_reply(spark):
    assert values(spark, text.is_long_reply("c"), "x" * 680, "x" * 681, "", None) == [False, True, False, False]


def test_spans(spark):
    got = values(spark, text.inline_spans("c"), "a **b** c**d**", "**b**", "plain", "open ** end", "****", "")
    assert [[tuple(s) for s in spans] for spans in got] == [
        [(False, "a "), (True, "b"), (False, " c"), (True, "d"), (False, "")],
        [(False, ""), (True, "b"), (False, "")],
        [(False, "plain")],
        [(False, "open ** end")],
        [(False, "****")],
        [(False, "")],
    ]


def test_labels(spark):
    assert values(spark, text.attachment_label("c", F.lit("n")), "image", "text") == ["Image: n", "Text: n"]
    assert values(spark, text.file_label("c"), "n") == ["File: n"]


def test_dates(spark):
    row = spark.sql("select timestamp'2024-03-01 04:05:06' as t").select(text.date_text("t"), text.datetime_text("t"))
    assert tuple(row.first()) == ("2024-03-01", "2024-03-01 04:05:06")


def test_scaled_size(spark):
    rows = spark.createDataFrame([(0, 1280, 10), (1, 2560, 1281), (2, 10, 12800), (3, 0, 0)], "i int, w int, h int")
    w, h = text.scaled_size("w", "h")
    got = rows.select("i", w.alias("w"), h.alias("h")).orderBy("i").collect()
    # 1281 / 2 = 640.5 rounds up.
    assert [(r.w, r.h) for r in got] == [(1280, 10), (1280, 641), (1, 1280), (0, 0)]

import html
import re

import pytest
from pyspark.sql import functions as F, types as T

from dwellspark.functions.coerce import clean_flag, clean_price, clean_rooms, clean_size
from dwellspark.functions.text import clean_text, html_unescape
from dwellspark.operators.cleaning import clean_listings, clean_text_columns, split_rejects, to_table_types


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(build(F.col("v"))).collect()]


TEXTS = [
    None, "", "   ", "a&nbsp;b", "a&amp;lt;b", "a\t\n b", "a  b", "a\u001c b", " x ", "&#39;q&#39; &quot;", "&notanentity;",
    "&copy 2024", "&lt;b&gt;", " x ", "a\u0085b　c", "שלום   עולם", "&#x5D0;", "AT&T", "&ampx;", "a\u001fb", "​z",
]


def test_clean_text_is_what_python_does(spark):
    expected = [re.sub(r"\s+", " ", html.unescape(t)).strip() if t else "" for t in TEXTS]
    assert column(spark, TEXTS, "string", clean_text) == expected


def test_entities_are_decoded_once(spark):
    expected = [None if t is None else html.unescape(t) for t in TEXTS]
    assert column(spark, TEXTS, "string", html_unescape) == expected


def test_text_columns_keep_null_and_skip_absent_columns(spark):
    df = spark.createDataFrame([(None, " a  b "), ("", "   ")], "title string, city string")
    assert [tuple(r) for r in clean_text_columns(df).collect()] == [(None, "a b"), ("", "")]


@pytest.mark.parametrize(
    "text, number",
    [
        ("8,000 ש״ח", 8000), ("₪8000", None), ("8000.0", None), ("abc", None), ("-5", -5), ("0", 0), ("", None), (None, None),
        ("1_000", None), (" 700 ", 700), ("+5", 5), ("9999999999", None), ("1e3", None),
    ],
)
def test_price_text(spark, text, number):
    assert column(spark, [text], "string", lambda c: clean_price(c, T.StringType())) == [number]


def test_price_numbers(spark):
    assert column(spark, [8000, 0, None], "int", lambda c: clean_price(c, T.IntegerType())) == [8000, 0, None]
    assert column(spark, [8000.0, 0.0, None], "double", lambda c: clean_price(c, T.DoubleType())) == [None, 0, None]


def test_rooms(spark):
    texts = ["2.5", "x", "", None, " 3 ", "1e1", "2.5d", "2f", ".5", "3.", "1_0", "0x1"]
    expected = [2.5, None, None, None, 3.0, 10.0, None, None, 0.5, 3.0, None, None]
    assert column(spark, texts, "string", lambda c: clean_rooms(c, T.StringType())) == expected
    special = column(spark, ["nan", "inf", "-Infinity"], "string", lambda c: clean_rooms(c, T.StringType()))
    assert special[0] != special[0] and special[1:] == [float("inf"), float("-inf")]


def test_size(spark):
    assert column(spark, ["60", "60.5", "1,000", None, " 7 "], "string", lambda c: clean_size(c, T.StringType())) == [60, None, None, None, 7]
    assert column(spark, [60.7, float("nan"), None], "double", lambda c: clean_size(c, T.DoubleType())) == [60, None, None]


def test_flags_are_truthy(spark):
    assert column(spark, [None, "", "false", "true", "0"], "string", lambda c: clean_flag(c, T.StringType())) == [False, False, True, True, True]
    assert column(spark, [None, 0, 2], "int", lambda c: clean_flag(c, T.IntegerType())) == [False, False, True]
    assert column(spark, [None, False, True], "boolean", lambda c: clean_flag(c, T.BooleanType())) == [False, False, True]


def test_cleaning_keeps_rows_and_unknown_columns(spark):
    df = spark.createDataFrame([("k", " t ", None, "x")], "external_id string, title string, has_parking string, other string")
    cleaned = clean_listings(df)
    assert cleaned.columns == ["external_id", "title", "has_parking", "other"]
    assert tuple(cleaned.first()) == ("k", "t", False, "x")


ROWS = [
    ("a", "text", "2.25"), ("", "text", "2"), (None, "text", "2"), ("b", " ", "2"), ("c", None, "2"), ("d", "text", "100"),
    ("e", "text", "nan"), ("f", "text", "inf"), ("g", "text", "99.94"), ("h", "text", None),
]


def test_rejects_are_set_aside_one_by_one(spark):
    raw = spark.createDataFrame(ROWS, "external_id string, description string, rooms string")
    good, bad = split_rejects(clean_listings(raw))
    assert {r.external_id: r.rooms and float(r.rooms) for r in good.collect()} == {"a": 2.3, "g": 99.9, "h": None}
    reasons = sorted((str(r.external_id), r.reason) for r in bad.collect())
    assert reasons == [
        ("", "blank external_id"), ("None", "blank external_id"), ("b", "blank description"), ("c", "blank description"),
        ("d", "rooms out of range"), ("e", "rooms out of range"), ("f", "rooms out of range"),
    ]
    assert good.schema["price"].dataType == T.IntegerType() and good.schema["rooms"].dataType == T.DecimalType(3, 1)


def test_typing_marks_but_drops_nothing(spark):
    raw = spark.createDataFrame(ROWS, "external_id string, description string, rooms string")
    assert to_table_types(clean_listings(raw)).count() == len(ROWS)


def test_a_worker_takes_texts_apart_in_slices_of_bytes():
    import pyarrow as pa

    from dwellspark.functions.text import byte_slices

    for texts in ([], [None], ["a" * n if n % 5 else None for n in range(60)], ["x", "y" * 500, "", "z"]):
        given = pa.array(texts, pa.string())
        parts = list(byte_slices(given, 100))
        assert pa.concat_arrays(parts).to_pylist() == texts
        assert all(sum(len(t or "") for t in p.to_pylist()[1:]) < 100 for p in parts)

"""Cleaning, field combination, preprocessing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperlens.functions.text import clean_text, combine_fields, py_list_repr
from paperlens.operators.preprocess import preprocess


def _clean(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(clean_text("s")).collect()]


@pytest.mark.parametrize("raw,expected", [
    ("<p>Hello <b>world</b></p>", "Hello world"),
    ("hello   world\n\tnew  line", "hello world new line"),
    ("  hello  ", "hello"),
    ("", ""),
    (None, ""),
    ("a&#39;b", "a b"),                # numeric entity removed
    ("a&#x27;b", "a&#x27;b"),          # hexadecimal entity kept
    ("a  b", "a b"),         # NBSP is whitespace
])
def test_clean_text_literals(spark, raw, expected):
    assert _clean(spark, [raw]) == [expected]


def test_entities_removed_not_decoded(spark):
    out = _clean(spark, ["temperature &gt; 100&deg;C"])[0]
    assert "&gt;" not in out and "&deg;" not in out


def test_emoji_length_is_code_points(spark):
    df = spark.createDataFrame([("ab\U0001F600",)], "s string")
    assert df.select(F.length(clean_text("s"))).first()[0] == 3


def test_combine_fields(spark):
    df = spark.createDataFrame([("My Title", "My abstract text.", "", "")],
                               "t string, a string, j string, k string")
    out = df.select(combine_fields("t", "a", "j", "k")).first()[0]
    assert "TITLE: My Title" in out and "ABSTRACT: My abstract text." in out
    assert "JOURNAL" not in out and "KEYWORDS" not in out


def test_combine_fields_keywords_list(spark):
    df = spark.createDataFrame([("T", "A", "J", ["x", "y"]), ("T", "A", "J", [])],
                               "t string, a string, j string, k array<string>")
    rows = [r[0] for r in df.select(combine_fields("t", "a", "j", py_list_repr(F.col("k")))).collect()]
    assert rows[0] == "TITLE: T ABSTRACT: A JOURNAL: J KEYWORDS: ['x', 'y']"
    assert rows[1] == "TITLE: T ABSTRACT: A JOURNAL: J"


def test_preprocess_table(spark):
    rows = [
        ("A long enough title about genomes", "An abstract that is long enough to keep.",
         "Nature", "2021", 1, 5, ["genome"]),
        ("<b>HTML</b> title with markup", "<p>Abstract&amp; with tags and entities here</p>",
         "Science", "not a year", 0, None, []),
        ("Short", "X", "", "2020", 1, 1, []),
    ]
    df = spark.createDataFrame(rows, "title string, abstract string, journal string, year string, "
                                     "label int, cited_by_count int, keywords array<string>")
    out = preprocess(df).orderBy("title").collect()
    assert len(out) == 2                                  # the short row is dropped
    by_title = {r["title"]: r for r in out}
    html = by_title["<b>HTML</b> title with markup"]
    assert "<" not in html["title_clean"] and "&amp;" not in html["abstract_clean"]
    assert html["year"] == 0 and html["cited_by_count"] == 0
    assert isinstance(html["label"], int)
    first = by_title["A long enough title about genomes"]
    assert first["text"].endswith("KEYWORDS: ['genome']")
    assert first["text_length"] == len(first["text"]) > 50


def test_counts_out_of_range_and_odd_labels(spark):
    import pytest

    from paperlens.functions.coerce import to_int_or, to_int_or_null, to_whole
    vals = ["3000000000", "inf", "-inf", "nan", "2.9", "-2.9", "x", None, "1e300"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    r = df.select(to_int_or("v", kind="long"), to_int_or("v"), to_int_or_null("v")).collect()
    assert [x[0] for x in r] == [3000000000, 0, 0, 0, 2, -2, 0, 0, 0]
    assert [x[1] for x in r] == [0, 0, 0, 0, 2, -2, 0, 0, 0]
    assert [x[2] for x in r] == [None, None, None, None, 2, -2, None, None, None]
    ok = spark.createDataFrame([("1.0",), ("0",), (None,)], "v string").select(to_whole("v")).collect()
    assert [x[0] for x in ok] == [1, 0, None]
    for bad in ("1.5", "yes", "inf"):
        with pytest.raises(Exception, match="whole number"):
            spark.createDataFrame([(bad,)], "v string").select(to_whole("v")).collect()


def test_date_window_without_dates(spark):
    from paperlens.operators.preprocess import date_window
    df = spark.createDataFrame([("2020-05-01",), ("",), (None,), ("soon",), ("2030-01-01",)], "first_pub_date string")
    assert [r[0] for r in date_window(df, 2018, 2025).collect()] == ["2020-05-01"]

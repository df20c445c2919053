import html as stdlib_html

from pyspark.sql import functions as F

from pageledger.functions import entities, scores, text


def test_trim_and_collapse_take_wide_spaces(values):
    assert values(text.js_trim, ["  a b﻿　", "\t\n", "x"]) == ["a b", "", "x"]
    assert values(text.js_collapse, ["a \n  b", "a b", "a b", " 　", "a\tb"]) == ["a b", "a b", "a b", " ", "a b"]


def test_length_counts_utf16_units(values):
    assert values(text.js_length, ["a😀", "", "für", "abc"]) == [3, 0, 3, 3]


def test_prefix_cuts_by_utf16_units(values):
    assert values(lambda c: text.js_prefix(c, 2), ["a😀", "abc", "😀x", "é", "€€€"]) == ["a�", "ab", "😀", "é", "€€"]
    long = "x" * 3999 + "😀" + "tail"
    assert values(lambda c: text.js_prefix(c, 4000), [long]) == ["x" * 3999 + "�"]


def test_keywords_count(values):
    nine, ten = ",".join("abcdefghi"), ",".join("abcdefghij")
    assert values(text.keywords_count, ["", "a,,b,", "  ", nine, ten]) == [0, 4, 1, 9, 10]


def test_escape_html(values):
    assert values(text.escape_html, ["a&b<c>\"d'", "&amp;"]) == ["a&amp;b&lt;c&gt;&quot;d&#39;", "&amp;amp;"]


def test_number_cells(values):
    cells = ["1,234", "12%", " 12 ", "1e3", "5d", "NaN", "-3", "", None, "0x1F", ".5", "5.", "+7", "Infinity", "0b101"]
    expected = [0.0, 0.0, 12.0, 1000.0, 0.0, 0.0, -3.0, 0.0, 0.0, 31.0, 0.5, 5.0, 7.0, float("inf"), 5.0]
    assert values(text.js_number, cells) == expected


def test_number_texts(values):
    numbers = [91.0, 1.5e-5, 12345678.9, 0.1, -0.0, -2.5, 1e20]
    assert values(text.js_number_text, numbers, "double") == [
        "91", "0.000015", "12345678.9", "0.1", "0", "-2.5", "100000000000000000000",
    ]


def test_entities_match_the_html_standard(values):
    samples = [
        "a &amp; b", "&lt&gt;", "&notit;", "&#128;&#x41;&#0;&#xD800;", "&copy=1", "&unknown; &", "&&amp;amp;",
        "&Eacute;&eacute", "&#1114112;", "&#99999999999;", "&nbsp;x", "&fjlig;", "&am", "&amp", "&#0000000065;", "plain",
    ]
    assert values(entities.decode_entities, samples) == [stdlib_html.unescape(sample) for sample in samples]
    in_attribute = values(lambda c: entities.decode_entities(c, in_attribute=True), ["?a=1&copy=2", "&copy;", "&ampx", "&amp "])
    assert in_attribute == ["?a=1&copy=2", "©", "&ampx", "& "]


def test_score_bounds_are_exclusive(values):
    good, bad = "good", "needs improvement"
    assert values(scores.title_score, [10, 11, 69, 70], "int") == [bad, good, good, bad]
    assert values(scores.description_score, [50, 51, 159, 160], "int") == [bad, good, good, bad]
    assert values(scores.keywords_score, [0, 1, 9, 10], "int") == [bad, good, good, bad]
    assert values(scores.h1_score, [0, 1, 2], "int") == [bad, good, bad]


def test_needs_suggestion_ignores_headings(spark):
    rows = [("good", "good", "good", "needs improvement"), ("good", "needs improvement", "good", "good")]
    frame = spark.createDataFrame(rows, "title_score string, description_score string, keywords_score string, h1_score string")
    assert [row[0] for row in frame.select(scores.needs_suggestion()).collect()] == [False, True]


def test_suggestion_complete(spark):
    rows = [("a", "b", "c"), ("a", "", "c"), ("a", None, "c")]
    frame = spark.createDataFrame(rows, "suggested_title string, suggested_description string, suggested_keywords string")
    assert [row[0] for row in frame.select(F.coalesce(scores.suggestion_complete())).collect()] == [True, False, False]

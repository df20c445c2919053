import os
import time

from pageledger.operators import keywords
from pageledger.sources.keyword_files import materialise_keywords, read_keyword_files

METRICS = "file string, sheet_pos int, row_pos bigint, keyword string, clicks double, impressions double"


def test_column_detection():
    assert keywords.detect_columns(["Query", "Clicks", "Impressions"]) == ("Query", "Clicks", "Impressions")
    assert keywords.detect_columns(["Rank", "Search Term", "Click count"]) == ("Search Term", "Click count", None)
    assert keywords.detect_columns(["Topic", "Hits"]) == (None, None, None)


def test_files_with_differing_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Query,Clicks,Impressions\n red ,"1,234",7\n,5,5\nblue,12%,\n')
    (tmp_path / "b.csv").write_text("Rank,Search Term,Click count\n1,Red, 12 \n2,green,1e3\n")
    (tmp_path / "c.csv").write_text("Topic,Hits\nno,1\n")
    (tmp_path / "d.csv").write_text("Query,Clicks,Impressions\nlast,5d,-3\n")
    paths = [str(tmp_path / name) for name in ("a.csv", "b.csv", "c.csv", "d.csv")]
    rows = read_keyword_files(spark, paths).orderBy("file", "row_pos").collect()
    assert [(row.keyword, row.clicks, row.impressions) for row in rows] == [
        ("red", 0.0, 7.0), ("blue", 0.0, 0.0), ("Red", 12.0, None), ("green", 1000.0, None), ("last", 0.0, -3.0),
    ]
    assert read_keyword_files(spark, []).count() == 0


def test_materialised_table_is_reused_while_newer(spark, tmp_path):
    source, stored = tmp_path / "a.csv", str(tmp_path / "stored")
    source.write_text("Keyword\none\n")
    old = time.time() - 1000
    os.utime(source, (old, old))
    assert materialise_keywords(spark, [str(source)], stored).count() == 1
    source.write_text("Keyword\none\ntwo\n")
    os.utime(source, (old, old))
    assert materialise_keywords(spark, [str(source)], stored).count() == 1
    os.utime(source, (time.time() + 1000,) * 2)
    assert materialise_keywords(spark, [str(source)], stored).count() == 2


def ranked(spark, rows, n=20):
    frame = spark.createDataFrame([("f", 0, at, *row) for at, row in enumerate(rows)], METRICS)
    return keywords.top_keywords(frame, n)


def test_top_keywords(spark):
    rows = [("low", 1.0, 9.0), ("Red", 5.0, 1.0), ("red", 5.0, 2.0), ("tie1", 3.0, 3.0), ("tie2", 3.0, 3.0), ("none", None, None), ("RED", 5.0, 2.0)]
    top = ranked(spark, rows).orderBy("rank").collect()
    assert [row.keyword for row in top] == ["red", "tie1", "tie2", "low", "none"]
    assert [row.rank for row in top] == [1, 2, 3, 4, 5]
    assert [row.keyword for row in ranked(spark, rows, 2).orderBy("rank").collect()] == ["red", "tie1"]


def test_tops_union_and_list(spark):
    rows = [("a", 9.0, 0.0), ("b", 5.0, 50.0), ("c", None, 60.0), ("d", 0.0, 5.0), ("e", None, None)]
    top = ranked(spark, rows)
    by_impressions = keywords.top_by_impressions(top, 3)
    assert [row.keyword for row in by_impressions.orderBy("place").collect()] == ["c", "b", "d"]
    by_clicks = keywords.top_by_clicks(top, 3)
    assert [row.keyword for row in by_clicks.orderBy("place").collect()] == ["a", "b", "d"]
    both = keywords.union_first_wins(by_impressions, by_clicks).orderBy("part", "place").collect()
    assert [row.keyword for row in both] == ["c", "b", "d", "a"]
    listed = keywords.keyword_list(top, 3).head().keyword_list
    assert listed == "c, impressions: 60), b (clicks: 5, impressions: 50), d, impressions: 5), a (clicks: 9)"


def test_list_without_keywords(spark):
    assert keywords.keyword_list(ranked(spark, [("e", None, None)])).head().keyword_list == ""

"""Records over many splits against Python's csv module."""

import csv
import io
import random

from pyspark.sql import functions as F

from pageledger.sources.keyword_files import read_keyword_files
from pageledger.sources.records import quoted_records


def parsed(text):
    return [row for row in csv.reader(io.StringIO(text, newline="")) if "".join(row).strip()]


def split_small(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")


def test_any_split_gives_the_same_records(spark, tmp_path):
    rng = random.Random(4)
    cell = lambda: "".join(rng.choices(["a", "é", ",", "\n", '"', "\r\n", "long words ", "1"], k=rng.randint(0, 6)))
    expected = {}
    for name, end in (("one.csv", "\n"), ("two.csv", "\r\n")):
        out = io.StringIO(newline="")
        rows = [[cell() for _ in range(3)] for _ in range(400)] + [["x", "many\n" * 300, "y"]] + [[cell() for _ in range(3)] for _ in range(100)]
        csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL).writerows(rows)
        (tmp_path / name).write_bytes(out.getvalue().encode())
        expected[name] = parsed(out.getvalue())
    try:
        for size in (64, 500, 1 << 20):
            split_small(spark, size)
            found = quoted_records(spark, [str(tmp_path)]).collect()
            for name, rows in expected.items():
                mine = sorted((r.row_pos, r.record) for r in found if r.file.endswith(name))
                assert len({at for at, _ in mine}) == len(mine)
                assert [row for _, record in mine for row in parsed(record + "\n")] == rows
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")


def test_headers_with_breaks_and_doubled_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿"Search\nTerm","Note ""x"",",Clicks\r\n"red\nshoes","a, b",3\r\n\r\n"say ""hi""",,7\r\nplain,x,\r\n'.encode())
    (tmp_path / "b.csv").write_bytes(b'Impressions,Keyword\n5,"un\n\nclosed\n6,rest\n')
    found = {(r.keyword, r.clicks, r.impressions) for r in read_keyword_files(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")]).collect()}
    assert found == {("red\nshoes", 3.0, None), ('say "hi"', 7.0, None), ("plain", 0.0, None), ("un\n\nclosed\n6,rest", None, 5.0)}


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    body = "".join(f'"term {i}\nnext",{i}\n' for i in range(20_000))
    (tmp_path / "large.csv").write_text("Keyword,Clicks\n" + body)
    split_small(spark, 20_000)
    try:
        found = read_keyword_files(spark, [str(tmp_path / "large.csv")])
        assert found.agg(F.count("*"), F.sum("clicks"), F.countDistinct("keyword")).first()[:] == (20_000, sum(range(20_000)), 20_000)
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "large.csv")).rdd.getNumPartitions() > 10
        order = [r.clicks for r in found.orderBy("row_pos").select("clicks").collect()]
        assert order == [float(i) for i in range(20_000)]
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read_keyword_files(spark, [str(tmp_path / "empty.csv")]).count() == 0

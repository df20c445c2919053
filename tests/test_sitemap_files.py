"""Sitemap files over many splits against the reading of whole documents."""

import random

from pyspark.sql import functions as F

from pageledger.operators.sitemap import parse_urlset
from pageledger.sources.sitemap_files import read_urlset_files

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
ODD = {
    "empty.xml": "",
    "none.xml": HEAD + "</urlset>",
    "spaces.xml": f"\n  {HEAD}<url><loc> https://x.org/s </loc></url>\n</urlset>\n\n",
    "cut.xml": HEAD + "<url><loc>a</loc></url><url><loc>b</loc></url>",
    "crossed.xml": HEAD + "<url><loc>a</loc></url><url><loc>b</url></loc><url><loc>c</loc></url></urlset>",
    "stray.xml": HEAD + "<url><loc>a</loc></url></url></urlset>",
    "no_head.xml": "<urlset><url><loc>a</loc></url></urlset>",
    "index.xml": '<?xml version="1.0"?><sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>',
    "page.html": "<!doctype html><p>a</url>b",
    "open_comment.xml": HEAD + "<url><loc>a</loc></url><!-- <url><loc>b</loc></url></urlset>",
    "in_cdata.xml": HEAD + "<url><loc><![CDATA[a</url>b]]></loc></url><url><loc><![CDATA[<!-- c]]></loc></url></urlset>",
    "arrow.xml": HEAD + "<url><loc>a --> b</loc></url><url><loc>c</loc></url></urlset>",
    "nested.xml": HEAD + "<url><loc>a</loc><x><url><loc>b</loc></url></x></url><url><loc>c</loc></url></urlset>",
    "self_closed.xml": HEAD + "<url/><url><loc>a</loc></url><url /></urlset>",
    "later_head.xml": HEAD + "<url><loc>a</loc></url></urlset>" + HEAD + "<url><loc>b</loc></url></urlset>",
    "late_comment.xml": HEAD + "<url><loc>a</loc></url></urlset><!-- <url></url></urlset> -->",
    "comment_first.xml": HEAD + "<!-- <url><loc>x</loc></url> <url><loc>y</loc></url> --><url><loc>a</loc></url></urlset>",
    "wide_end.xml": HEAD + "<url><loc>a</loc></url ><url><loc>b</loc></url></urlset >",
}


def made(rng, entries):
    out = [HEAD]
    for at in range(entries):
        inner = rng.choice(["", "<lastmod>2024-01-02</lastmod>", "<priority></priority>", "<changefreq>daily</changefreq>", "<!-- x -->"])
        loc = rng.choice([f"<loc>https://x.org/é{at}?a=1&amp;b</loc>"] * 4 + [f"<loc><![CDATA[https://x.org/{at}]]></loc>", "", "<loc></loc>"])
        entry = f"<url>{inner}{loc}</url>"
        kind = rng.random() if "<!--" not in entry else 1
        if kind < 0.1:
            entry = f"<!-- {entry} -->"
        elif kind < 0.15:
            entry = "<!--" + entry * rng.randint(2, 9) + "-->"
        elif kind < 0.2:
            entry = entry.replace("</url>", "<!-- </url> --></url>")
        out.append(entry + rng.choice(["", "\n", "  "]))
    return "".join(out) + "</urlset>\n"


def split_small(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")


def unset(spark):
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_any_split_gives_the_entries_of_the_whole_document(spark, tmp_path):
    rng = random.Random(3)
    bodies = ODD | {"many.xml": made(rng, 60), "uncommented.xml": HEAD + "".join(f"<url><loc>u{n}</loc></url>\n" for n in range(30)) + "</urlset>"}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    docs = spark.createDataFrame([(name, body) for name, body in bodies.items()], "file string, body string")
    columns = ["file", "pos", "url", "lastmod", "priority", "changefreq"]
    expected = sorted(map(tuple, parse_urlset(docs).select(columns).collect()), key=str)
    assert {row[0] for row in expected} >= {"many.xml", "uncommented.xml", "in_cdata.xml", "arrow.xml", "self_closed.xml", "comment_first.xml"}
    assert not {row[0] for row in expected} & {"empty.xml", "none.xml", "cut.xml", "crossed.xml", "no_head.xml", "index.xml", "page.html"}
    try:
        for size in (190, 1 << 20):
            split_small(spark, size)
            found = read_urlset_files(spark, [str(tmp_path)]).withColumn("file", F.element_at(F.split("file", "/"), -1)).select(columns)
            assert sorted(map(tuple, found.collect()), key=str) == expected
    finally:
        unset(spark)


def test_a_large_file_is_many_tasks_work_and_is_never_one_value(spark, tmp_path):
    n = 3_000
    comment = "<!--" + "<url><loc>gone</loc></url>" * 800 + "-->"
    body = HEAD + "".join(f"<url><loc>https://x.org/{at}</loc></url>" + (comment if at == n // 2 else "") for at in range(n)) + "</urlset>"
    (tmp_path / "large.xml").write_text(body)
    try:
        split_small(spark, 1 << 13)
        assert spark.read.option("lineSep", "</url>").text(str(tmp_path)).rdd.getNumPartitions() > 10
        # with no whole reading allowed, all entries must come from pieces
        found = read_urlset_files(spark, [str(tmp_path)], whole_length=0)
        counts = found.agg(F.count("*"), F.min("pos"), F.max("pos"), F.count_distinct("pos"), F.count_if(F.concat(F.lit("https://x.org/"), "pos") == F.col("url")))
        assert tuple(counts.first()) == (n, 0, n - 1, n, n)
    finally:
        unset(spark)


def test_an_unsound_file_beyond_the_limit_gives_none(spark, tmp_path):
    (tmp_path / "nested.xml").write_text(ODD["nested.xml"])
    assert read_urlset_files(spark, [str(tmp_path)]).count() == 2
    assert read_urlset_files(spark, [str(tmp_path)], whole_length=20).count() == 0

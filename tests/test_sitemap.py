from pyspark.sql import functions as F

from pageledger.operators import sitemap

HEAD = '<?xml version="1.0"?>\n'


def test_robots(values):
    bodies = [
        "User-agent: *\nSITEMAP: https://x.org/a.xml\nsitemap: https://x.org/b.xml",
        " sitemap: https://x.org/indented.xml",
        "Sitemap:\n  https://x.org/next.xml",
        "sitemap: https://x.org/sitemap:b.xml",
        "Sitemap: https://x.org/crlf.xml\r\nDisallow: /",
        "Disallow: /",
        None,
    ]
    assert values(sitemap.sitemap_from_robots, bodies) == [
        "https://x.org/a.xml", None, "https://x.org/next.xml", "https://x.org/", "https://x.org/crlf.xml", None, None,
    ]


def test_choice(spark):
    sites = spark.createDataFrame(
        [("a", "https://a", "https://a/own.xml"), ("b", "https://b", ""), ("c", "c:8080/x", None), ("d", "https://d", None)],
        "site string, base_url string, sitemap string",
    )
    robots = spark.createDataFrame([("a", "Sitemap: no"), ("b", "Sitemap: https://b/r.xml"), ("d", "Sitemap:  ")], "site string, body string")
    found = {row.site: row.sitemap for row in sitemap.choose_sitemap(sites, robots).collect()}
    assert found == {"a": "https://a/own.xml", "b": "https://b/r.xml", "c": "https://c/sitemap.xml", "d": "https://d/sitemap.xml"}


def urlset(*locs):
    return HEAD + "<urlset>" + "".join(f"<url><loc>{loc}</loc></url>" for loc in locs) + "</urlset>"


def index(*locs):
    return HEAD + "<sitemapindex>" + "".join(f"<sitemap><loc>{loc}</loc></sitemap>" for loc in locs) + "</sitemapindex>"


def listed(spark, docs, root="root"):
    frame = spark.createDataFrame([("s", name, body) for name, body in docs.items()], "site string, doc_url string, body string")
    roots = spark.createDataFrame([("s", root)], "site string, doc_url string")
    return sitemap.expand_index(frame, roots).orderBy("pos").collect()


def test_urlset_forms(spark):
    body = (
        "\n \n" + HEAD + "<!-- c --><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"
        "<url><loc>https://x/1</loc><lastmod></lastmod><priority>0.50</priority></url>"
        "<url><lastmod>2024</lastmod></url>"
        "<url><loc a='b'><![CDATA[https://x/2?a&b]]></loc><changefreq>daily</changefreq></url>"
        "<url><loc>https://x/3?a&amp;b</loc></url><url><loc>https://x/1</loc></url></urlset>"
    )
    rows = listed(spark, {"root": body})
    assert [row.url for row in rows] == ["https://x/1", "https://x/2?a&b", "https://x/3?a&b", "https://x/1"]
    assert [row.pos for row in rows] == [0, 1, 2, 3]
    assert (rows[0].lastmod, rows[0].priority, rows[1].changefreq) == (None, "0.50", "daily")


def test_single_entry_and_rejected_documents(spark):
    assert [row.url for row in listed(spark, {"root": urlset("https://x/1")})] == ["https://x/1"]
    assert listed(spark, {"root": "<urlset><url><loc>https://x/1</loc></url></urlset>"}) == []
    assert listed(spark, {"root": urlset("https://x/1").replace("</urlset>", "")}) == []
    assert listed(spark, {"root": HEAD + "<rss><url><loc>https://x/1</loc></url></rss>"}) == []


def test_index_is_read_depth_first(spark):
    docs = {
        "root": index("a", "gone", "n", "b"),
        "a": urlset("1", "2"),
        "n": index("c", "bad", "d"),
        "b": urlset("6"),
        "c": urlset("3"),
        "d": urlset("4", "5"),
        "bad": HEAD + "<urlset><url>",
    }
    assert [row.url for row in listed(spark, docs)] == ["1", "2", "3", "4", "5", "6"]


def test_cycles_end_and_the_first_place_counts(spark):
    docs = {"root": index("n", "a"), "n": index("root", "m"), "m": index("a", "n"), "a": urlset("1"), "unused": urlset("9")}
    assert [(row.doc_url, row.url) for row in listed(spark, docs)] == [("a", "1")]
    late = {"root": index("x", "b"), "x": index("y"), "y": index("b", "c"), "b": urlset("1"), "c": urlset("2")}
    assert [row.url for row in listed(spark, late)] == ["1", "2"]


def test_membership_and_attributes(spark):
    listing = spark.createDataFrame(
        [("s", 2, "u/1", "late", None, None), ("s", 1, "u/1", "first", "", "x"), ("s", 3, "u/2/", "z", None, None), ("s", 4, "u/3", "e", None, None)],
        "site string, pos bigint, url string, lastmod string, priority string, changefreq string",
    )
    records = spark.createDataFrame([("s", "u/1", None), ("s", "u/2", None), ("s", "u/3", "failed")], "site string, url string, error string")
    rows = {row.url: row for row in sitemap.with_sitemap(records, listing).collect()}
    assert (rows["u/1"].in_sitemap, rows["u/1"].lastmod, rows["u/1"].priority, rows["u/1"].changefreq) == (True, "first", None, "x")
    assert (rows["u/2"].in_sitemap, rows["u/2"].lastmod) == (False, None)
    assert (rows["u/3"].in_sitemap, rows["u/3"].lastmod) == (False, None)


def test_kind(values):
    assert values(sitemap.sitemap_kind, [urlset("a"), index("a"), HEAD + "<!-- <no> --><a:b/>", "<urlset/>"]) == ["urlset", "sitemapindex", "a:b", ""]
    assert values(lambda body: F.coalesce(sitemap.looks_like_xml(body), F.lit(False)), ["﻿\n<?xml", "x", None]) == [True, False, False]

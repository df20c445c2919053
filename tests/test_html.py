import hashlib
import time

from pyspark.sql import functions as F

from pageledger.functions import html
from pageledger.operators.pages import extract_content, fetch, link_edges


def record(spark, body, url="https://x.org/a/b", status=200):
    pages = spark.createDataFrame([("x.org", url, status, body)], "site string, url string, status int, html string")
    return extract_content(pages).head().asDict()


def test_titles(values):
    pages = [
        "<p>none</p>",
        "<title>one</title><title>two</title>",
        "<!-- <title>no</title> --><title>yes</title>",
        "<title>   </title>",
        "<TITLE lang=en> a &amp; <b>b</b>\n</TITLE>",
        "<script>'<title>no</title>'</script><title>ok</title>",
        "<title>cut off",
        "<title></title>",
    ]
    assert values(html.title, pages) == ["", "one", "yes", "", "a & <b>b</b>", "ok", "cut off", ""]


def test_headings(values):
    pages = [
        "<p>x</p>",
        "<h1> a <b>b</b><!-- c --> d </h1><h1>second</h1>",
        "<!-- <h1>no</h1> --><H1 class='>'>yes &lt;</H1>",
        "<script>'<h1>no</h1>'</script><h1>ok</h1>",
        "<h1>open",
        "<h1>a<h2>b</h2>",
        "<h10>no</h10><h1>x</h1>",
    ]
    assert values(html.h1_text, pages) == ["", "a b d", "yes <", "ok", "open", "a", "x"]
    count = lambda page: html.h1_count(html.raw_tokens(page, html.RECORD_TAGS))
    assert values(count, pages) == [0, 2, 1, 1, 1, 1, 1]


def test_meta_fields(spark):
    found = record(
        spark,
        """<head><META content='d > "q"' NAME="description"><meta name="description" content="second">
        <meta name=keywords content=a,b><meta name=Robots content=x><meta name="robots" content="">
        <link rel="stylesheet" href="/s.css"><link href="/c" rel="CANONICAL"><meta property="og:title" content="o&amp;t">
        <meta name="og:image" content="no"><meta property="twitter:card" content="no"><meta name="twitter:title" content="t">
        <meta name="twitter:title"></head>""",
    )
    assert found["description"] == 'd > "q"'
    assert found["description_length"] == 7
    assert (found["keywords"], found["keywords_count"], found["keywords_score"]) == ("a,b", 2, "good")
    assert found["robots"] == ""
    assert found["canonical_url"] == "/c"
    assert (found["og_title"], found["og_image"]) == ("o&t", "")
    assert (found["twitter_card"], found["twitter_title"]) == ("", "t")


def test_tags_keep_first_of_duplicate_attributes(spark):
    page = """<a href="1" HREF='2' Title=t>x</a><br/><img src=a/b.png alt><!-- <i> --><script><u></script><p title="<b>">"""
    tags = spark.range(1).select(F.inline(html.tag_tokens(F.lit(page)))).collect()
    assert [(tag.pos, tag.name) for tag in tags] == [(0, "a"), (1, "br"), (2, "img"), (3, "p")]
    assert tags[0].attrs == {"href": "1", "title": "t"}
    assert tags[2].attrs == {"src": "a/b.png", "alt": ""}
    assert tags[3].attrs == {"title": "<b>"}


def test_single_attribute_reading_agrees_with_full_parse(spark):
    pages = [
        '<a href="x" href="y">', '<a title="x href=y" href=z>', "<A HREF = 'q\"r' >", "<a href>", "<a data-href=n href=m/>",
        '<a x="1"href="2">', "<a href=a&amp;b&copy=1>", '<a hrefx="1" href="2">', '<a/href="s">', '<ab href="no">',
        '<a class="c" disabled href="k&quot;">', '<a href="" href="z">',
    ]
    frame = spark.createDataFrame([(page,) for page in pages], "page string")
    tokens = frame.withColumn("tokens", html.raw_tokens(F.col("page"), html.RECORD_TAGS))
    for row in tokens.select("page", html.page_tags(F.col("tokens")).alias("fast"), html.parse_tags(F.col("tokens")).alias("full")).collect():
        full = [tag.attrs.get("href") for tag in row.full if tag.attrs.get("href")]
        assert row.fast.hrefs == full, row.page


def test_links(spark):
    page = """<a href="/a">1</a><a href="https://X.org/b/">2</a><a href="https://www.x.org/c">no</a><a href="">no</a>
    <a href="https://x.org:8080/d">3</a><a href="/a">4</a><a href="/a/b">self</a><a href="/mailto:x">no</a><a href="mailto:a@b">no</a>
    <script>'<a href="/no">'</script><!-- <a href="/no"> --><a name="x">no</a><a href="?q">5</a>"""
    assert record(spark, page)["links"] == [
        "https://x.org/a", "https://x.org/b", "https://x.org:8080/d", "https://x.org/a", "https://x.org/a/b", "https://x.org/a/b?q",
    ]


def test_visible_text(values):
    pages = [
        "<html><head><title>t</title></head><body> a <script>x</script><style>y</style><noscript>z</noscript>b&nbsp;&amp;\n c<!-- d --></body></html>",
        "<body></body>",
        "<title>t</title><p>a</p>b",
        "<body class='>'>x < y <b>z</b>",
        None,
    ]
    assert values(html.visible_text, pages) == ["a b & c", "", "ab", "x < y z", ""]


def test_failed_pages_are_error_records(spark):
    failed = record(spark, '<title>A title long enough</title><a href="/x">x</a>', status=404)
    assert failed["error"] == "HTTP error! Status: 404"
    assert (failed["title"], failed["title_length"], failed["links"]) == ("", 0, [])
    assert {failed[f"{name}_score"] for name in ("title", "description", "keywords", "h1")} == {"needs improvement"}
    assert record(spark, None)["error"] is None


def test_fetch_fills_pages_without_snapshot(spark):
    pages = spark.createDataFrame([("s", "https://s/1", "<title>x</title>")], "site string, url string, html string")
    visits = spark.createDataFrame([("s", "https://s/1"), ("s", "https://s/2")], "site string, url string")
    rows = {row.url: row for row in fetch(visits, extract_content(pages)).collect()}
    assert rows["https://s/1"].error is None and rows["https://s/1"].title == "x"
    assert rows["https://s/2"].error == "No snapshot for this URL"
    assert rows["https://s/2"].links == [] and rows["https://s/2"].title_score == "needs improvement"


def test_edges_keep_duplicates_and_order(spark):
    page = '<a href="/b">1</a><a href="/a">2</a><a href="/b">3</a>'
    pages = spark.createDataFrame([("x.org", "https://x.org", page), ("x.org", "https://x.org/n", "none")], "site string, url string, html string")
    rows = link_edges(extract_content(pages)).orderBy("pos").collect()
    assert [(row.pos, row.dst) for row in rows] == [(0, "https://x.org/b"), (1, "https://x.org/a"), (2, "https://x.org/b")]


def test_hostile_pages_end_quickly(spark):
    quote = '"'
    hostile = {
        "huge tag": "<a " + "x" * 20_000 + ' href="/ok">t</a>',
        "many attributes": "<a " + " ".join(f"k{n}={quote}v{quote}" for n in range(10_000)) + ' href="/ok">t</a>',
        "unclosed tags": "<a " * 100_000,
        "open quote": '<a href="' + "x" * 200_000,
        "big script": "<script>" + "<a href='/no'>" * 70_000 + "</script><a href='/ok'>t</a>",
        "unclosed scripts": "<script>" * 100_000,
        "unclosed comments": "<!--" * 100_000,
        "unclosed headings": "<h1>" * 50_000,
        "blanks": "<title>" + " " * 500_000 + "x" + " " * 500_000 + "</title>",
    }
    pages = spark.createDataFrame([("x.org", f"https://x.org/{name}", page) for name, page in hostile.items()], "site string, url string, html string")
    start = time.monotonic()
    rows = {row.url.rsplit("/", 1)[1]: row for row in extract_content(pages).collect()}
    assert time.monotonic() - start < 60
    for name in ("huge tag", "many attributes", "big script"):
        assert rows[name].links == ["https://x.org/ok"], name
    for name in ("unclosed tags", "open quote", "unclosed scripts", "unclosed comments"):
        assert rows[name].links == [], name
    assert rows["unclosed headings"].h1_count == 50_000
    assert rows["blanks"].title == "x"


def test_quotes_open_only_after_an_equals_sign(spark):
    pages = {
        '<a href="/x"">x</a><p>mid</p><a href="/y">y</a><meta name="robots" content="noindex"><p>end</p>': ("xmidyend", ["/x", "/y"]),
        '<p class="a"b">keep</p><a href=/z>z</a>': ("keepz", ["/z"]),
        "<p title=it's>keep</p><a href='/q' id=it's>q</a>": ("keepq", ["/q"]),
        '<a href= >e</a><a href=/u"v>w</a>': ("ew", ['/u"v']),
        '<a href="open>never</a><p>gone': ("", []),
    }
    frame = spark.createDataFrame([(page,) for page in pages], "html string")
    tags = html.page_tags(html.raw_tokens(F.col("html"), html.RECORD_TAGS))
    for row in frame.select("html", html.visible_text(F.col("html")).alias("text"), tags["hrefs"].alias("hrefs")).collect():
        assert (row.text, row.hrefs) == pages[row.html]


def test_a_heading_inside_a_frame_does_not_count(spark):
    frame = spark.createDataFrame([("<iframe src=x><h1>no</h1></iframe><h1>yes</h1>",)], "html string")
    row = frame.select(html.h1_text(F.col("html")).alias("h1"), html.h1_count(html.raw_tokens(F.col("html"), html.RECORD_TAGS)).alias("n")).head()
    assert (row.h1, row.n) == ("yes", 1)


def test_templates_hold_no_page_content(values):
    pages = {
        "a<template>b</template>c": "a<template></template>c",
        "a<template><template>b</template>c</template>d": "a<template></template>d",
        "a<TEMPLATE id='</template>'>b</Template >c": "a<TEMPLATE id='</template>'></Template >c",
        "a<template/>b</template>c": "a<template/></template>c",
        "a<template>b<template>c</template>d": "a<template>",
        "a</template>b<template>c": "a</template>b<template>",
        "<!--<template>-->a<template>b<!--</template>-->c</template>d": "<!--<template>-->a<template></template>d",
        "<script><template></script>a<textarea><template></textarea>b<template>": "<script><template></script>a<textarea><template></textarea>b<template>",
        "<svg><template>a</template></svg>b<template>c</template>": "<svg><template>a</template></svg>b<template></template>",
        "<template><svg><template></svg></template>a": "<template></template>a",
        "<template><svg></template>a<template>b</template>c": "<template></template>a<template></template>c",
        "<svg/><template>a</template>b": "<svg/><template></template>b",
        "<math><svg></math></svg><template>a</template>b": "<math><svg></math></svg><template></template>b",
        "a<b <template>c": "a<b <template>c",
        "<templates>a</templates><template>b": "<templates>a</templates><template>",
        "a<template>b<template": "a<template>",
        "": "",
    }
    assert dict(zip(pages, values(html.without_templates, list(pages)))) == pages


def test_fields_pass_templates_over(spark):
    page = (
        "<template><title>no</title><h1>no</h1><a href='/no'>n</a></template><title>yes</title><svg><title>icon</title></svg>"
        "<meta name='robots' content='x'><body><template><h1>no</h1><template><meta name='robots' content='no'></template></template>"
        "<h1>real</h1><a href='/ok'>t</a><template>rest <h1>no</h1><a href='/no'>"
    )
    found = record(spark, page)
    assert (found["title"], found["h1_text"], found["h1_count"], found["robots"]) == ("yes", "real", 1, "x")
    assert len(found["links"]) == 1 and found["links"][0].endswith("/ok")


def test_many_templates_take_linear_time(values):
    many = "<p>" * 700_000 + "<template><b></template>x" * 100_000 + "<template>" * 100_000 + "y" + "</template>" * 100_000
    started = time.monotonic()
    kept = values(lambda page: F.md5(html.without_templates(page)), [many])[0]
    assert time.monotonic() - started < 40
    assert kept == hashlib.md5(("<p>" * 700_000 + "<template></template>x" * 100_000 + "<template></template>").encode()).hexdigest()

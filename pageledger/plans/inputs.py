"""Audit inputs derived from the warehouse tables, for the registered queries.

Every input is a projection or join over whole tables; nothing is generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageledger.operators.pages import with_site


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The raw pages, keyed by host."""
    return with_site(table(spark, folder, "pages"))


def base_pages(pages: DataFrame) -> DataFrame:
    """The start page of each site: its first address in alphabetical order."""
    return pages.groupBy("site").agg(F.min("url").alias("url"))


def https_listing(pages: DataFrame) -> DataFrame:
    """A sitemap that lists the https pages; attributes are taken from the address."""
    return pages.filter(F.col("url").startswith("https://")).select(
        "site",
        F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml")).alias("doc_url"),
        F.col("page_id").alias("pos"),
        "url",
        F.concat(F.lit("rev-"), F.col("page_id").cast("string")).alias("lastmod"),
        F.when(F.col("url").contains("?"), "").otherwise("0.5").alias("priority"),
        F.when(F.col("url").endswith("/"), "daily").otherwise("").alias("changefreq"),
    )


def earlier_pages(pages: DataFrame) -> DataFrame:
    """Pages recorded by an earlier run: those whose address carries a fragment."""
    return pages.filter(F.col("url").contains("#")).select("site", "url")


def part_host() -> Column:
    return F.concat(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "-"), F.lit(".example.com"))


def part_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A product page per part, with every kind of tag an audit reads, in one site per brand.

    Size decides what a page lacks: small parts have no heading, large ones two, the largest cannot be fetched.
    """
    size, name, kind = F.col("p_size"), F.col("p_name"), F.lower("p_type")

    def present(condition: Column, *pieces: str | Column) -> Column:
        text = F.concat(*[F.lit(piece) if isinstance(piece, str) else piece for piece in pieces])
        return F.when(condition, text).otherwise("")

    always = F.lit(True)
    html = F.concat(
        present(always, "<!DOCTYPE html><html><head><!-- <title>no</title> --><title> ", name, " &amp; more </title>"),
        present(size > 3, '<meta name="description" content="', F.repeat(F.concat(name, F.lit(" ")), size), '">'),
        present(size > 8, "<META content='", F.regexp_replace(F.repeat(F.concat(kind, F.lit(",")), size), ",$", ""), "' NAME=keywords>"),
        present(size > 10, '<link rel="Canonical" href="https://', part_host(), "/part/", F.col("p_partkey").cast("string"), '"/>'),
        present(size > 12, '<meta property="og:title" content="', name, '"><meta property="og:title" content="second">'),
        present(size > 14, '<meta property=og:description content="', kind, ' &quot;', name, '&quot; > rest">'),
        present(size > 16, '<meta property="og:image" content="/img/', F.col("p_partkey").cast("string"), '.png">'),
        present(size > 18, '<meta name="twitter:card" content="summary"><meta name="twitter:title" content="', name, '">'),
        present(size > 20, '<meta name="twitter:description" content="', kind, '"><meta name="twitter:image" content="/t.png">'),
        present(size > 30, '<meta name="robots" content="noindex, ', kind, '">'),
        present(always, '<script>var s = "<meta name=\\"robots\\" content=\\"x\\"><h1>no</h1>";</script></head><body>'),
        present(size >= 5, "<h1 class='t'> ", name, ' <a href="/brand/', kind, '">', kind, "</a></h1>"),
        present(size > 40, "<h1>", kind, "</h1>"),
        present(always, '<a href="../part/', F.col("p_partkey").cast("string"), '/">self</a><a href="https://other.example.net/">x</a>'),
        present(always, "<p>", F.col("p_retailprice").cast("int").cast("string"), "</p></body></html>"),
    )
    status = F.when(size > 48, 404).when(size > 46, 500).otherwise(200)
    return table(spark, folder, "part").select(
        "p_partkey",
        part_host().alias("site"),
        F.concat(F.lit("https://"), part_host(), F.lit("/part/"), F.col("p_partkey").cast("string")).alias("url"),
        status.alias("status"),
        html.alias("html"),
    )


def _shop_host(nation: str) -> Column:
    return F.concat(F.lit("shop-"), F.col(nation).cast("string"), F.lit(".example.com"))


def shop_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Links of a shop per nation: customer to order, order to part, part back to order."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey")
    lines = (
        table(spark, folder, "lineitem")
        .select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber")
        .join(orders, "o_orderkey")
    )
    site = _shop_host("c_nationkey")

    def address(kind: str, key: str) -> Column:
        return F.concat(F.lit("https://"), site, F.lit(f"/{kind}/"), F.col(key).cast("string"))

    customer, order, part = address("customer", "o_custkey"), address("order", "o_orderkey"), address("part", "l_partkey")

    def edge(rows: DataFrame, source: Column, target: Column, place: str) -> DataFrame:
        return rows.select(
            site.alias("site"), source.alias("src"), target.alias("dst"), F.col(place).cast("bigint").alias("pos")
        )

    return (
        edge(orders, customer, order, "o_orderkey")
        .unionByName(edge(lines, order, part, "l_linenumber"))
        .unionByName(edge(lines, part, order, "o_orderkey"))
    )


def shop_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Each shop starts at its first customer."""
    first = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("key"))
    site = _shop_host("c_nationkey")
    url = F.concat(F.lit("https://"), site, F.lit("/customer/"), F.col("key").cast("string"))
    return first.select(site.alias("site"), url.alias("url"))


def shop_finished(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of the finished orders."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    done = table(spark, folder, "orders").filter("o_orderstatus = 'F'").join(customers, "o_custkey")
    site = _shop_host("c_nationkey")
    return done.select(site.alias("site"), F.concat(F.lit("https://"), site, F.lit("/order/"), F.col("o_orderkey").cast("string")).alias("url"))


def part_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword metrics: part names with the clicks and views of their events; parts without events have none."""
    events = table(spark, folder, "events").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("p_partkey"), "event_type"
    )
    counts = events.groupBy("p_partkey").agg(
        F.count_if(F.col("event_type") == "click").cast("double").alias("clicks"),
        F.count_if(F.col("event_type") == "view").cast("double").alias("impressions"),
    )
    return (
        table(spark, folder, "part")
        .select("p_partkey", F.col("p_name").alias("keyword"))
        .join(counts, "p_partkey", "left")
        .select(
            F.lit("events").alias("file"),
            F.lit(0).alias("sheet_pos"),
            F.col("p_partkey").alias("row_pos"),
            "keyword",
            "clicks",
            "impressions",
        )
    )


def document_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers ``(url, content)`` made of whole documents, well-formed or not depending on the language."""
    escaped = F.to_json(F.struct(F.col("text").alias("suggestedTitle"), F.col("source").alias("suggestedDescription")))
    head = F.regexp_replace(escaped, r"\}\z", "")
    keywords = (
        F.when(F.col("lang") == "de", ',"suggestedKeywords":["A","B"]}')
        .when(F.col("lang") == "es", ',"suggestedKeywords":null}')
        .when(F.col("lang") == "fr", ',"suggestedKeywords" : "Un, Deux"')
        .otherwise(F.concat(F.lit(',"suggestedKeywords":"Key '), F.upper("source"), F.lit(', Two"}')))
    )
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("url"), F.concat(head, keywords).alias("content")
    )


def suggested_pages(content: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Page records with suggestions: source and language as title, the document as description, title words as keywords."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), "text", "lang", "source")
    joined = content.join(documents, "page_id", "left")
    return joined.select(
        "page_id",
        "site",
        "url",
        F.concat("source", F.lit(" "), "lang").alias("suggested_title"),
        F.col("text").alias("suggested_description"),
        F.replace("title", F.lit(" "), F.lit(" , ")).alias("suggested_keywords"),
    )

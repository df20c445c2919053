"""Robots files, sitemap documents, listings and the joins with pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageledger.functions import text, urls
from pageledger.session import cut

_ROBOTS_LINE = rf"(?im)^sitemap:{text.WIDE_SPACE_CLASS}*(.+)$"
_ROOT = r"(?s)\A<\?xml(?:[^?]++|\?(?!>))*+\?>(?:[^<]++|<!--(?:[^-]++|-(?!->))*+-->|<[!?][^>]*+>)*+<([A-Za-z_:][A-Za-z0-9_:.\-]*+)"
_ENTRY = "struct<loc:string,lastmod:string,priority:string,changefreq:string>"
_DOCUMENT = f"struct<url:array<{_ENTRY}>,sitemap:array<struct<loc:string>>,_corrupt_record:string>"


def sitemap_from_robots(body: Column) -> Column:
    """Address in the first ``Sitemap:`` line of a robots file, NULL without one."""
    line = F.regexp_extract(body, _ROBOTS_LINE, 0)
    return F.when(line != "", text.js_trim(F.get(F.split(line, "(?i)sitemap:"), F.lit(1))))


def choose_sitemap(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """Sitemap of each site ``(site, base_url, sitemap)``: the given one, else that of robots, else the default."""
    found = robots.groupBy("site").agg(F.min("body").alias("body"))
    found = found.select("site", sitemap_from_robots(F.col("body")).alias("_found"))
    chosen = F.coalesce(
        F.nullif(F.col("sitemap"), F.lit("")),
        F.nullif(F.col("_found"), F.lit("")),
        urls.default_sitemap(urls.with_scheme(F.col("base_url"))),
    )
    return sites.join(found, "site", "left").withColumn("sitemap", chosen).drop("_found")


def looks_like_xml(body: Column) -> Column:
    return F.startswith(text.js_trim(body), F.lit("<?xml"))


def sitemap_kind(body: Column) -> Column:
    """``sitemapindex``, ``urlset`` or another root name, '' when there is none."""
    return F.regexp_extract(text.js_trim(body), _ROOT, 1)


def parse_document(body: Column) -> Column:
    """A sitemap document as its entries; ``_corrupt_record`` is set where it is malformed."""
    return F.from_xml(text.js_trim(body), _DOCUMENT, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})


def _entries(docs: DataFrame, kind: str, field: str) -> DataFrame:
    """Entries of one field of the documents of one kind: ``pos`` and ``entry``; malformed XML has none.

    Documents are sorted out by their text before parsing, and nothing filters on the parsed value, so each is
    parsed once.
    """
    keep = [name for name in docs.columns if name != "body"]
    wanted = docs.filter(looks_like_xml(F.col("body")) & (sitemap_kind(F.col("body")) == kind))
    parsed = wanted.select(*keep, parse_document(F.col("body")).alias("_doc"))
    sound = F.when(F.col("_doc._corrupt_record").isNull(), F.col(f"_doc.{field}"))
    named = F.filter(sound, lambda entry: F.coalesce(entry["loc"], F.lit("")) != "")
    exploded = parsed.select(*keep, F.posexplode_outer(named).alias("pos", "entry"))
    return exploded.filter(F.col("entry").isNotNull())


def parse_urlset(docs: DataFrame) -> DataFrame:
    """Entries of ``urlset`` documents, numbered in the document; entries without ``loc`` are dropped."""
    keep = [name for name in docs.columns if name != "body"]
    return _entries(docs, "urlset", "url").select(
        *keep,
        "pos",
        F.col("entry.loc").alias("url"),
        *[F.nullif(F.col(f"entry.{name}"), F.lit("")).alias(name) for name in ("lastmod", "priority", "changefreq")],
    )


def index_children(docs: DataFrame) -> DataFrame:
    """Children named by ``sitemapindex`` documents: ``(site, doc_url, pos, child)``."""
    return _entries(docs, "sitemapindex", "sitemap").select("site", "doc_url", "pos", F.col("entry.loc").alias("child"))


def expand_index(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """All listed URLs of the sites whose root document is in ``roots (site, doc_url)``.

    Documents are parsed where they are read; only addresses take part in joins.  Index documents are followed level
    by level.  A document counts once, at its first place in depth-first order: it is followed again only when a
    smaller path to it turns up, so cycles end and the order is exact.
    """
    children = cut(index_children(docs), "sitemap-children")
    empty_path = F.array().cast("array<int>")
    best = cut(roots.select("site", "doc_url", empty_path.alias("path")).distinct(), "sitemap-roots")
    frontier = best
    while not frontier.isEmpty():
        below = frontier.join(children, ["site", "doc_url"]).select(
            "site", F.col("child").alias("doc_url"), F.concat("path", F.array("pos")).alias("path")
        )
        smallest = below.groupBy("site", "doc_url").agg(F.min("path").alias("path"))
        known = best.select("site", "doc_url", F.col("path").alias("_known"))
        better = smallest.join(known, ["site", "doc_url"], "left").filter(
            F.col("_known").isNull() | (F.col("path") < F.col("_known"))
        )
        frontier = cut(better.drop("_known"), "sitemap-level")
        merged = best.unionByName(frontier).groupBy("site", "doc_url").agg(F.min("path").alias("path"))
        best = cut(merged, "sitemap-docs")
    # Entries are numbered in their document already; one row per document gives the place of its first entry in the site.
    entries = cut(parse_urlset(docs).join(best.select("site", "doc_url"), ["site", "doc_url"], "left_semi"), "sitemap-urls")
    sizes = entries.groupBy("site", "doc_url").agg(F.count(F.lit(1)).alias("_size")).join(best, ["site", "doc_url"])
    before = W.partitionBy("site").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("site", "doc_url", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = entries.join(starts, ["site", "doc_url"]).withColumn("pos", F.col("_start") + F.col("pos"))
    return numbered.select("site", "doc_url", "pos", "url", "lastmod", "priority", "changefreq")


def first_listing(listing: DataFrame) -> DataFrame:
    """One row per listed URL with the attributes of its first entry; combines map-side, so copies may abound."""
    attributes = F.struct("lastmod", "priority", "changefreq")
    first = listing.groupBy("site", "url").agg(F.min_by(attributes, "pos").alias("_first"), F.min("pos").alias("pos"))
    return first.select("site", "url", "pos", "_first.*")


def with_sitemap(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Add membership and attributes from the sitemap; failed pages get neither."""
    first = first_listing(listing).drop("pos").withColumn("_listed", F.lit(True))
    joined = records.join(first, ["site", "url"], "left")
    readable = F.col("error").isNull()
    attributes = {
        name: F.when(readable, F.nullif(F.col(name), F.lit(""))) for name in ("lastmod", "priority", "changefreq")
    }
    return joined.withColumns({"in_sitemap": readable & F.col("_listed").isNotNull(), **attributes}).drop("_listed")

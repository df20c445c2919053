"""From raw pages to page records and link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed
from pageledger.functions import html, scores, text, urls
from pageledger.schemas import PAGE_CONTENT_FIELDS
from pageledger.session import cut

NOT_IN_SNAPSHOT = "No snapshot for this URL"


def with_site(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add the ``site`` key, the host name of each page."""
    return pages.withColumn("site", urls.hostname(F.col(url)))


def _status_error(status: Column) -> Column:
    """The message of a failed fetch; pages without a status count as fetched."""
    failed = F.coalesce(~status.between(200, 299), F.lit(False))
    return F.when(failed, F.concat(F.lit(fixed.HTTP_ERROR_PREFIX), status.cast("string")))


def _content_columns() -> dict[str, Column]:
    tags, metas = F.col("_tags"), F.col("_tags.metas")
    return {
        "title": html.title_from_tokens(F.col("_tokens")),
        "description": html.meta_name(metas, "description"),
        "keywords": html.meta_name(metas, "keywords"),
        "h1_count": html.h1_count(F.col("_tokens")),
        "canonical_url": tags["canonical"],
        "og_title": html.meta_property(metas, "og:title"),
        "og_description": html.meta_property(metas, "og:description"),
        "og_image": html.meta_property(metas, "og:image"),
        "twitter_card": html.meta_name(metas, "twitter:card"),
        "twitter_title": html.meta_name(metas, "twitter:title"),
        "twitter_description": html.meta_name(metas, "twitter:description"),
        "twitter_image": html.meta_name(metas, "twitter:image"),
        "robots": html.meta_name(metas, "robots"),
    }


def _score_columns() -> dict[str, Column]:
    title_length = text.js_length(F.col("title"))
    description_length = text.js_length(F.col("description"))
    keywords_count = text.keywords_count(F.col("keywords"))
    return {
        "title_length": title_length,
        "title_score": scores.title_score(title_length),
        "description_length": description_length,
        "description_score": scores.description_score(description_length),
        "keywords_count": keywords_count,
        "keywords_score": scores.keywords_score(keywords_count),
        "h1_score": scores.h1_score(F.col("h1_count")),
    }


def extract_content(pages: DataFrame) -> DataFrame:
    """Page rows ``(site, url, html[, status])`` to content, scores, links and error.

    One map-only pass: the page text is scanned for tokens once, every field is picked from the token array, and
    the text itself is dropped.  Failed pages get empty fields and no links.  Rows keep any further columns.
    """
    status = F.col("status") if "status" in pages.columns else F.lit(None).cast("int")
    own = {"html", "status"}
    rest = [name for name in pages.columns if name not in own]
    error = _status_error(status)
    body = F.when(error.isNull(), F.coalesce(F.col("html"), F.lit("")))
    tokens = pages.select(*rest, error.alias("error"), body.alias("_html")).select(
        *rest,
        "error",
        F.coalesce(html.h1_text(F.col("_html")), F.lit("")).alias("h1_text"),
        F.coalesce(html.raw_tokens(F.col("_html"), html.RECORD_TAGS), F.array().cast("array<string>")).alias("_tokens"),
    )
    tags = tokens.withColumn("_tags", html.page_tags(F.col("_tokens")))
    content = tags.select(
        *rest,
        "error",
        "h1_text",
        *[column.alias(name) for name, column in _content_columns().items()],
        urls.page_links(F.col("_tags.hrefs"), F.col("url"), F.col("site")).alias("links"),
    )
    scored = content.withColumns(_score_columns())
    return scored.select(*rest, *[name for name, _ in PAGE_CONTENT_FIELDS], "links", "error")


def one_snapshot(content: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """One row per ``(site, url)`` of content rows: a page that was read before one that failed, then the latest by the ``order``
    columns that are there, then the greatest by a hash of its fields.

    The rows are written, and a count for each address tells which come again; only the rows of those are shuffled and compared.
    """
    rest = [name for name in content.columns if name not in ("site", "url")]
    latest = [F.col(name) for name in order if name in content.columns]
    fields = [name for name, _ in PAGE_CONTENT_FIELDS]
    content = cut(content, "snapshots")
    again = content.groupBy(F.col("site").alias("_site"), F.col("url").alias("_url")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_site", "_url")
    again = cut(again, "repeated")  # its exact size decides whether it is sent to the rows
    if again.isEmpty():
        return content.select("site", "url", *rest)
    same = F.col("site").eqNullSafe(F.col("_site")) & F.col("url").eqNullSafe(F.col("_url"))
    once = content.join(again, same, "left_anti")
    place = F.struct(F.col("error").isNull(), *latest, F.xxhash64(*fields, "links"))
    picked = content.join(again, same, "left_semi").groupBy("site", "url").agg(F.max_by(F.struct(*rest), place).alias("_one"))
    return cut(once.select("site", "url", *rest).unionByName(picked.select("site", "url", "_one.*")), "one-snapshot")


def link_edges(content: DataFrame) -> DataFrame:
    """One row per link of a fetched page: ``(site, src, dst, pos)``; duplicates and self-links stay.

    The outer form of explode, as from the inner form Catalyst infers a filter that would extract the links twice.
    """
    exploded = content.select("site", F.col("url").alias("src"), F.posexplode_outer("links").alias("pos", "dst"))
    return exploded.filter(F.col("dst").isNotNull()).select("site", "src", "dst", "pos")


def page_links(content: DataFrame) -> DataFrame:
    """One row per fetched page with links: ``(site, src, links array<struct<pos, url>>)``, as a crawl follows them."""
    placed = F.transform("links", lambda url, pos: F.struct(pos.alias("pos"), url.alias("url")))
    return content.filter(F.size("links") > 0).select("site", F.col("url").alias("src"), placed.alias("links"))


def error_defaults() -> dict[str, Column]:
    """Field values of a record whose page could not be read."""
    empty = {
        name: F.lit(0) if kind.typeName() == "integer" else F.lit("") for name, kind in PAGE_CONTENT_FIELDS
    }
    for name in ("title_score", "description_score", "keywords_score", "h1_score"):
        empty[name] = F.lit(fixed.NEEDS_IMPROVEMENT)
    empty["links"] = F.array().cast("array<string>")
    return empty


def fetch(visits: DataFrame, content: DataFrame) -> DataFrame:
    """Give every visited URL its page content; a URL without a snapshot becomes an error record.

    ``visits`` holds ``site``, ``url`` and whatever the record should keep; ``content`` comes from
    :func:`extract_content`, so page texts never take part in the join.
    """
    known = content.withColumn("_known", F.lit(True))
    joined = visits.join(known, ["site", "url"], "left")
    filled = {name: F.coalesce(F.col(name), value) for name, value in error_defaults().items()}
    error = F.when(F.col("_known").isNull(), F.lit(NOT_IN_SNAPSHOT)).otherwise(F.col("error"))
    return joined.withColumns({**filled, "error": error}).drop("_known")

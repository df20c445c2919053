"""A whole site audit over snapshot tables, many sites at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed
from pageledger.functions.urls import hostname, with_scheme
from pageledger.operators import frontier
from pageledger.operators.pages import extract_content, fetch, one_snapshot, page_links
from pageledger.operators.sitemap import choose_sitemap, expand_index, with_sitemap
from pageledger.operators.state import merge_results
from pageledger.operators.suggest import attach_suggestions
from pageledger.schemas import PAGE_METADATA


@dataclass(frozen=True)
class AuditOptions:
    depth: int = fixed.DEFAULT_DEPTH
    limit: int | None = fixed.DEFAULT_LIMIT
    follow_links: bool = True
    sitemap_only: bool = False
    single_page: bool = False
    force: bool = False

    def effective(self) -> AuditOptions:
        """A single page means no depth, no links, no sitemap and one page."""
        if not self.single_page:
            return self
        return AuditOptions(depth=0, limit=1, follow_links=False, single_page=True, force=self.force)


def base_urls(sites: DataFrame) -> DataFrame:
    """Complete the addresses of ``sites (url)`` and key them by host: ``(site, url)``."""
    complete = sites.select(with_scheme(F.col("url")).alias("url"))
    return complete.select(hostname(F.col("url")).alias("site"), "url").filter(F.col("site").isNotNull())


def sitemap_listing(sites: DataFrame, robots: DataFrame, docs: DataFrame) -> DataFrame:
    """Listed URLs of every site: choose its sitemap, then read it with all documents below it."""
    chosen = choose_sitemap(sites, robots)
    return expand_index(docs, chosen.select("site", F.col("sitemap").alias("doc_url")))


def site_audit(
    pages: DataFrame,
    bases: DataFrame,
    listing: DataFrame | None = None,
    options: AuditOptions = AuditOptions(),
    state: DataFrame | None = None,
    responses: DataFrame | None = None,
) -> DataFrame:
    """Page records in visit order: earlier ones from ``state``, then the pages reached now.

    ``responses (url, content)`` are the model's answers to earlier requests; records carry the suggestions in them.

    Page texts are read once, in a map-only pass whose slim result is written out.  Edges, levels and the final
    join all work on that.
    """
    options = options.effective()
    if options.single_page:
        listing = None
    if options.force:
        state = None
    taken = [name for name in ("status", "html", "fetched_at") if name in pages.columns]
    content = one_snapshot(extract_content(pages.select("site", "url", *taken)))
    start = frontier.seeds(listing, bases, options.sitemap_only)
    visits = frontier.crawl(
        start, page_links(content), options.depth, options.limit, options.follow_links, state
    )
    records = fetch(visits, content)
    if listing is None:
        absent = F.lit(None).cast("string")
        records = records.withColumns(
            {"in_sitemap": F.lit(False), "lastmod": absent, "priority": absent, "changefreq": absent}
        )
    else:
        records = with_sitemap(records, listing)
    if responses is not None:
        records = attach_suggestions(records, responses)
    names = set(records.columns)
    shaped = records.select(
        *[
            (F.col(field.name) if field.name in names else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in PAGE_METADATA
        ]
    )
    return merge_results(state, shaped)
